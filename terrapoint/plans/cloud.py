"""A stored point cloud and its queries."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import inside
from ..operators import catalog
from .layout import SIDECAR, read_text
from .model import Box, Metadata, check_box, check_groups, check_level

COLUMNS = ("x", "y", "z", "red", "green", "blue")


class PointCloud:
    """Opens path, as plans.layout.write() left it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.metadata = Metadata.from_json(read_text(spark, f"{path}/{SIDECAR}"))
        self.points = spark.read.parquet(path)
        self.groups = spark.read.parquet(f"{path}/_catalog/row_groups")
        self.metadata.check_levels(self.group_count)
        missing = [c for c in COLUMNS[:3] if c not in self.points.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")

    @cached_property
    def group_count(self) -> int:
        return self.groups.count()

    def pages(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/_catalog/pages")

    def resolutions(self) -> DataFrame:
        return catalog.resolutions(self.groups, self.metadata.transform, self.metadata.voxel_edge_ratio, self.metadata.levels)

    def projected(self) -> DataFrame:
        """The columns of a result, before any filter."""
        have = set(self.points.columns)
        absent = [c for c in COLUMNS if c not in have]
        if absent:
            raise ValueError(f"missing columns: {', '.join(absent)}")
        return self.points

    def _result(self, rows: DataFrame) -> DataFrame:
        colors = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in COLUMNS[3:]]
        return rows.select("row_group", "resolution", *COLUMNS[:3], *colors)

    def query_quantized(self, box: Box, level: int) -> DataFrame:
        """Points of levels 0 to `level` in an integer box. Level, box and row group bounds reach the Parquet scan."""
        check_level(level, self.metadata.levels)
        check_box(box)
        return self._result(self.projected().filter(F.col("resolution") <= level).filter(inside(box)))

    def query_world(self, box: Box, level: int) -> DataFrame:
        """The same for a world box: an integer box inside it; without any point if that is empty."""
        check_level(level, self.metadata.levels)
        q = self.metadata.transform.quantize(box)
        if not any(math.isnan(v) for v in (*q.min, *q.max)) and q.empty:
            return self._result(self.projected()).limit(0)
        return self.query_quantized(q, level)

    def query_row_groups(self, indices: Sequence[int], box: Box) -> DataFrame:
        """Points of given row groups in a world box. Infinite bounds are allowed here; NaN finds nothing."""
        chosen = check_groups(indices, self.group_count)
        q = self.metadata.transform.quantize(box)
        rows = self.projected()
        if q.empty or any(math.isnan(v) for v in (*q.min, *q.max)) or not chosen:
            return self._result(rows).limit(0)
        named = self.groups.filter(F.col("index").isin(chosen)).select("resolution", "row_group")
        return self._result(rows.join(F.broadcast(named), ["resolution", "row_group"], "left_semi").filter(inside(q)))  # as many rows as indices

    def plan(self, box: Box, level: int) -> DataFrame:
        return catalog.plan(self.groups, box, level)

    def metrics(self, box: Box, level: int) -> DataFrame:
        return catalog.metrics(self.groups, self.query_quantized(box, level), box, level)

    def chunks(self, box: Box, level: int) -> Iterator[tuple[int, DataFrame]]:
        """A frame for each candidate row group, coarse ones first: results group by group, as a viewer wants them."""
        from ..streaming.progressive import chunked

        yield from chunked(self, box, level)
