"""Results in parts, coarse levels first."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import inside
from ..operators.catalog import candidates
from ..plans.model import Box, check_box, check_level

if TYPE_CHECKING:
    from ..plans.cloud import PointCloud


def chunked(cloud: PointCloud, box: Box, level: int) -> Iterator[tuple[int, DataFrame]]:
    """(index, points) of each candidate row group in order of index. A group that lies in the box is read without the filter.

    The list of candidates streams from its table, so the driver holds one partition of it.
    """
    check_level(level, cloud.metadata.levels)
    check_box(box)
    for g in candidates(cloud.groups, box, level).orderBy("index").toLocalIterator():
        rows = cloud.projected().filter((F.col("resolution") == g["resolution"]) & (F.col("row_group") == g["row_group"]))
        yield g["index"], cloud._result(rows if g["contained"] else rows.filter(inside(box)))


def gathered(cloud: PointCloud, box: Box, level: int, path: str) -> DataFrame:
    """All parts of chunked(), each added to a table at path as it comes: what has come can be read at any time, and no plan holds more than
    one part. The same rows as one query, row groups in order."""
    empty = cloud.query_quantized(box, level).limit(0)
    empty.write.mode("overwrite").parquet(path)
    for _, part in chunked(cloud, box, level):
        part.write.mode("append").parquet(path)
    return cloud.spark.read.schema(empty.schema).parquet(path)


def level_stream(cloud: PointCloud, box: Box) -> Iterator[tuple[int, DataFrame]]:
    """(level, points that this level adds), each a partition-pruned query."""
    for level in range(cloud.metadata.levels):
        yield level, cloud.query_quantized(box, level).filter(F.col("resolution") == level)
