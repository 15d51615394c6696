"""Row groups, pages and levels of a packed cloud, as small tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.voxel import voxel_diagonal
from ..plans.model import AXES, Box, Transform

LOW, HIGH = [f"min{a}" for a in AXES], [f"max{a}" for a in AXES]
WORLD_LOW, WORLD_HIGH = [f"wmin{a}" for a in AXES], [f"wmax{a}" for a in AXES]


def _bounds() -> list[Column]:
    return [*[F.min(a).alias(lo) for a, lo in zip(AXES, LOW, strict=True)], *[F.max(a).alias(hi) for a, hi in zip(AXES, HIGH, strict=True)]]


def with_world(df: DataFrame, transform: Transform) -> DataFrame:
    """df with its integer bounds decoded."""
    new = {}
    for low, world in ((LOW, WORLD_LOW), (HIGH, WORLD_HIGH)):
        for i, (c, w) in enumerate(zip(low, world, strict=True)):
            new[w] = F.col(c).cast("double") * F.lit(transform.scale[i]) + F.lit(transform.offset[i])
    return df.withColumns(new)


def counted(points: DataFrame, *finer: str) -> DataFrame:
    """point_count and integer bounds of each row group, or of each page with finer = "page"."""
    return points.groupBy("resolution", "row_group", *finer).agg(F.count(F.lit(1)).alias("point_count"), *_bounds())


def row_groups(packed: DataFrame, transform: Transform, ratio: int, levels: int, counted_before: bool = False) -> DataFrame:
    """A row for each group: index over all levels, resolution, row_group (in the level), point_count, row_start, row_end,
    geometric_error, integer and world bounds. packed: points, or with counted_before counted(points, "page")."""
    if counted_before:
        bounds = [*[F.min(c).alias(c) for c in LOW], *[F.max(c).alias(c) for c in HIGH]]
        groups = packed.groupBy("resolution", "row_group").agg(F.sum("point_count").alias("point_count"), *bounds)
    else:
        groups = counted(packed)
    order = W.orderBy("resolution", "row_group")  # of groups, a quarter million points each
    groups = groups.withColumn("index", (F.row_number().over(order) - 1).cast("int"))
    groups = groups.withColumn("row_end", F.sum("point_count").over(order.rowsBetween(W.unboundedPreceding, 0)))
    groups = groups.withColumn("row_start", F.col("row_end") - F.col("point_count"))
    error = voxel_diagonal(max(transform.scale), ratio, levels, F.col("resolution"))
    return with_world(groups.withColumn("geometric_error", error), transform)


def pages(packed: DataFrame, groups: DataFrame, transform: Transform, counted_before: bool = False) -> DataFrame:
    """A row for each page: index of its group, resolution, page, point_count and bounds. packed: as in row_groups()."""
    out = packed if counted_before else counted(packed, "page")
    return with_world(out.join(groups.select("resolution", "row_group", "index"), ["resolution", "row_group"]), transform)


def resolutions(groups: DataFrame, transform: Transform, ratio: int, levels: int) -> DataFrame:
    """A row for each level, empty ones included: ranges of groups and rows, points, error, and bounds, null if empty."""
    spine = groups.sparkSession.range(levels).select(F.col("id").cast("tinyint").alias("resolution"))
    own = groups.groupBy("resolution").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("point_count").alias("point_count"),
        *[F.min(c).alias(c) for c in WORLD_LOW], *[F.max(c).alias(c) for c in WORLD_HIGH],
    )
    out = spine.join(own, "resolution", "left").fillna(0, ["groups", "point_count"])
    out = out.withColumn("geometric_error", voxel_diagonal(max(transform.scale), ratio, levels, F.col("resolution")))
    upto = W.orderBy("resolution").rowsBetween(W.unboundedPreceding, 0)  # of levels
    out = out.withColumn("row_group_end", F.sum("groups").over(upto)).withColumn("row_end", F.sum("point_count").over(upto))
    return out.withColumn("row_group_start", F.col("row_group_end") - F.col("groups")).withColumn("row_start", F.col("row_end") - F.col("point_count")).drop("groups")


def union_bounds(df: DataFrame) -> DataFrame:
    """One row: the bounds of all rows' world bounds, null of none."""
    return df.agg(*[F.min(c).alias(c) for c in WORLD_LOW], *[F.max(c).alias(c) for c in WORLD_HIGH])


def candidates(groups: DataFrame, box: Box, level: int) -> DataFrame:
    """Groups of levels up to `level` that meet an integer box, with contained: all of the group lies in it."""
    from ..functions.geometry import contains, overlaps

    return groups.filter(F.col("resolution") <= level).filter(overlaps(box, LOW, HIGH)).withColumn("contained", contains(box, LOW, HIGH))


def plan(groups: DataFrame, box: Box, level: int) -> DataFrame:
    """One row: row_groups_read and points_in_candidate_row_groups."""
    return candidates(groups, box, level).agg(F.count(F.lit(1)).alias("row_groups_read"), F.coalesce(F.sum("point_count"), F.lit(0)).alias("points_in_candidate_row_groups"))


def metrics(groups: DataFrame, found: DataFrame, box: Box, level: int) -> DataFrame:
    """One row: what a query reads, prunes and finds. Totals count the whole file, also levels beyond the query's."""
    from ..functions.geometry import overlaps

    hit = (F.col("resolution") <= level) & overlaps(box, LOW, HIGH)
    counted = groups.agg(
        F.count(F.lit(1)).alias("row_groups_total"), F.count_if(hit).alias("row_groups_read"), F.count_if(~hit).alias("row_groups_pruned"),
        F.coalesce(F.sum(F.when(hit, F.col("point_count"))), F.lit(0)).alias("points_in_candidate_row_groups"),
    )
    matched = found.agg(F.count(F.lit(1)).alias("points_matched"))
    return counted.join(F.broadcast(matched))  # one row each


def footer_groups(chunks: DataFrame) -> DataFrame:
    """A row for each row group as the footers have it (see sources.files.footers), pivoted: file, row_group in the file, point_count, bounds;
    null bounds where a column has no statistics."""
    side = lambda a, m, name: F.max(F.when(F.col("column_name") == a, F.col(m))).alias(name)
    bounds = [*[side(a, "least", lo) for a, lo in zip(AXES, LOW, strict=True)], *[side(a, "greatest", hi) for a, hi in zip(AXES, HIGH, strict=True)]]
    level = F.regexp_extract("file", "resolution=([0-9]+)/", 1).cast("tinyint").alias("resolution")
    return chunks.groupBy("file", level, "row_group").agg(F.any_value("rows").alias("point_count"), *bounds)


def coalesced_ranges(reads: DataFrame, max_gap: int = 32 * 1024, max_request: int = 2 * 1024 * 1024) -> DataFrame:
    """(file, start, end) of the requests that fetch reads (file, start, end): sorted, and merged over gaps of up to max_gap as long as a
    request stays within max_request. A single larger read is a request. An estimator: Spark's own reader merges by itself.

    Each request depends on the one before, so a file's reads pass one task in order, in a stream: a step for each, whatever their number.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for file, start, end in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "end")), strict=True):
                if held and held[0] == file and start - held[2] <= max_gap and max(held[2], end) - held[1] <= max_request:
                    held[2] = max(held[2], end)
                else:
                    if held:
                        out.append(held)
                    held = [file, start, end]
            yield rows(out, batch.schema.field("file").type)
            kind = batch.schema.field("file").type
        if held:
            yield rows([held], kind)

    def rows(found: list, kind: pa.DataType) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (kind, pa.int64(), pa.int64()), strict=True)], ["file", "start", "end"])

    ordered = reads.select("file", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).repartition("file").sortWithinPartitions("file", "start", "end")
    return ordered.mapInArrow(merge, ordered.schema)
