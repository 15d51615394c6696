"""Levels of detail: each point belongs to one level, and levels 0 to r together show the cloud at detail r."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hash64 import with_priority
from ..functions.voxel import voxel
from ..plans.model import AXES, Box, Transform, ladder_length


def cloud_bounds(points: DataFrame) -> Box | None:
    """Integer bounds; None for an empty cloud."""
    row = points.agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]).first()
    if row["minx"] is None:
        return None
    return Box(tuple(row[f"min{a}"] for a in AXES), tuple(row[f"max{a}"] for a in AXES))


def occupied_voxels(points: DataFrame, bounds: Box, transform: Transform, ratio: int, exponent: int, most: int) -> int:
    """Voxels with a point, counted up to most + 1."""
    return points.select(*voxel(bounds, transform, ratio, exponent)).distinct().limit(most + 1).count()


def level_count(points: DataFrame, bounds: Box, transform: Transform, ratio: int, target: int) -> int:
    """Levels such that the coarsest has at most `target` voxels: a binary search, five or six counts."""
    if target < 1:
        raise ValueError("target must be positive")
    low, high = 0, ladder_length(bounds, transform, ratio) - 1
    while low < high:
        mid = (low + high) // 2
        if occupied_voxels(points, bounds, transform, ratio, mid, target) <= target:
            high = mid
        else:
            low = mid + 1
    return low + 1


def with_levels(points: DataFrame, bounds: Box, transform: Transform, ratio: int, levels: int) -> DataFrame:
    """points with `resolution`, from 0 to levels - 1. points: x, y, z, source_index (unique) and anything else.

    Level r takes, in each voxel of width ratio ** (levels - 1 - r), the point of least (priority, source_index)
    among those that no coarser level took; the last level takes the rest. Levels can be empty. Points
    that coincide go to different levels.

    Voxels whose widths are powers of two nest exactly, so with such a ratio all levels are windows inside the partitions
    of one shuffle by the coarsest voxel; otherwise each level shuffles by its own voxels.
    """
    if levels < 1 or ratio < 2:
        raise ValueError("levels must be at least 1 and ratio at least 2")
    out = points.withColumn("resolution", F.lit(None).cast("tinyint"))
    nested = ratio & (ratio - 1) == 0 and levels > 1
    outer = []
    if nested:
        outer = ["_ox", "_oy", "_oz"]
        out = out.withColumns(dict(zip(outer, voxel(bounds, transform, ratio, levels - 1), strict=True))).repartition(*outer)
    for level in range(levels - 1):
        exponent = levels - 1 - level
        out = with_priority(out, exponent, "_priority")
        cell = ["_vx", "_vy", "_vz"]
        out = out.withColumns(dict(zip(cell, voxel(bounds, transform, ratio, exponent), strict=True)))
        order = W.partitionBy(*outer, *cell).orderBy(F.col("resolution").isNotNull(), "_priority", "source_index")
        chosen = (F.row_number().over(order) == 1) & F.col("resolution").isNull()
        out = out.withColumn("resolution", F.when(chosen, F.lit(level).cast("tinyint")).otherwise(F.col("resolution"))).drop("_priority", *cell)
    return out.withColumn("resolution", F.coalesce("resolution", F.lit(levels - 1).cast("tinyint"))).drop(*outer)


def level_counts(leveled: DataFrame, levels: int) -> DataFrame:
    """(resolution, point_count) for every level, empty ones included."""
    spine = leveled.sparkSession.range(levels).select(F.col("id").cast("tinyint").alias("resolution"))
    counts = leveled.groupBy("resolution").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "resolution", "left").select("resolution", F.coalesce("n", F.lit(0)).alias("point_count"))


def row_group_ends(counts: DataFrame, row_group_size: int) -> DataFrame:
    """(resolution, row_group_end): groups up to and with each level, when none holds two levels."""
    groups = F.ceil(F.col("point_count") / F.lit(row_group_size))
    return counts.select("resolution", F.sum(groups).over(W.orderBy("resolution").rowsBetween(W.unboundedPreceding, 0)).cast("long").alias("row_group_end"))
