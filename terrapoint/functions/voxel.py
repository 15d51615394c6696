"""Voxels of the level ladder, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import AXES, Box, Transform, voxel_width


def voxel_index(axis: int, origin: int, scale: float, width: int) -> Column:
    """floor(((c - origin) * scale) / width), the difference in integers and the rest in doubles, in this order."""
    difference = (F.col(AXES[axis]).cast("long") - F.lit(int(origin)).cast("long")).cast("double")
    return F.floor(difference * F.lit(scale) / F.lit(float(width)))


def voxel(bounds: Box, transform: Transform, ratio: int, exponent: int) -> list[Column]:
    """The three voxel numbers at ratio ** exponent."""
    width, scales = voxel_width(ratio, exponent), transform.normalized
    return [voxel_index(i, bounds.min[i], scales[i], width).alias(f"v{a}") for i, a in enumerate(AXES)]


def voxel_diagonal(max_scale: float, ratio: int, levels: int, level: Column) -> Column:
    """Geometric error of a level: its voxel's diagonal, 0 for the last level."""
    power = F.pow(F.lit(float(ratio)), (F.lit(levels - 1) - level).cast("double"))
    return F.when(level == levels - 1, F.lit(0.0)).otherwise(F.sqrt(F.lit(3.0)) * F.lit(max_scale) * power)
