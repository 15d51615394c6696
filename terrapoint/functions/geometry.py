"""Boxes, distances, views and number formats, as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import AXES, Box, Transform


def _all(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def decoded(transform: Transform, prefix: str = "w") -> list[Column]:
    """World coordinates of x, y, z."""
    return [(F.col(a).cast("double") * F.lit(s) + F.lit(o)).alias(prefix + a) for a, s, o in zip(AXES, transform.scale, transform.offset, strict=True)]


def local_decoded(transform: Transform, bounds: Box, world_origin: Sequence[float] = (0.0, 0.0, 0.0)) -> list[Column]:
    """Coordinates relative to a world origin. The middle of the bounds is subtracted as an integer before the product, which keeps
    digits; then where that middle lies from the origin, one number for all points, is added."""
    out = []
    for i, a in enumerate(AXES):
        middle = math.trunc(bounds.min[i] + (bounds.max[i] - bounds.min[i]) / 2)
        away = middle * transform.scale[i] + transform.offset[i] - world_origin[i]
        out.append(((F.col(a).cast("long") - F.lit(middle)).cast("double") * F.lit(transform.scale[i]) + F.lit(away)).alias("l" + a))
    return out


def requantized(c: Column, scale: float, offset: float) -> Column:
    """round((c - offset) / scale), halves up."""
    return F.floor((c - F.lit(offset)) / F.lit(scale) + 0.5)


def inside(box: Box) -> Column:
    """x, y, z lie in the box, both ends included: plain comparisons with literals, which reach the Parquet scan."""
    return _all([F.col(a).between(F.lit(lo), F.lit(hi)) for a, lo, hi in zip(AXES, box.min, box.max, strict=True)])


def overlaps(box: Box, low: Sequence[str], high: Sequence[str]) -> Column:
    """The box meets [low, high]; columns that are null, bounds that aren't known, count as meeting."""
    return _all([F.col(lo).isNull() | F.col(h).isNull() | ((F.col(h) >= F.lit(a)) & (F.col(lo) <= F.lit(b))) for lo, h, a, b in zip(low, high, box.min, box.max, strict=True)])


def contains(box: Box, low: Sequence[str], high: Sequence[str]) -> Column:
    """[low, high] lies in the box."""
    return _all([(F.col(lo) >= F.lit(a)) & (F.col(h) <= F.lit(b)) for lo, h, a, b in zip(low, high, box.min, box.max, strict=True)])


def holds_point(point: Sequence[float], low: Sequence[str], high: Sequence[str]) -> Column:
    return _all([F.lit(float(p)).between(F.col(lo), F.col(h)) for p, lo, h in zip(point, low, high, strict=True)])


def distance(point: Sequence[float], low: Sequence[str], high: Sequence[str]) -> Column:
    """From a point to a box: 0 inside, else the straight distance."""
    total = F.lit(0.0)
    for p, lo, h in zip(point, low, high, strict=True):
        d = F.greatest(F.col(lo) - F.lit(float(p)), F.lit(float(p)) - F.col(h), F.lit(0.0))
        total = total + d * d
    return F.sqrt(total)


def in_frustum(planes: Sequence[Sequence[float]], low: Sequence[str], high: Sequence[str]) -> Column:
    """The box has a corner on the inner side of every plane (a, b, c, d), where a x + b y + c z + d >= 0."""
    out = F.lit(True)
    for a, b, c, d in planes:
        best = F.lit(float(d))
        for k, lo, h in zip((a, b, c), low, high, strict=True):
            best = best + F.lit(float(k)) * (F.col(h) if k >= 0 else F.col(lo))
        out = out & (best >= 0)
    return out


def clipped(box: Box, low: Sequence[str], high: Sequence[str]) -> list[Column]:
    """Bounds of what the box leaves of [low, high]."""
    lows = [F.greatest(F.col(lo), F.lit(a)).alias(lo) for lo, a in zip(low, box.min, strict=True)]
    return [*lows, *[F.least(F.col(h), F.lit(b)).alias(h) for h, b in zip(high, box.max, strict=True)]]


def box_edges(low: Sequence[str], high: Sequence[str]) -> Column:
    """The 24 ends of a box's 12 edges, as array<struct<edge, end, x, y, z>>."""
    ends = []
    for axis in range(3):
        a, b = [k for k in range(3) if k != axis]
        for side in range(4):
            for end in range(2):
                corner = [0, 0, 0]
                corner[axis], corner[a], corner[b] = end, side & 1, side >> 1
                xyz = [F.col((high if c else low)[k]).alias(AXES[k]) for k, c in enumerate(corner)]
                ends.append(F.struct(F.lit(axis * 4 + side).alias("edge"), F.lit(end).alias("end"), *xyz))
    return F.array(*ends)


def _fixed(c: Column, digits: int) -> Column:
    """A double with so many digits after the point and no grouping; of two that are equally near the one further from zero."""
    scaled = F.abs(c) * F.lit(float(2 ** (digits + 1)))
    tie = (scaled == F.floor(scaled)) & (scaled % 2 == 1)  # only such doubles lie halfway
    nudged = c + F.when(tie, F.signum(c) * F.lit(10.0 ** -(digits + 2))).otherwise(F.lit(0.0))
    return F.replace(F.format_number(nudged, digits), F.lit(","), F.lit(""))


def short_number(c: Column) -> Column:
    """At most one digit after the point, with k, m, b or t for thousands up to billions of thousands: 1000 is 1k, 1250000 is 1.3m, 999950 is
    1m. Halves go away from zero; beyond 10,000t there is grouping."""
    exact = c.cast("decimal(32,6)")
    plain = lambda x: F.regexp_replace(x, "\\.0$", "")
    out = plain(_fixed(F.round(exact, 1).cast("double"), 1))
    for power, unit in ((3, "k"), (6, "m"), (9, "b"), (12, "t")):
        near = F.round(exact, 1 - power)
        value = near.cast("double") / F.lit(float(10**power))
        text = F.concat(plain(F.when(F.abs(value) < 10_000, _fixed(value, 1)).otherwise(F.format_number(value, 1))), F.lit(unit))
        # the unit below holds as long as what it would show is under a thousand
        shown = F.round(exact, 1) if power == 3 else F.round(exact, 4 - power)
        out = F.when(F.abs(shown) >= F.lit(10 ** power), text).otherwise(out)
    return out


def short_bytes(c: Column) -> Column:
    """Whole bytes below 1000, kB with one digit below a million, MB with two."""
    value = c.cast("double")
    small = F.concat(F.regexp_replace(c.cast("string"), "\\.0$", ""), F.lit(" B"))
    return F.when(value < 1e3, small).when(value < 1e6, F.concat(_fixed(value / F.lit(1e3), 1), F.lit(" kB"))).otherwise(F.concat(_fixed(value / F.lit(1e6), 2), F.lit(" MB")))


def grouped_integer(c: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(c, 0)


def coordinate(c: Column) -> Column:
    """Six digits after the point at most, without zeros at the end."""
    out = F.regexp_replace(F.regexp_replace(_fixed(c.cast("double"), 6), "0+$", ""), "\\.$", "")
    return F.when(out == "-0", F.lit("0")).otherwise(out)
