"""Sort-tile-recursive packing in three dimensions, and the order inside pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hilbert import MOST_BITS, bit_length, hilbert
from ..plans.model import AXES
from .ranks import ranked

ORDERS = ("spatial", "hilbert", "source", "gps-time")


def _ceil_div(a: Column, b: Column | int) -> Column:
    return F.ceil(a / (b if isinstance(b, Column) else F.lit(b))).cast("long")


def _ceil_root(n: Column, power: int) -> Column:
    """Least k with k ** power >= n, from the rounded root, which is off by one at most."""
    near = F.round(F.pow(n.cast("double"), F.lit(1.0 / power))).cast("long")

    def reaches(k: Column) -> Column:
        out = k
        for _ in range(power - 1):
            out = out * k
        return out >= n

    return F.when((near > 1) & reaches(near - 1), near - 1).when(reaches(near), near).otherwise(near + 1)


def _slab(leaf: Column, leaves: Column, slabs: Column) -> Column:
    """Which slab a leaf lies in when the first leaves % slabs slabs have one leaf more."""
    each, more = F.floor(leaves / slabs), leaves % slabs
    wide = more * (each + 1)
    return F.when(leaf < wide, F.floor(leaf / (each + 1))).otherwise(more + F.floor((leaf - wide) / F.greatest(each, F.lit(1)))).cast("long")


def packed(df: DataFrame, groups: list[str], capacity: int, name: str, large: bool = False) -> DataFrame:
    """df with `name`, the leaf of `capacity` points, from 0 in each group, that a point lies in.

    Slabs by x, then by y, then leaves by z; ties by the other axes and source_index. large: groups may be
    larger than a task should hold, as a level may; their first ranks come from a sort over all tasks. A slab holds about
    the 2/3 power of its group's leaves.
    """
    by = W.partitionBy(*groups)
    if large:
        out = ranked(df, groups, ["x", "y", "z", "source_index"], "_rank")
        sizes = out.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(F.broadcast(sizes), groups)  # a row for each level
    else:
        out = df.withColumn("_rank", F.row_number().over(by.orderBy("x", "y", "z", "source_index")) - 1).withColumn("_n", F.count(F.lit(1)).over(by))
    leaves = _ceil_div(F.col("_n"), capacity)
    out = out.withColumn("_leaves", leaves).withColumn("_leaf", F.floor(F.col("_rank") / F.lit(capacity)))
    out = out.withColumn("_slab", _slab(F.col("_leaf"), F.col("_leaves"), _ceil_root(F.col("_leaves"), 3)))
    slab = W.partitionBy(*groups, "_slab")
    out = out.withColumn("_first", F.min("_leaf").over(slab)).withColumn("_m", F.count(F.lit(1)).over(slab))
    out = out.withColumn("_rank", F.row_number().over(slab.orderBy("y", "x", "z", "source_index")) - 1)
    out = out.withColumn("_leaves", _ceil_div(F.col("_m"), capacity)).withColumn("_leaf", F.floor(F.col("_rank") / F.lit(capacity)))
    out = out.withColumn("_strip", _slab(F.col("_leaf"), F.col("_leaves"), _ceil_root(F.col("_leaves"), 2)))
    strip = W.partitionBy(*groups, "_slab", "_strip")
    out = out.withColumn("_second", F.min("_leaf").over(strip))
    out = out.withColumn("_rank", F.row_number().over(strip.orderBy("z", "x", "y", "source_index")) - 1)
    leaf = F.col("_first") + F.col("_second") + F.floor(F.col("_rank") / F.lit(capacity))
    out = out.withColumn(name, leaf.cast("long")).withColumn("_place", F.col("_rank") % F.lit(capacity))
    return out.withColumn(f"{name}_place", F.col("_place").cast("int")).drop("_rank", "_n", "_leaves", "_leaf", "_slab", "_first", "_m", "_strip", "_second", "_place")


def pack_levels(leveled: DataFrame, row_group_size: int) -> DataFrame:
    """leveled with row_group, from 0 in each level."""
    return packed(leveled, ["resolution"], row_group_size, "row_group", large=True).drop("row_group_place")


def pack_pages(grouped: DataFrame, page_rows: int) -> DataFrame:
    """grouped with page, from 0 in each row group, and page_place, the spatial order inside."""
    return packed(grouped, ["resolution", "row_group"], page_rows, "page")


def with_place(paged: DataFrame, order: str) -> DataFrame:
    """paged with `place`, from 0 in each page, by one of ORDERS; pages keep their points.

    spatial: as packed. source: by source_index. gps-time: by gps_time, least sign and magnitude first as IEEE total order
    has it, then source_index. hilbert: along the curve over the page's own cube, then source_index.
    """
    if order not in ORDERS:
        raise ValueError(f"order must be one of {', '.join(ORDERS)}")
    if order == "spatial":
        return paged.withColumn("place", F.col("page_place"))
    page = W.partitionBy("resolution", "row_group", "page")
    if order == "source":
        keys: list = ["source_index"]
    elif order == "gps-time":
        if "gps_time" not in paged.columns:
            raise ValueError("points without gps_time can't be put in its order")
        keys = [total_order(F.col("gps_time")), F.col("source_index")]
    else:
        low = [F.min(a).over(page).cast("long") for a in AXES]
        paged = paged.withColumns({f"_{a}": F.col(a).cast("long") - lo for a, lo in zip(AXES, low, strict=True)})
        paged = paged.withColumn("_span", F.max(F.greatest("_x", "_y", "_z")).over(page))
        paged = paged.withColumn("_bits", bit_length(F.col("_span")))
        shift = F.greatest(F.col("_bits") - MOST_BITS, F.lit(0))
        scaled = [F.floor(F.col(f"_{a}") / F.pow(F.lit(2.0), shift)).cast("long") for a in AXES]
        paged = paged.withColumn("_key", hilbert(*scaled, F.least(F.col("_bits"), F.lit(MOST_BITS))))
        keys = ["_key", "source_index"]
    return paged.withColumn("place", (F.row_number().over(page.orderBy(*keys)) - 1).cast("int")).drop("_x", "_y", "_z", "_span", "_bits", "_key")


def total_order(c: Column) -> Column:
    """A sort key for doubles in which -NaN < -inf < ... < -0 < +0 < ... < inf < NaN; Spark alone takes -0 and +0 as equal.

    Spark keeps one NaN, which counts as positive.
    """
    negative = (c < 0) | (c.cast("string") == "-0.0")
    return F.struct((~negative).alias("side"), c.alias("value"))
