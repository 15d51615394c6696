"""Statistics of repeated measurements of layouts, and of octree nodes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def medians(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Median of each value that is a number in every row of its group; null otherwise. Even counts give the middle two's mean."""
    out = [F.when(F.count(F.col(v)) == F.count(F.lit(1)), F.median(v)).alias(v) for v in values]
    return df.groupBy(*keys).agg(*out)


def spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Least, median and greatest value, mean, population deviation, coefficient of variation and range."""
    out = df.groupBy(*keys).agg(F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("greatest"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    return out.withColumn("variation", F.try_divide("deviation", "mean")).withColumn("range", F.col("greatest") - F.col("least"))


def median_trial(df: DataFrame, keys: Sequence[str], value: str, trial: str) -> DataFrame:
    """The row of the middle trial by value, ties by trial; groups must have an odd number of rows."""
    by = W.partitionBy(*keys)
    counted = df.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_k", F.row_number().over(by.orderBy(value, trial)))
    odd = F.when(F.col("_n") % 2 == 0, F.raise_error(F.lit("an even number of trials has no middle one"))).otherwise(F.col("_k") == F.ceil(F.col("_n") / 2))
    return counted.filter(odd).drop("_n", "_k")


def relative(df: DataFrame, baseline: Column, per: Sequence[str], values: Sequence[str]) -> DataFrame:
    """df with `<value>_vs`: value / baseline row's value - 1, the baseline being the row of the same `per` for which `baseline` holds."""
    by = W.partitionBy(*per)
    new = {f"{v}_vs": F.try_divide(F.col(v), F.max(F.when(baseline, F.col(v))).over(by)) - 1 for v in values}
    return df.withColumns(new)


def pareto(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Rows that no other row beats: at most as much in every value and less in one; rows equal in all beat neither.

    Each task keeps the rows that none of its own beats, a batch at a time; those of all tasks meet in one, which sees what is left
    of each and not the table. A row with a null value beats nothing and isn't beaten.
    """
    names = list(values)

    def front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                some = pa.Table.from_batches([batch.slice(k, 1000)])
                kept = some if kept is None else pa.concat_tables([kept, some])
                v = np.stack([kept.column(n).to_numpy().astype(float) for n in names])
                beaten = np.zeros(kept.num_rows, bool)
                for at in range(0, kept.num_rows, 256):
                    other = v[:, None, :] <= v[:, at : at + 256, None]
                    less = v[:, None, :] < v[:, at : at + 256, None]
                    beaten[at : at + 256] = (other.all(axis=0) & less.any(axis=0)).any(axis=1)
                kept = kept.filter(pa.array(~beaten)).combine_chunks()
        if kept is not None:
            yield from kept.to_batches()

    return df.mapInArrow(front, df.schema).repartition(1).mapInArrow(front, df.schema)


def by_rows(df: DataFrame, rows: str, name: str) -> DataFrame:
    """df in the order that reports have, by rows and then by name, with place from 1: a sort over all tasks."""
    from .ranks import ranked

    return ranked(df, [], [rows, name], "place").withColumn("place", F.col("place") + 1)


def consistent(df: DataFrame, keys: Sequence[str], signature: Sequence[str]) -> DataFrame:
    """(keys, signatures, consistent): whether all rows of a group agree in the columns of `signature`."""
    out = df.groupBy(*keys).agg(F.count_distinct(F.struct(*signature)).alias("signatures"))
    return out.withColumn("consistent", F.col("signatures") == 1)


def phases(df: DataFrame) -> DataFrame:
    """df with durations between the moments of a run, whose sum must be the total within a thousandth.

    df: data_ready, load, buffer, open, gpu_complete, render, frame (milliseconds).
    """
    c = F.col
    out = df.withColumns({
        "startup": c("data_ready") - c("load") - c("buffer"), "metadata_open": c("open"), "query": c("load") - c("open"), "color": c("buffer"),
        "scene_wait": c("gpu_complete") - c("data_ready") - c("render"), "render_gpu": c("render"), "frame_wait": c("frame") - c("gpu_complete"),
    })
    parts = [c(n) for n in ("startup", "metadata_open", "query", "color", "scene_wait", "render_gpu", "frame_wait")]
    total = parts[0] + parts[1] + parts[2] + parts[3] + parts[4] + parts[5] + parts[6]
    sound = (F.least(*parts) >= -0.001) & (F.abs(total - c("frame")) <= 0.001) & ~F.isnan(total)
    return out.withColumn("sound", sound)


def per_points(requests: Column, matched: Column) -> Column:
    """Requests for each 100,000 points matched; null where nothing matched."""
    return F.try_divide(requests, matched) * 100000


def bytes_per_point(size: Column, points: Column) -> Column:
    return size / F.greatest(points, F.lit(1))


def color_checksum(df: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum(F.coalesce("red", F.lit(0)) + F.coalesce("green", F.lit(0)) + F.coalesce("blue", F.lit(0))), F.lit(0))
    return df.agg((total % F.lit(4294967291)).cast("long").alias("checksum"))


def full_checksum(df: DataFrame) -> DataFrame:
    """(points, checksum): a sum of row hashes over all columns, which forces a full read and doesn't depend on order."""
    return df.agg(F.count(F.lit(1)).alias("points"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum"))


def nearest(df: DataFrame, value: str, target: Column, order: str) -> DataFrame:
    """The row whose value is nearest to the target; the first by `order` of equals."""
    return df.agg(F.min_by(F.struct(*df.columns), F.struct(F.abs(F.col(value) - target), F.col(order))).alias("r")).select("r.*")


def match_level(levels: DataFrame, depths: DataFrame, total: int, level: int | None = None, depth: int | None = None) -> tuple[int, int]:
    """Level and octree depth of like point counts: nearest to a quarter of all points, or to the one that is given.

    levels: resolution, row_end. depths: depth, cumulative_points.
    """
    def one(df: DataFrame, value: str, target: float, order: str) -> int:
        return nearest(df, value, F.lit(float(target)), order).first()[order]

    def at(df: DataFrame, value: str, order: str, n: int) -> float:
        return df.filter(F.col(order) == n).first()[value]

    if level is None and depth is None:
        return one(levels, "row_end", total / 4, "resolution"), one(depths, "cumulative_points", total / 4, "depth")
    if level is None:
        return one(levels, "row_end", at(depths, "cumulative_points", "depth", depth), "resolution"), depth
    if depth is None:
        return level, one(depths, "cumulative_points", at(levels, "row_end", "resolution", level), "depth")
    return level, depth


def octree_nodes(points: DataFrame, cube: Sequence[float], depth: int, xyz: Sequence[Column]) -> DataFrame:
    """(depth, ix, iy, iz, point_count) of an octree whose points sit at the depth of their source_index's bits: half at the deepest,
    a quarter above it, and so on. cube: least corner and edge, in the units of xyz."""
    trailing = F.least(F.length(F.regexp_extract(F.bin(F.col("source_index") + 1), "(0*)$", 1)), F.lit(depth))
    level = (F.lit(depth) - trailing).cast("int")
    cell = [F.floor((c - F.lit(float(cube[i]))) / F.lit(float(cube[3])) * F.pow(F.lit(2.0), level)) for i, c in enumerate(xyz)]
    keyed = points.select(level.alias("depth"), *[c.cast("long").alias(n) for c, n in zip(cell, ("ix", "iy", "iz"), strict=True)])
    return keyed.groupBy("depth", "ix", "iy", "iz").agg(F.count(F.lit(1)).alias("point_count"))


def cumulative_depths(nodes: DataFrame) -> DataFrame:
    """(depth, points, cumulative_points), depths without nodes included."""
    own = nodes.groupBy("depth").agg(F.sum("point_count").alias("points"))
    spine = own.agg(F.max("depth").alias("d")).select(F.explode(F.sequence(F.lit(0), F.col("d"))).alias("depth"))
    out = spine.join(own, "depth", "left").fillna(0, ["points"])
    return out.withColumn("cumulative_points", F.sum("points").over(W.orderBy("depth").rowsBetween(W.unboundedPreceding, 0)))


def node_bounds(nodes: DataFrame, cube: Sequence[float]) -> DataFrame:
    edge = F.lit(float(cube[3])) / F.pow(F.lit(2.0), F.col("depth"))
    new = {}
    for i, a in enumerate(("x", "y", "z")):
        new[f"wmin{a}"] = F.lit(float(cube[i])) + F.col(f"i{a}") * edge
        new[f"wmax{a}"] = F.lit(float(cube[i])) + (F.col(f"i{a}") + 1) * edge
    return nodes.withColumns(new)


def representative_center(points: DataFrame) -> DataFrame:
    """One row: on each axis the upper middle value, found by rank over all tasks rather than in one list."""
    from .ranks import ranked

    n = points.count()
    out = None
    for a in ("x", "y", "z"):
        one = ranked(points.select(a, "source_index"), [], [a, "source_index"], "k").filter(F.col("k") == n // 2).select(a)
        out = one if out is None else out.join(F.broadcast(one))  # one row each
    return out


def same_source(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """(same): one row: equal counts, and six bounds within tolerance. a, b: one row of n, minx .. maxz."""
    sides = [f"{m}{x}" for m in ("min", "max") for x in ("x", "y", "z")]
    renamed = b.select(*[F.col(c).alias(f"_{c}") for c in ("n", *sides)])
    near = F.col("n") == F.col("_n")
    for s in sides:
        near = near & (F.abs(F.col(s) - F.col(f"_{s}")) <= tolerance)
    return a.join(F.broadcast(renamed)).select(near.alias("same"))  # one row each


def reachable(pages: DataFrame, root: DataFrame) -> DataFrame:
    """(page) of all pages that links lead to from the root's, each once. pages: page, parent. root: page.

    A round for each depth: children of the last round's pages that weren't seen before. Rounds are written.
    """
    from ..plans.tables import written

    links = pages.select("page", "parent").distinct()
    seen = frontier = written(root.select("page").distinct())
    while frontier.limit(1).take(1):
        step = links.join(frontier.withColumnRenamed("page", "parent"), "parent").select("page").distinct()
        frontier = written(step.join(seen, "page", "left_anti"))
        seen = written(seen.unionByName(frontier))
    return seen
