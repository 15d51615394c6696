"""Which row groups a view needs, by screen-space error."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance, holds_point, overlaps
from ..plans.model import Box, pixel_scale
from .catalog import WORLD_HIGH, WORLD_LOW


@dataclass(frozen=True)
class View:
    position: tuple[float, float, float]
    viewport_height: float
    fov_degrees: float
    pixel_threshold: float
    point_budget: float

    def check(self) -> None:
        if not (self.viewport_height > 0 and self.fov_degrees > 0 and self.pixel_threshold >= 0 and self.point_budget > 0):
            raise ValueError("height, angle and budget must exceed 0, and the threshold can't be below it")


def activated(groups: DataFrame, errors: Sequence[float], box: Box, view: View, in_view: Callable[[Sequence[str], Sequence[str]], Column] | None = None) -> DataFrame:
    """groups that meet the box and the view, with activation (pixels of error that the level above leaves there; infinite
    for level 0), mandatory (level 0, or around the camera) and wanted (mandatory, or activation over the threshold).

    errors: geometric error of each level.
    """
    view.check()
    if not errors:
        raise ValueError("at least one level is required")
    seen = groups.filter(overlaps(box, WORLD_LOW, WORLD_HIGH))
    if in_view is not None:
        seen = seen.filter(in_view(WORLD_LOW, WORLD_HIGH))
    parent = F.element_at(F.array(*[F.lit(float(e)) for e in errors]), F.greatest(F.col("resolution").cast("int"), F.lit(1)))
    away = F.greatest(distance(view.position, WORLD_LOW, WORLD_HIGH), F.lit(1e-6))
    activation = F.when(F.col("resolution") == 0, F.lit(math.inf)).otherwise(parent * F.lit(pixel_scale(view.viewport_height, view.fov_degrees)) / away)
    around = holds_point(view.position, WORLD_LOW, WORLD_HIGH)
    out = seen.withColumn("activation", activation).withColumn("mandatory", (F.col("resolution") == 0) | around)
    return out.withColumn("wanted", F.col("mandatory") | (F.col("activation") > view.pixel_threshold))


def selected(groups: DataFrame, errors: Sequence[float], box: Box, view: View, in_view: Callable[[Sequence[str], Sequence[str]], Column] | None = None) -> DataFrame:
    """(index, resolution, point_count, activation) of the groups to read.

    Most needed first, a group that would pass the point budget is left out and the next one tried; mandatory groups
    always count. That is no running sum: the sorted catalogue, a row for each quarter million points, streams through one task, which
    holds the total and nothing else.
    """
    budget, names = view.point_budget, ["index", "resolution", "point_count", "activation"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            fits = []
            for n, needed in zip(batch.column("point_count").to_pylist(), batch.column("mandatory").to_pylist(), strict=True):
                fits.append(needed or total + n <= budget)
                total += n if fits[-1] else 0
            yield batch.filter(pa.array(fits, pa.bool_())).select(names)

    wanted = activated(groups, errors, box, view, in_view).filter("wanted").select(*names, "mandatory")
    ordered = wanted.repartition(1).sortWithinPartitions(F.desc("activation"), "resolution", "index")
    return ordered.mapInArrow(fold, ordered.select(*names).schema)


def summary(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: groups, points and finest level of a selection, and the greatest finite activation met."""
    near = candidates.filter("resolution > 0").agg(F.coalesce(F.max("activation"), F.lit(0.0)).alias("nearest_activation"))
    totals = chosen.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("point_count"), F.lit(0)).alias("points"), F.coalesce(F.max("resolution"), F.lit(0)).cast("int").alias("max_resolution"))
    return totals.join(F.broadcast(near))  # one row each


def by_level(chosen: DataFrame, levels: int) -> DataFrame:
    """(resolution, groups, points) of a selection, every level."""
    spine = chosen.sparkSession.range(levels).select(F.col("id").cast("tinyint").alias("resolution"))
    own = chosen.groupBy("resolution").agg(F.count(F.lit(1)).alias("groups"), F.sum("point_count").alias("points"))
    return spine.join(own, "resolution", "left").fillna(0, ["groups", "points"])


def selection_key(chosen: DataFrame, box: Box) -> DataFrame:
    """One row, key: the chosen indices and the box; equal keys mean that nothing new is to be read."""
    corners = ",".join(repr(float(v)) for v in (*box.min, *box.max))
    return chosen.agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("index")), lambda i: i.cast("string"))).alias("ids")).select(F.concat_ws("|", "ids", F.lit(corners)).alias("key"))


class Loaded:
    """Row groups' points that a viewer holds: replaced, retained and united by group. Frames stay lazy."""

    def __init__(self) -> None:
        self.frames: dict[int, DataFrame] = {}
        self.points: dict[int, int] = {}

    def replace(self, group: int, points: DataFrame, count: int) -> None:
        """Puts a group's points in; a group without points goes."""
        self.frames.pop(group, None)
        self.points.pop(group, None)
        if count:
            self.frames[group], self.points[group] = points, count

    def retain(self, groups: Sequence[int]) -> None:
        for g in set(self.frames) - set(groups):
            del self.frames[g], self.points[g]

    def union(self) -> DataFrame | None:
        out = None
        for _, f in sorted(self.frames.items()):
            out = f if out is None else out.unionByName(f)
        return out


def replaced(held: DataFrame, new: DataFrame) -> DataFrame:
    """The same on tables with row_group: rows of `new` in place of those of its groups."""
    return held.join(new.select("row_group").distinct(), "row_group", "left_anti").unionByName(new)


def retained(held: DataFrame, groups: DataFrame) -> DataFrame:
    return held.join(groups.select("row_group").distinct(), "row_group", "left_semi")
