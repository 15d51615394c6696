"""Registered queries over the driver's tables, each with the same in DuckDB SQL where SQL can say it.

"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, geometry, hash64, voxel
from ..operators import analysis, catalog, levels, packing, selection
from ..sources import las
from ..sources.files import footers
from ..sources.points import EVENTS_SQL, STORED, UNSIGNED, VIEW, broken, complete, events_points, lineitem_points
from ..streaming.progressive import gathered
from . import layout
from .cloud import PointCloud
from .model import AXES, Box, Metadata, Transform, fit_distance, pixel_scale, query_set, voxel_width
from .tables import discard_at_exit, shared_folder, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BOX = Box((20000, 10000, 1000), (90000, 60000, 30000))
WORLD = Box((200.004, 99.996, 10.0), (900.0, 600.0, 300.0))
RATIO, LEVELS, GROUP, PAGE = 32, 4, 512, 64
LEVEL = 2
VIEWER = selection.View((700.0, 400.0, 500.0), 1080.0, 60.0, 40.0, 6000.0)
ERRORS = [math.sqrt(3) * 0.01 * RATIO ** (LEVELS - 1 - r) if r < LEVELS - 1 else 0.0 for r in range(LEVELS)]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# The layout that many queries share, once for each session and input.
_layouts: dict[tuple[str, str], DataFrame] = {}


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _layouts:
        points = events_points(spark, sf_dir)
        out = levels.with_levels(points, levels.cloud_bounds(points), VIEW, RATIO, LEVELS)
        _layouts[key] = written(packing.pack_pages(packing.pack_levels(written(out), GROUP), PAGE))
    return _layouts[key]


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.row_groups(packed(spark, sf_dir), VIEW, RATIO, LEVELS)


def stored(spark: SparkSession, sf_dir: str) -> PointCloud:
    key = (spark.sparkContext.applicationId, f"{sf_dir}#stored")
    if key not in _layouts:
        path = f"{shared_folder(spark)}/clouds/{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
        points = packed(spark, sf_dir).withColumn("place", F.col("page_place")).drop("page_place")
        bounds = levels.cloud_bounds(points)
        counts = levels.level_counts(points, LEVELS)
        ends = [r["row_group_end"] for r in levels.row_group_ends(counts, GROUP).orderBy("resolution").collect()]
        meta = Metadata(VIEW.scale, VIEW.offset, (*VIEW.decode(bounds.min), *VIEW.decode(bounds.max)), tuple(ends), RATIO)
        sizes = tuple(r["point_count"] for r in counts.orderBy("resolution").collect())
        layout.write(layout.Packed(points, meta, layout.LayoutOptions(RATIO, levels=LEVELS, row_group_size=GROUP, page_rows=PAGE), sizes), path)
        discard_at_exit(spark, path)
        _layouts[key] = path  # type: ignore[assignment]
    return PointCloud(spark, _layouts[key])  # type: ignore[arg-type]


def _xyz(fmt: str, sep: str = ", ") -> str:
    return sep.join(fmt.format(a=a, i=i) for i, a in enumerate(AXES))


def _level_sql() -> str:
    """pts, then lv: pts with resolution."""
    steps = [f"pts as ({EVENTS_SQL})", f"b as (select {_xyz('min({a})::bigint as o{a}')} from pts)"]
    rest = "pts"
    for r in range(LEVELS - 1):
        e = LEVELS - 1 - r
        width = float(voxel_width(RATIO, e))
        steps.append(f"r{r} as (select {rest}.*, {_xyz('floor(({a}::bigint - o{a})::double * 1.0 / ' + repr(width) + ')::bigint as v{a}')} from {rest}, b)")
        steps.append(hash64.priority_sql(f"r{r}", f"p{r}", e))
        steps.append(f"n{r} as (select *, row_number() over (partition by vx, vy, vz order by priority, source_index) as k from p{r})")
        steps.append(f"c{r} as (select * exclude (vx, vy, vz, priority, k), {r}::tinyint as resolution from n{r} where k = 1)")
        steps.append(f"rest{r} as (select * exclude (vx, vy, vz, priority, k) from n{r} where k > 1)")
        rest = f"rest{r}"
    chosen = " union all ".join(f"select * from c{r}" for r in range(LEVELS - 1))
    steps.append(f"lv as ({chosen} union all select *, {LEVELS - 1}::tinyint from {rest})")
    return ",\n".join(steps)


def _pack_sql(source: str, out: str, group: str, capacity: int, name: str) -> str:
    """`out`: source with `name`, by three rounds of ranks."""

    def root(n: str, power: int) -> str:
        k = f"round(pow({n}, {1 / power!r}))::bigint"
        reach = lambda x: f"({' * '.join([x] * power)} >= {n})"
        return f"case when {k} > 1 and {reach(f'({k} - 1)')} then {k} - 1 when {reach(k)} then {k} else {k} + 1 end"

    def slab(leaf: str, n: str, k: str) -> str:
        return f"case when {leaf} < ({n} % {k}) * ({n} // {k} + 1) then {leaf} // ({n} // {k} + 1) else {n} % {k} + ({leaf} - ({n} % {k}) * ({n} // {k} + 1)) // greatest({n} // {k}, 1) end"

    up = lambda n: f"(({n} + {capacity - 1}) // {capacity})"
    return f"""{out}1 as (select *, (row_number() over (partition by {group} order by x, y, z, source_index) - 1) // {capacity} as l1, {up(f'count(*) over (partition by {group})')} as n1 from {source}),
{out}2 as (select *, {root('n1', 3)} as k1 from {out}1),
{out}3 as (select *, {slab('l1', 'n1', 'k1')} as s1 from {out}2),
{out}4 as (select *, min(l1) over w as f1, (row_number() over (partition by {group}, s1 order by y, x, z, source_index) - 1) // {capacity} as l2, {up('count(*) over w')} as n2 from {out}3 window w as (partition by {group}, s1)),
{out}5 as (select *, {root('n2', 2)} as k2 from {out}4),
{out}6 as (select *, {slab('l2', 'n2', 'k2')} as s2 from {out}5),
{out}7 as (select *, min(l2) over w as f2, (row_number() over (partition by {group}, s1, s2 order by z, x, y, source_index) - 1) as l3 from {out}6 window w as (partition by {group}, s1, s2)),
{out} as (select * exclude (l1, n1, k1, s1, f1, l2, n2, k2, s2, f2, l3), (f1 + f2 + l3 // {capacity})::bigint as {name}, (l3 % {capacity})::int as {name}_place from {out}7)"""


POINTS = f"with pts as ({EVENTS_SQL})\n"
LEVELED = f"with {_level_sql()}\n"
PACKED = f"with {_level_sql()},\n{_pack_sql('lv', 'rg', 'resolution', GROUP, 'row_group')},\n{_pack_sql('rg', 'pk', 'resolution, row_group', PAGE, 'page')}\n"
_DIAGONAL = " ".join(f"when {r} then {e!r}" for r, e in enumerate(ERRORS))
_BOUNDS = ", ".join(f"min({a}) as min{a}, max({a}) as max{a}" for a in AXES)
_WORLD = ", ".join(f"min{a}::double * 0.01 + 0.0 as wmin{a}, max{a}::double * 0.01 + 0.0 as wmax{a}" for a in AXES)
GROUPS = PACKED + f""",
g0 as (select resolution, row_group, count(*) as point_count, {_BOUNDS} from pk group by all),
g as (select *, (row_number() over (order by resolution, row_group) - 1)::int as index, (sum(point_count) over (order by resolution, row_group))::bigint as row_end,
  case resolution {_DIAGONAL} end::double as geometric_error, {_WORLD} from g0)
"""


def _between(box: Box) -> str:
    return " and ".join(f"{a} between {lo} and {hi}" for a, lo, hi in zip(AXES, box.min, box.max, strict=True))


def _meets(box: Box, prefix: str = "") -> str:
    return " and ".join(f"{prefix}max{a} >= {lo} and {prefix}min{a} <= {hi}" for a, lo, hi in zip(AXES, box.min, box.max, strict=True))


# Points: projections and scalar expressions


@query(POINTS + "select source_index, " + _xyz("{a}::double * 0.01 + 0.0 as w{a}") + " from pts")
def p1_decode_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_points(spark, sf_dir).select("source_index", *geometry.decoded(VIEW))


@query("select " + ", ".join(f"ceil({v!r} / 0.01)::bigint as min{a}" for a, v in zip(AXES, WORLD.min, strict=True)) + ", " + ", ".join(f"floor({v!r} / 0.01)::bigint as max{a}" for a, v in zip(AXES, WORLD.max, strict=True)))
def p2_quantize_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = VIEW.quantize(WORLD)
    return spark.createDataFrame([(*q.min, *q.max)], ", ".join(f"{m}{a} long" for m in ("min", "max") for a in AXES))


@query(GROUPS + "select index, " + ", ".join(f"wmin{a}, wmax{a}" for a in AXES) + " from g")
def p3_decode_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).select("index", *[f"w{m}{a}" for a in AXES for m in ("min", "max")])


@query(POINTS + "select source_index, coalesce(red, 0) as red, coalesce(green, 0) as green, coalesce(blue, 0) as blue from pts")
def p4_null_color_is_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_points(spark, sf_dir).select("source_index", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("red", "green", "blue")])


@query("select 0.5::double as sx, 1.0::double as sy, 0.25::double as sz, 9223372036854775807::bigint as width")
def p5_p6_scales_and_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(*Transform((0.02, 0.04, 0.01)).normalized, voxel_width(32, 40))], "sx double, sy double, sz double, width long")


@query(POINTS + ", b as (select " + _xyz("min({a})::bigint as o{a}") + " from pts) select source_index, " + _xyz("floor(({a}::bigint - o{a})::double * 1.0 / 1024.0)::bigint as v{a}") + " from pts, b")
def p7_voxel_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events_points(spark, sf_dir)
    return points.select("source_index", *voxel.voxel(levels.cloud_bounds(points), VIEW, RATIO, 2))


@query(POINTS + ", i as (select source_index, source_index::ubigint as h from pts),\n" + hash64.splitmix64_sql("h", "i", "o", "h") + "\nselect source_index, h::varchar as h from o")
def p8_splitmix64(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hash64.with_splitmix64(events_points(spark, sf_dir).select("source_index", F.col("source_index").alias("h")), "h")
    return out.select("source_index", F.conv(F.hex("h"), 16, 10).alias("h"))


@query(POINTS + ",\n" + hash64.priority_sql("pts", "o", 3) + "\nselect source_index, priority::varchar as priority from o")
def p9_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hash64.with_priority(events_points(spark, sf_dir), 3)
    return out.select("source_index", F.conv(F.hex(hash64.unsigned_order(F.col("priority"))), 16, 10).alias("priority"))


@query()
def p10_p11_hilbert_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit steps that depend on each other: the tests hold it against neighbouring cells and a row by row version."""
    return packing.with_place(packed(spark, sf_dir), "hilbert").select("source_index", "resolution", "row_group", "page", "place")


@query("select * from (values " + ", ".join(f"({r}::tinyint, {e!r}::double)" for r, e in enumerate(ERRORS)) + ") t(resolution, geometric_error)")
def p12_voxel_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(LEVELS).select(F.col("id").cast("tinyint").alias("resolution"))
    return rows.withColumn("geometric_error", voxel.voxel_diagonal(0.01, RATIO, LEVELS, F.col("resolution")))


_SRGB = "(case when {c} <= 0.04045 then {c} / 12.92 else pow(({c} + 0.055) / 1.055, 2.4) end)"


@query(POINTS + "select source_index, round(" + _SRGB.format(c="(coalesce(red, 0) / 65535.0)") + ", 9) as linear, round((case when coalesce(red, 0) / 65535.0 <= 0.0031308 then coalesce(red, 0) / 65535.0 * 12.92 else 1.055 * pow(red / 65535.0, 1 / 2.4) - 0.055 end), 9) as srgb from pts")
def p13_p20_srgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all points; one without a colour is black, as everywhere."""
    c = F.coalesce("red", F.lit(0)) / F.lit(65535.0)
    return events_points(spark, sf_dir).select("source_index", F.round(color.srgb_to_linear(c), 9).alias("linear"), F.round(color.linear_to_srgb(c), 9).alias("srgb"))


@query(POINTS + "select source_index, round(0.5 * exp(-pow(z * 0.01 * 0.002, 2)) + 0.1 * (1 - exp(-pow(z * 0.01 * 0.002, 2))), 9) as shade from pts")
def p20_fog(spark: SparkSession, sf_dir: str) -> DataFrame:
    shade = color.fog(F.lit(0.5), 0.1, 0.002, F.col("z") * F.lit(0.01))
    return events_points(spark, sf_dir).select("source_index", F.round(shade, 9).alias("shade"))


def _ramp_sql(t: str, channel: int) -> str:
    parts = [f"when {t} <= {color.RAMP[0][0]!r} then {color.RAMP[0][channel]!r}::double"]
    for left, right in zip(color.RAMP[:-1], color.RAMP[1:], strict=True):
        parts.append(f"when {t} <= {right[0]!r} then {left[channel]!r}::double + {right[channel] - left[channel]!r}::double * (({t} - {left[0]!r}::double) / {right[0] - left[0]!r}::double)")
    return f"(case {' '.join(parts)} else {color.RAMP[-1][channel]!r}::double end)"


_T = "(greatest(0.0, least(1.0, (z - 1000.0) / 30000.0)))"


@query(POINTS + "select source_index, " + ", ".join(f"round({_ramp_sql(_T, k)}, 9) as {n}" for k, n in ((1, "r"), (2, "g"), (3, "b"))) + " from pts")
def p14_elevation_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = color.elevation((F.col("z") - F.lit(1000.0)) / F.lit(30000.0))
    return events_points(spark, sf_dir).select("source_index", *[F.round(c, 9).alias(n) for c, n in zip(rgb, "rgb", strict=True)])


@query("with p as (select * from (values " + ", ".join(f"({i}, {r!r}::double, {g!r}::double, {b!r}::double)" for i, (r, g, b) in enumerate(color.PALETTE)) + ") t(i, r, g, b)) select n::bigint as resolution, r, g, b from range(20) s(n) join p on i = n % 8")
def p15_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(20).select(F.col("id").alias("resolution"), *[c.alias(n) for c, n in zip(color.level_color(F.col("id")), "rgb", strict=True)])


def _color_sql(c: str, channel: int) -> str:
    t = "(greatest(0.0, least(1.0, (z - 0.0) / 49000.0)))"
    lit = "(coalesce(red, 0) <> 0 or coalesce(green, 0) <> 0 or coalesce(blue, 0) <> 0)"
    value = f"(coalesce({c}, 0) / 65535.0)"
    return f"case when {lit} then {_SRGB.format(c=value)} else {_ramp_sql(t, channel)} end"


@query(POINTS + "select source_index, " + ", ".join(f"round(({_color_sql(c, k)})::float::double, 5) as {n}" for k, (c, n) in enumerate((("red", "cr"), ("green", "cg"), ("blue", "cb")), 1)) + " from pts")
def p16_point_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_points(spark, sf_dir).select("source_index", *color.point_color("rgb", 0, 49000))
    return rows.select("source_index", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("cr", "cg", "cb")])


_DIST = "sqrt(" + " + ".join(f"pow(greatest(wmin{a} - {p!r}, {p!r} - wmax{a}, 0.0), 2)" for a, p in zip(AXES, VIEWER.position, strict=True)) + ")"


@query(GROUPS + f"select index, round({_DIST}, 9) as distance from g")
def p17_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geometry.distance(VIEWER.position, catalog.WORLD_LOW, catalog.WORLD_HIGH)
    return groups(spark, sf_dir).select("index", F.round(d, 9).alias("distance"))


@query(f"select round({VIEWER.viewport_height!r} / (2 * tan({VIEWER.fov_degrees!r} * pi() / 360)), 9) as pixel_scale")
def p18_pixel_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(pixel_scale(VIEWER.viewport_height, VIEWER.fov_degrees), 9),)], "pixel_scale double")


ORIGIN = (12.5, -3.25, 100.0)


@query(POINTS + "select source_index, " + ", ".join(f"round({a}::double * 0.01 - {o!r}::double, 6) as l{a}" for a, o in zip(AXES, ORIGIN, strict=True)) + " from pts")
def p19_local_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL takes the direct way, from which the one by the middle differs in the last digits only."""
    points = events_points(spark, sf_dir)
    local = geometry.local_decoded(VIEW, levels.cloud_bounds(points), ORIGIN)
    return points.select("source_index", *local).select("source_index", *[F.round(f"l{a}", 6).alias(f"l{a}") for a in AXES])


@query(GROUPS + "select index, 18.0 * point_count / greatest(point_count, 1) as bytes_per_point from g")
def p21_bytes_per_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).select("index", analysis.bytes_per_point(F.lit(18.0) * F.col("point_count"), F.col("point_count")).alias("bytes_per_point"))


@query(POINTS + "select source_index, " + _xyz("floor(({a}::double * 0.01 - 0.25) / 0.05 + 0.5)::bigint as q{a}") + " from pts")
def p22_requantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events_points(spark, sf_dir)
    return points.select("source_index", *[geometry.requantized(F.col(a).cast("double") * F.lit(0.01), 0.05, 0.25).alias(f"q{a}") for a in AXES])


@query(POINTS + "select (sum(coalesce(red, 0) + coalesce(green, 0) + coalesce(blue, 0)) % 4294967291)::bigint as checksum from pts")
def p23_color_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.color_checksum(events_points(spark, sf_dir))


def _query_set_sql() -> str:
    from .model import QUERY_SET

    out = []
    for name, f in QUERY_SET.items():
        cols = []
        for a, k in zip(AXES, f, strict=True):
            start = f"least(greatest(c{a} - (hi{a} - lo{a}) * {k!r}::double / 2, lo{a}), hi{a} - (hi{a} - lo{a}) * {k!r}::double)"
            cols.append(f"round({start}, 6) as min{a}, round({start} + (hi{a} - lo{a}) * {k!r}::double, 6) as max{a}")
        out.append(f"select '{name}' as query, {', '.join(cols)} from e, m")
    extent = _xyz("min({a}) * 0.01::double as lo{a}, max({a}) * 0.01::double as hi{a}")
    middle = _xyz("list_sort(list({a}))[count(*) // 2 + 1] * 0.01::double as c{a}")
    return POINTS + f", e as (select {extent} from pts), m as (select {middle} from pts) " + " union all ".join(out)


@query(_query_set_sql())
def p24_l9_l10_query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events_points(spark, sf_dir)
    bounds, center = levels.cloud_bounds(points), analysis.representative_center(points).first()
    extent = Box(tuple(v * 0.01 for v in bounds.min), tuple(v * 0.01 for v in bounds.max))
    boxes = query_set(extent, [center[a] * 0.01 for a in AXES])
    rows = [(n, *[round(v, 6) for p in zip(b.min, b.max, strict=True) for v in p]) for n, b in boxes.items()]
    return spark.createDataFrame(rows, "query string, " + ", ".join(f"min{a} double, max{a} double" for a in AXES))


@query(POINTS + "select classification, case when count(*) filter (z < 2000) = 0 then null else count(*)::double / count(*) filter (z < 2000) * 100000 end as calls from pts group by all")
def p25_calls_per_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_points(spark, sf_dir).groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("z") < 2000).alias("m"))
    return rows.select("classification", analysis.per_points(F.col("n"), F.col("m")).alias("calls"))


# tenths of thousands and of millions by whole numbers, halves up; printf of doubles is exact, and those halfway go up
_TENTHS = "({r} // 10)::varchar || case when {r} % 10 = 0 then '' else '.' || ({r} % 10)::varchar end"
_K, _M = "((v + 50) // 100)", "((v + 50000) // 100000)"


@query(
    POINTS + ", n as (select source_index, x::bigint as v from pts) select source_index, "
    f"case when v < 1000 then v::varchar when {_K} < 10000 then {_TENTHS.format(r=_K)} || 'k' else {_TENTHS.format(r=_M)} || 'm' end as short, "
    "case when v < 1000 then v::varchar || ' B' when v < 1000000 then printf('%.1f', v / 1000.0::double + case when v % 1000 = 250 then 0.01 else 0 end) || ' kB' "
    "else printf('%.2f', v / 1000000.0::double + case when v % 1000000 in (125000, 625000) then 0.001 else 0 end) || ' MB' end as bytes, "
    "format('{:,}', v) as whole, regexp_replace(regexp_replace(printf('%.6f', v / 7.0::double), '0+$', ''), '[.]$', '') as coordinate from n"
)
def p26_short_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    shown = {"short": geometry.short_number(x), "bytes": geometry.short_bytes(x), "whole": geometry.grouped_integer(x), "coordinate": geometry.coordinate(x / F.lit(7.0))}
    return events_points(spark, sf_dir).select("source_index", *[c.alias(n) for n, c in shown.items()])


_SELECTED = GROUPS + f""",
errs as (select * from (values {", ".join(f"({r}, {e!r}::double)" for r, e in enumerate(ERRORS))}) t(r, e)),
seen as (select g.*, case when resolution = 0 then 'infinity'::double else (select e from errs where r = resolution - 1) * {pixel_scale(VIEWER.viewport_height, VIEWER.fov_degrees)!r}::double / greatest({_DIST}, 1e-6) end as activation,
  resolution = 0 or ({" and ".join(f"{p!r} between wmin{a} and wmax{a}" for a, p in zip(AXES, VIEWER.position, strict=True))}) as mandatory from g where {_meets(WORLD, "w")}),
wanted as (select *, row_number() over (order by activation desc, resolution, index) as k from seen where mandatory or activation > {VIEWER.pixel_threshold!r}),
walk(k, total, took, index) as (
  select 0::bigint, 0::bigint, false, -1 union all
  select w.k, case when w.mandatory or walk.total + w.point_count <= {VIEWER.point_budget!r} then walk.total + w.point_count else walk.total end::bigint,
    w.mandatory or walk.total + w.point_count <= {VIEWER.point_budget!r}, w.index from walk join wanted w on w.k = walk.k + 1),
chosen as (select w.* from wanted w join walk on walk.k = w.k where took)
"""
_SELECTED = _SELECTED.replace("with pts", "with recursive pts", 1)


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.selected(groups(spark, sf_dir), ERRORS, WORLD, VIEWER)


@query(_SELECTED + "select index, resolution, point_count from chosen")
def l5_select_by_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir).select("index", "resolution", "point_count")


@query(_SELECTED + "select coalesce(string_agg(index::varchar, ',' order by index), '') || '|" + ",".join(repr(float(v)) for v in (*WORLD.min, *WORLD.max)) + "' as key from chosen")
def p27_selection_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.selection_key(_chosen(spark, sf_dir), WORLD)


@query(_SELECTED + f", s as (select * from range({LEVELS}) t(r)) select r::tinyint as resolution, count(index) as groups, coalesce(sum(point_count), 0)::bigint as points from s left join chosen on resolution = r group by r")
def a21_selection_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.by_level(_chosen(spark, sf_dir), LEVELS)


@query(_SELECTED + "select count(*) as groups, coalesce(sum(point_count), 0)::bigint as points, coalesce(max(resolution), 0)::int as max_resolution, (select round(coalesce(max(activation), 0), 6) from seen where resolution > 0) as nearest_activation from chosen")
def l5_selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(spark, sf_dir)
    out = selection.summary(_chosen(spark, sf_dir), selection.activated(g, ERRORS, WORLD, VIEWER))
    return out.withColumn("nearest_activation", F.round("nearest_activation", 6))


@query(POINTS + ", e as (select " + _xyz("min({a}) * 0.01::double as lo{a}, max({a}) * 0.01::double as hi{a}") + " from pts), r as (select *, sqrt(pow(hix - lox, 2) + pow(hiy - loy, 2) + pow(hiz - loz, 2)) / 2 as radius from e) select " + _xyz("round((lo{a} + hi{a}) / 2, 6) as c{a}") + ", round(radius, 6) as radius, round(radius / sin(radians(60) / 2), 6) as fit from r")
def p28_bounding_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = levels.cloud_bounds(events_points(spark, sf_dir))
    box = Box(tuple(v * 0.01 for v in b.min), tuple(v * 0.01 for v in b.max))
    row = (*box.center, box.sphere_radius, fit_distance(box, 60))
    return spark.createDataFrame([tuple(round(v, 6) for v in row)], "cx double, cy double, cz double, radius double, fit double")


def _edges_sql() -> str:
    out = []
    for axis in range(3):
        a, b = [k for k in range(3) if k != axis]
        for side in range(4):
            for end in range(2):
                corner = [0, 0, 0]
                corner[axis], corner[a], corner[b] = end, side & 1, side >> 1
                out.append(f"select index, {axis * 4 + side} as edge, {end} as \"end\", " + ", ".join(f"w{'max' if c else 'min'}{AXES[k]} as {AXES[k]}" for k, c in enumerate(corner)) + " from g")
    return GROUPS + " union all ".join(out)


@query(_edges_sql())
def p29_box_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).select("index", F.explode(geometry.box_edges(catalog.WORLD_LOW, catalog.WORLD_HIGH)).alias("e")).select("index", "e.*")


# Filters and queries

_RGB = "coalesce(red, 0) as red, coalesce(green, 0) as green, coalesce(blue, 0) as blue"


@query(POINTS + f"select source_index, x, y, z from pts where {_between(BOX)}")
def f1_f2_point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_points(spark, sf_dir).filter(geometry.inside(BOX)).select("source_index", "x", "y", "z")


@query(PACKED + f"select source_index, resolution from pk where resolution <= {LEVEL}")
def f3_level_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).points.filter(F.col("resolution") <= LEVEL).select("source_index", F.col("resolution").cast("tinyint").alias("resolution"))


_INSIDE = " and ".join(f"min{a} >= {lo} and max{a} <= {hi}" for a, lo, hi in zip(AXES, BOX.min, BOX.max, strict=True))


@query(GROUPS + f"select index, point_count, ({_INSIDE}) as contained from g where resolution <= {LEVEL} and {_meets(BOX)}")
def f4_f6_candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.candidates(groups(spark, sf_dir), BOX, LEVEL).select("index", "point_count", "contained")


@query(GROUPS + f", p as (select resolution, row_group, page, count(*) as point_count, {_BOUNDS} from pk group by all) select g.index, page, p.point_count from p join g using (resolution, row_group) where resolution <= {LEVEL} and {_meets(BOX, 'p.')} and not ({_INSIDE.replace('min', 'g.min').replace('max', 'g.max')})")
def f5_candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are pruned only in groups that the box doesn't hold."""
    g = groups(spark, sf_dir)
    partly = catalog.candidates(g, BOX, LEVEL).filter("not contained").select("index")
    p = catalog.pages(packed(spark, sf_dir), g, VIEW).join(partly, "index", "left_semi")
    return p.filter(geometry.overlaps(BOX, catalog.LOW, catalog.HIGH)).select("index", "page", "point_count")


@query(GROUPS + f"select g.index, x, y, z, {_RGB} from pk join g using (resolution, row_group) where index in (1, 2, 3) and {_between(VIEW.quantize(WORLD))}")
def f7_q3_given_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = stored(spark, sf_dir)
    found = cloud.query_row_groups([3, 1, 2, 1], WORLD)
    return found.join(cloud.groups.select("resolution", "row_group", "index"), ["resolution", "row_group"]).select("index", "x", "y", "z", "red", "green", "blue")


@query(GROUPS + f"select index from g where {_meets(WORLD, 'w')}")
def f8_box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).filter(geometry.overlaps(WORLD, catalog.WORLD_LOW, catalog.WORLD_HIGH)).select("index")


@query(GROUPS + "select index from g where " + " and ".join(f"{p!r} between wmin{a} and wmax{a}" for a, p in zip(AXES, (700.0, 400.0, 50.0), strict=True)))
def f9_point_in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).filter(geometry.holds_point((700.0, 400.0, 50.0), catalog.WORLD_LOW, catalog.WORLD_HIGH)).select("index")


PLANES = ((1.0, 0.2, 0.0, -500.0), (-1.0, 0.0, 0.5, 1200.0), (0.0, 1.0, 0.0, -100.0), (0.0, -1.0, 0.0, 700.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, -1.0, 200.0))
_FRUSTUM = " and ".join("(" + f"{d!r}" + "".join(f" + {k!r}::double * w{'max' if k >= 0 else 'min'}{a}" for k, a in zip(abc, AXES, strict=True)) + " >= 0)" for *abc, d in PLANES)


@query(GROUPS + f"select index from g where {_FRUSTUM}")
def f10_frustum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).filter(geometry.in_frustum(PLANES, catalog.WORLD_LOW, catalog.WORLD_HIGH)).select("index")


@query("select 0::bigint as row_group, 0::int as resolution, 0::int as x, 0::int as y, 0::int as z, 0::int as red, 0::int as green, 0::int as blue where false")
def f11_empty_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).query_world(Box((5.0, 5.0, 5.0), (1.0, 9.0, 9.0)), LEVEL)


@query(PACKED + f"select row_group, resolution::int as resolution, x, y, z, {_RGB} from pk where resolution <= {LEVEL} and {_between(VIEW.quantize(WORLD))}")
def q1_query_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).query_world(WORLD, LEVEL)


@query(PACKED + f"select row_group, resolution::int as resolution, x, y, z, {_RGB} from pk where {_between(BOX)}")
def q2_s11_query_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).query_quantized(BOX, LEVELS - 1)


@query(GROUPS + f", h as (select *, resolution <= {LEVEL} and {_meets(BOX)} as hit from g) select count(*) as row_groups_total, count(*) filter (hit) as row_groups_read, count(*) filter (not hit) as row_groups_pruned, (coalesce(sum(point_count) filter (hit), 0))::bigint as points_in_candidate_row_groups, (select count(*) from pk where resolution <= {LEVEL} and {_between(BOX)}) as points_matched from h")
def q4_a20_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).metrics(BOX, LEVEL)


@query(GROUPS + f"select count(*) as row_groups_read, coalesce(sum(point_count), 0)::bigint as points_in_candidate_row_groups from g where resolution <= {LEVEL} and {_meets(BOX)}")
def q5_a6_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).plan(BOX, LEVEL)


@query(GROUPS + f"select g.index, resolution, page, p.point_count, {', '.join(f'p.{m}{a}' for m in ('min', 'max') for a in AXES)} from (select resolution, row_group, page, count(*) as point_count, {_BOUNDS} from pk group by all) p join g using (resolution, row_group)")
def q6_page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stored(spark, sf_dir).pages()
    return p.select("index", F.col("resolution").cast("tinyint").alias("resolution"), "page", "point_count", *[f"{m}{a}" for m in ("min", "max") for a in AXES])


@query(PACKED + f"select resolution::int as resolution, count(*) as points from pk where resolution <= {LEVEL} and {_between(BOX)} group by all")
def q7_q8_progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results come group by group and are added to a table, so no plan grows with their number."""
    cloud = stored(spark, sf_dir)
    found = gathered(cloud, BOX, LEVEL, f"{shared_folder(spark)}/tables/progressive-{uuid.uuid4().hex}")
    discard_at_exit(spark, found.inputFiles()[0].rpartition("/")[0])
    return found.groupBy("resolution").agg(F.count(F.lit(1)).alias("points"))


@query(GROUPS + f"select index, resolution, point_count, row_end - point_count as row_start, row_end, geometric_error, {', '.join(f'{m}{a}' for m in ('min', 'max') for a in AXES)} from g")
def q9_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).select("index", "resolution", "point_count", "row_start", "row_end", "geometric_error", *catalog.LOW, *catalog.HIGH)


@query(GROUPS + f", l as (select r::tinyint as resolution, count(index) as n, coalesce(sum(point_count), 0)::bigint as point_count, {', '.join(f'min(wmin{a}) as wmin{a}, max(wmax{a}) as wmax{a}' for a in AXES)} from range({LEVELS}) t(r) left join g on resolution = r group by r) select resolution, point_count, {', '.join(f'wmin{a}, wmax{a}' for a in AXES)}, case resolution {_DIAGONAL} end::double as geometric_error, sum(n) over w::bigint as row_group_end, (sum(n) over w - n)::bigint as row_group_start, sum(point_count) over w::bigint as row_end, (sum(point_count) over w - point_count)::bigint as row_start from l window w as (order by resolution)".replace("sum(n) over w::bigint", "(sum(n) over w)::bigint").replace("sum(point_count) over w::bigint", "(sum(point_count) over w)::bigint"))
def q10_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.resolutions(groups(spark, sf_dir), VIEW, RATIO, LEVELS)


@query(GROUPS + f"select {', '.join(f'min(wmin{a}) as wmin{a}, max(wmax{a}) as wmax{a}' for a in AXES)} from g where resolution <= 1")
def q11_union_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.union_bounds(groups(spark, sf_dir).filter("resolution <= 1"))


@query(PACKED + "select source_index, " + ", ".join(f"(case (resolution % 8) {' '.join(f'when {i} then {c[k]!r}' for i, c in enumerate(color.PALETTE))} end)::float as {n}" for k, n in enumerate(("cr", "cg", "cb"))) + f" from pk where {_between(BOX)}")
def q12_recolor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one query are kept; another colour mode reads those, not the cloud."""
    found = written(packed(spark, sf_dir).filter(geometry.inside(BOX)).select("source_index", "x", "y", "z", "red", "green", "blue", "resolution"))
    return found.select("source_index", *color.point_color("resolution", 0, 1))


@query(GROUPS + f"select index, {', '.join(f'greatest(min{a}, {lo}) as min{a}, least(max{a}, {hi}) as max{a}' for a, lo, hi in zip(AXES, BOX.min, BOX.max, strict=True))} from g where resolution <= {LEVEL} and {_meets(BOX)}")
def q13_clipped_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.candidates(groups(spark, sf_dir), BOX, LEVEL).select("index", *geometry.clipped(BOX, catalog.LOW, catalog.HIGH))


@query(GROUPS + f", p as (select index as row_group, source_index, x from pk join g using (resolution, row_group)) select row_group, source_index, x from p where row_group in (2, 4) union all select row_group, source_index, x from p where row_group = 3 and {_between(BOX).replace('x between', 'x between')} and false union all select row_group, source_index, -x from p where row_group = 3".replace(f"union all select row_group, source_index, x from p where row_group = 3 and {_between(BOX)} and false ", ""))
def q14_chunk_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups 1 to 4 are held; 3 is replaced; then 2, 3 and 4 are retained."""
    g = groups(spark, sf_dir).select("resolution", "row_group", "index")
    points = packed(spark, sf_dir).join(g, ["resolution", "row_group"]).select(F.col("index").alias("row_group"), "source_index", "x")
    held = points.filter(F.col("row_group").between(1, 4))
    new = points.filter("row_group = 3").withColumn("x", -F.col("x"))
    wanted = g.filter(F.col("index").isin(2, 3, 4)).select(F.col("index").alias("row_group"))
    return selection.retained(selection.replaced(held, new), wanted).select("row_group", "source_index", "x")


# Levels, packing, orders


_SPAN = "greatest(" + ", ".join(f"max({a})::bigint - min({a})::bigint" for a in AXES) + ")::double"


@query(POINTS + f"select (min(e) + 1)::int as levels from range(64) t(e), (select {_SPAN} * 1.0 as span from pts) where 2.0 ** e > span")
def l1_ladder_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the input's own cloud."""
    from .model import ladder_length

    return spark.createDataFrame([(ladder_length(levels.cloud_bounds(events_points(spark, sf_dir)), VIEW, 2),)], "levels int")


_OCCUPIED = POINTS + ", b as (select " + _xyz("min({a})::bigint as o{a}") + " from pts), " + "o as (" + " union all ".join(f"select {e} as e, count(distinct ({', '.join(f'floor(({a}::bigint - o{a})::double * 1.0 / {float(2**e)!r})' for a in AXES)})) as n from pts, b" for e in range(19)) + ")\n"


@query(_OCCUPIED + "select n::bigint as voxels from o where e = 14")
def l2_occupied_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events_points(spark, sf_dir)
    n = levels.occupied_voxels(points, levels.cloud_bounds(points), VIEW, 2, 14, 1_000_000)
    return spark.createDataFrame([(n,)], "voxels long")


@query(_OCCUPIED + "select (min(e) + 1)::int as levels from o where n <= 64")
def l3_level_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events_points(spark, sf_dir)
    return spark.createDataFrame([(levels.level_count(points, levels.cloud_bounds(points), VIEW, 2, 64),)], "levels int")


@query(LEVELED + "select source_index, resolution from lv")
def l4_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events_points(spark, sf_dir)
    return levels.with_levels(points, levels.cloud_bounds(points), VIEW, RATIO, LEVELS).select("source_index", "resolution")


@query(LEVELED + f"select r::tinyint as resolution, count(source_index) as point_count from range({LEVELS}) t(r) left join lv on resolution = r group by r")
def a3_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.level_counts(packed(spark, sf_dir), LEVELS)


@query(LEVELED + f", c as (select r::tinyint as resolution, count(source_index) as n from range({LEVELS}) t(r) left join lv on resolution = r group by r) select resolution, (sum(ceil(n / {GROUP}.0)) over (order by resolution))::bigint as row_group_end from c")
def s7_row_group_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.row_group_ends(levels.level_counts(packed(spark, sf_dir), LEVELS), GROUP)


@query(PACKED + "select source_index, resolution, row_group from pk")
def o1a_pack_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select("source_index", "resolution", "row_group")


@query(PACKED + "select source_index, page, page_place from pk")
def o1b_o3_pack_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select("source_index", "page", "page_place")


@query(PACKED + "select source_index, (row_number() over (partition by resolution, row_group, page order by source_index) - 1)::int as by_source, (row_number() over (partition by resolution, row_group, page order by gps_time, source_index) - 1)::int as by_time from pk")
def o2_page_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_source = packing.with_place(packed(spark, sf_dir), "source").withColumnRenamed("place", "by_source")
    return packing.with_place(by_source, "gps-time").select("source_index", "by_source", F.col("place").alias("by_time"))


@query(GROUPS + f"select count(*) as points, count(*) filter ({_between(BOX)}) as points_in_box from pk join g using (resolution, row_group) where g.row_end <= (select max(row_end) from g where resolution <= {LEVEL})")
def o4_a5_count_at_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix of a file has no meaning here; the level's rows do, and those of them that a box holds."""
    cloud = stored(spark, sf_dir)
    every = cloud.points.filter(F.col("resolution") <= LEVEL).agg(F.count(F.lit(1)).alias("points"))
    return every.join(F.broadcast(cloud.query_quantized(BOX, LEVEL).agg(F.count(F.lit(1)).alias("points_in_box"))))  # one row each


# Storage


def _las_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """LAS files of the view in the shared folder, even events before odd ones, written in tasks."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}#las")
    if key not in _layouts:
        folder = f"{shared_folder(spark)}/las/{uuid.uuid4().hex}"
        discard_at_exit(spark, folder)
        colors = [F.coalesce(c, F.lit(0)).alias(c) for c in ("red", "green", "blue")]
        points = events_points(spark, sf_dir).select("source_index", "x", "y", "z", "intensity", F.col("gps_time").alias("gps"), F.col("classification").alias("class_flags"), *colors)
        out = []
        for k in range(2):
            part = points.filter(F.pmod("source_index", F.lit(2)) == k)
            out += las.write_las_parts(part, ["source_index"], f"{folder}/{k}", VIEW, 3, 'LOCAL_CS["test"]')
        _layouts[key] = out  # type: ignore[assignment]
    return _layouts[key]  # type: ignore[return-value]


@query(POINTS + f", n as (select *, row_number() over (order by source_index % 2, source_index) - 1 as i from pts) select i::bigint as source_index, x, y, z, intensity, {_RGB}, classification, gps_time, 0.0::float as scan_angle from n")
def s1_s2_s3_las_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(las.LasDataSource)
    rows = spark.read.format("las").option("path", ",".join(_las_files(spark, sf_dir))).option("records", 700).load()
    return rows.select("source_index", "x", "y", "z", "intensity", "red", "green", "blue", "classification", "gps_time", "scan_angle")


@query("select 'LOCAL_CS[\"test\"]' as crs")
def s4_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = [las.read_header(p) for p in _las_files(spark, sf_dir)]
    las.check_same(headers)
    return spark.createDataFrame([(headers[0].crs,)], "crs string")


@query(PACKED + "select source_index, x, y, z, red, intensity, gps_time, resolution::int as resolution, row_group, page from pk")
def s5_s6_parquet_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).points.select("source_index", "x", "y", "z", "red", "intensity", "gps_time", "resolution", "row_group", "page")


@query(GROUPS + "select resolution::int as resolution, count(*) as row_groups, sum(point_count)::bigint as points from g group by all")
def s8_s9_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups as the files' footers have them, by the directory of their level."""
    groups_ = catalog.footer_groups(footers(spark, stored(spark, sf_dir).path))
    return groups_.groupBy(F.col("resolution").cast("int").alias("resolution")).agg(F.count(F.lit(1)).alias("row_groups"), F.sum("point_count").alias("points"))


@query(GROUPS + f"select count(*) as row_groups_read, coalesce(sum(point_count), 0)::bigint as points_in_candidate_row_groups from g where resolution <= {LEVEL} and {_meets(BOX)}")
def a6_candidates_from_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of a box without the catalogue: statistics of the footers, pivoted to a row for each group."""
    return catalog.plan(catalog.footer_groups(footers(spark, stored(spark, sf_dir).path)), BOX, LEVEL)


@query(GROUPS + "select '0.1.0' as version, 32 as ratio, " + ", ".join(f"round(min(wmin{a}), 6) as min{a}, round(max(wmax{a}), 6) as max{a}" for a in AXES) + " from g")
def s10_a2_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored(spark, sf_dir).metadata
    b = [round(v, 6) for a in range(3) for v in (m.bounds[a], m.bounds[3 + a])]
    return spark.createDataFrame([(m.version, m.voxel_edge_ratio, *b)], "version string, ratio int, " + ", ".join(f"min{a} double, max{a} double" for a in AXES))


@query()
def s14_coalesced_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold over sorted reads; the tests hold it against a loop."""
    reads = events_points(spark, sf_dir).select(F.col("classification").alias("file"), (F.col("source_index") * 40009 % 90000017).alias("start"))
    return catalog.coalesced_ranges(reads.withColumn("end", F.col("start") + 5000))


@query(LEVELED + f"select '{{\"resolution\":' || r || ',\"point_count\":' || count(source_index) || '}}' as json from range({LEVELS}) t(r) left join lv on resolution = r group by r")
def s17_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.level_counts(packed(spark, sf_dir), LEVELS).select(F.to_json(F.struct("resolution", "point_count")).alias("json"))


def _broken_sql() -> str:
    """Of each stored column; those that the points don't have are 0, false or null in `full`."""
    have = {*AXES, "red", "green", "blue", "intensity", "classification", "gps_time"}
    added = [f"{'null::bigint' if o else 'false' if k == 'boolean' else '0'} as {n}" for n, k, o in STORED if n not in have]

    def row(name: str, optional: bool) -> str:
        nulls = f"count(*) filter ({name} is null)"
        wide = f"count(*) filter ({name} < 0 or {name} > {UNSIGNED[name]})" if name in UNSIGNED else "0::bigint"
        mixed = f"{nulls} > 0 and {nulls} < count(*)" if optional else "false"
        return f"select '{name}' as \"column\", {'0::bigint' if optional else nulls} as nulls, {wide} as out_of_range, {mixed} as mixed from full_pts"

    return POINTS + f", full_pts as (select *, {', '.join(added)} from pts)\n" + " union all ".join(row(n, o) for n, _, o in STORED)


@query(_broken_sql())
def s5_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all stored columns."""
    return broken(complete(events_points(spark, sf_dir)))


# Aggregates


@query(POINTS + "select " + ", ".join(f"min({a}) as min{a}, max({a}) as max{a}" for a in AXES) + " from pts")
def a1_cloud_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_points(spark, sf_dir).agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])


@query(POINTS + "select count(*) as points, true as equal, " + ", ".join(f"sum({c})::bigint as sum_{c}" for c in (*AXES, "source_index", "red", "green", "blue", "intensity", "classification")) + " from pts")
def a4_full_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash values are the engine's own; that the stored copy has those of its source, in all columns of both, is what counts. Sums of
    the stored columns are compared with SQL."""
    source, copy = events_points(spark, sf_dir), stored(spark, sf_dir).points
    columns = [c for c in copy.columns if c in source.columns]
    a = analysis.full_checksum(source.select(*columns))
    b = analysis.full_checksum(copy.select(*columns)).select(F.col("checksum").alias("other"))
    sums = copy.agg(*[F.sum(c).cast("long").alias(f"sum_{c}") for c in (*AXES, "source_index", "red", "green", "blue", "intensity", "classification")])
    return a.join(F.broadcast(b)).join(F.broadcast(sums)).select("points", (F.col("checksum") == F.col("other")).alias("equal"), *sums.columns)  # one row each


@query(GROUPS + "select resolution, any_value(geometric_error) as geometric_error, count(distinct index) as row_groups from g group by all")
def a7_a8_any_value_and_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).groupBy("resolution").agg(F.any_value("geometric_error").alias("geometric_error"), F.count_distinct("index").alias("row_groups"))


@query()
def a9_bytes_per_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed sizes come from our own files, which DuckDB has no copy of; a test reads the same files with another reader."""
    chunks = footers(spark, stored(spark, sf_dir).path)
    return chunks.groupBy("column_name").agg(F.sum("compressed_bytes").alias("compressed_bytes")).orderBy("column_name")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up measurements: five trials of each configuration, with sizes, requests and times."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.groupBy(F.col("event_type").alias("config"), (F.col("event_id") % 5).alias("trial"))
    return rows.agg(F.count(F.lit(1)).alias("requests"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("bytes"), F.max(F.round(F.col("value") * 100).cast("long")).alias("elapsed"))


_RUNS = "with runs as (select event_type as config, event_id % 5 as trial, count(*) as requests, sum(round(value * 100)::bigint)::bigint as bytes, max(round(value * 100)::bigint) as elapsed from events group by all)\n"


@query(_RUNS + "select config, median(requests)::double as requests, median(bytes)::double as bytes, median(elapsed)::double as elapsed from runs group by all")
def a10_a11_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.medians(_runs(spark, sf_dir), ["config"], ["requests", "bytes", "elapsed"])


@query(_RUNS + "select trial, sum(bytes)::bigint as bytes, max(requests) as most_requests from runs group by all")
def a12_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).groupBy("trial").agg(F.sum("bytes").alias("bytes"), F.max("requests").alias("most_requests"))


@query(_RUNS + "select config, min(requests) as least, median(requests)::double as median, max(requests) as greatest, round(avg(requests), 6) as mean, round(stddev_pop(requests), 6) as deviation, round(stddev_pop(requests) / avg(requests), 6) as variation, max(requests) - min(requests) as \"range\" from runs group by all")
def a13_a14_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.spread(_runs(spark, sf_dir), ["config"], "requests")
    return out.select("config", "least", "median", "greatest", *[F.round(c, 6).alias(c) for c in ("mean", "deviation", "variation")], "range")


@query(_RUNS + "select config, trial, elapsed from (select *, row_number() over (partition by config order by elapsed, trial) as k, count(*) over (partition by config) as n from runs) where k = (n + 1) // 2")
def o6_o7_median_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.median_trial(_runs(spark, sf_dir), ["config"], "elapsed", "trial").select("config", "trial", "elapsed")


@query(_RUNS + "select config, trial, requests, row_number() over (order by requests, config, trial)::bigint as place from runs")
def o6_result_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).withColumn("name", F.concat_ws("/", "config", F.col("trial").cast("string")))
    return analysis.by_rows(runs, "requests", "name").select("config", "trial", "requests", F.col("place").cast("long").alias("place"))


@query(_RUNS + "select config, trial, round(bytes / max(bytes) filter (trial = 0) over (partition by config) - 1, 9) as bytes_vs from runs")
def a15_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.relative(_runs(spark, sf_dir), F.col("trial") == 0, ["config"], ["bytes"])
    return out.select("config", "trial", F.round("bytes_vs", 9).alias("bytes_vs"))


@query(_RUNS + "select regexp_extract(config || '-' || trial || '.json', '^([a-z_]+)-([0-9]+)', 1) as config, count(*) as runs from runs group by all")
def a16_group_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("config", F.lit("-"), "trial", F.lit(".json"))
    return _runs(spark, sf_dir).groupBy(F.regexp_extract(name, "^([a-z_]+)-([0-9]+)", 1).alias("config")).agg(F.count(F.lit(1)).alias("runs"))


@query(_RUNS + "select trial, count(distinct (requests, bytes)) as signatures, count(distinct (requests, bytes)) = 1 as consistent from runs group by all")
def a17_a24_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.consistent(_runs(spark, sf_dir), ["trial"], ["requests", "bytes"])


@query(_RUNS + "select config, trial from runs a where not exists (select 1 from runs b where (b.config, b.trial) <> (a.config, a.trial) and b.requests <= a.requests and b.bytes <= a.bytes and b.elapsed <= a.elapsed and (b.requests < a.requests or b.bytes < a.bytes or b.elapsed < a.elapsed))")
def a18_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.pareto(_runs(spark, sf_dir), ["requests", "bytes", "elapsed"]).select("config", "trial")


_PHASES = POINTS + ", m as (select source_index, x / 10.0 + 100 as data_ready, x / 20.0 + 50 as load, 10.0 as buffer, 20.0 as open, x / 10.0 + 150 as gpu_complete, 30.0 as render, x / 10.0 + 160 as frame from pts)\n"


@query(_PHASES + "select source_index, round(data_ready - load - buffer, 6) as startup, round(load - open, 6) as query, round(gpu_complete - data_ready - render, 6) as scene_wait, round(frame - gpu_complete, 6) as frame_wait, true as sound from m")
def a19_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    runs = events_points(spark, sf_dir).select("source_index", (x / 10.0 + 100).alias("data_ready"), (x / 20.0 + 50).alias("load"), F.lit(10.0).alias("buffer"), F.lit(20.0).alias("open"), (x / 10.0 + 150).alias("gpu_complete"), F.lit(30.0).alias("render"), (x / 10.0 + 160).alias("frame"))
    return analysis.phases(runs).select("source_index", *[F.round(c, 6).alias(c) for c in ("startup", "query", "scene_wait", "frame_wait")], "sound")


@query(POINTS + "select count(*) as points, (count(*) * 18)::bigint as bytes from pts where " + _between(BOX))
def a25_output_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events_points(spark, sf_dir).filter(geometry.inside(BOX)).agg(F.count(F.lit(1)).alias("points"))
    return found.withColumn("bytes", F.col("points") * 18)


@query(POINTS + "select true as same, count(*) filter (source_index <> 0) <> count(*) as other_differs, count(*) as n, " + ", ".join(f"{m}({a}) as {m}{a}" for a in AXES for m in ("min", "max")) + " from pts")
def a22_same_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored cloud is beside its source the same, and beside one that lacks a point another."""
    sides = [f(a).alias(f"{n}{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]
    summed = lambda df: df.agg(F.count(F.lit(1)).alias("n"), *sides)
    a, b = summed(events_points(spark, sf_dir)), summed(stored(spark, sf_dir).points)
    less = summed(events_points(spark, sf_dir).filter("source_index <> 0"))
    out = analysis.same_source(a, b, 0.01).join(F.broadcast(analysis.same_source(less, b, 0.01).select((~F.col("same")).alias("other_differs"))))
    return out.join(F.broadcast(b))  # one row each


# Octree nodes

CUBE = (0.0, 0.0, 0.0, 1500.0)
_NODES = POINTS + ", d as (select *, 4 - least(length(regexp_extract(bin(source_index + 1), '(0*)$', 1)), 4)::int as depth from pts), nodes as (select depth, " + _xyz("floor({a}::double * 0.01 / 1500.0 * pow(2.0, depth))::bigint as i{a}") + ", count(*) as point_count from d group by all), db as (select *, " + _xyz("0.0 + i{a} * (1500.0 / pow(2.0, depth)) as wmin{a}, 0.0 + (i{a} + 1) * (1500.0 / pow(2.0, depth)) as wmax{a}") + " from nodes)\n"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.octree_nodes(events_points(spark, sf_dir), CUBE, 4, [F.col(a).cast("double") * F.lit(0.01) for a in AXES])


@query(_NODES + "select d.depth::int as depth, coalesce(sum(point_count), 0)::bigint as points, (sum(coalesce(sum(point_count), 0)) over (order by d.depth))::bigint as cumulative_points from range(5) d(depth) left join nodes using (depth) group by d.depth")
def l7_cumulative_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.cumulative_depths(_nodes(spark, sf_dir))


@query(_NODES + f"select depth, ix, iy, iz, point_count from db where depth <= 2 and {_meets(WORLD, 'w')}")
def f13_s16_octree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.node_bounds(_nodes(spark, sf_dir), CUBE).filter("depth <= 2")
    return found.filter(geometry.overlaps(WORLD, catalog.WORLD_LOW, catalog.WORLD_HIGH)).select("depth", "ix", "iy", "iz", "point_count")


@query(_NODES + f", h as (select *, {_meets(WORLD, 'w')} as hit from db where depth <= 2) select count(*) as nodes_total, count(*) filter (hit) as nodes_read, count(*) filter (not hit) as nodes_pruned, (sum(point_count) filter (hit))::bigint as points from h")
def a23_node_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = geometry.overlaps(WORLD, catalog.WORLD_LOW, catalog.WORLD_HIGH)
    nodes = analysis.node_bounds(_nodes(spark, sf_dir), CUBE).filter("depth <= 2")
    return nodes.agg(F.count(F.lit(1)).alias("nodes_total"), F.count_if(hit).alias("nodes_read"), F.count_if(~hit).alias("nodes_pruned"), F.sum(F.when(hit, F.col("point_count"))).alias("points"))


_PAGE = "{d} || '-' || {x} || '-' || {y} || '-' || {z}"


@query((_NODES + ", pg as (select " + _PAGE.format(d="depth", x="ix", y="iy", z="iz") + " as page, " + _PAGE.format(d="(depth - 1)", x="(ix // 2)", y="(iy // 2)", z="(iz // 2)") + " as parent from nodes), walk(page) as (select '0-0-0-0' union select pg.page from walk join pg on pg.parent = walk.page) select page from walk").replace("with pts", "with recursive pts", 1))
def l8_hierarchy_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octree nodes that the root reaches through nodes that exist."""
    name = lambda d, x, y, z: F.concat_ws("-", *[c.cast("string") for c in (d, x, y, z)])
    half = [F.floor(F.col(c) / 2) for c in ("ix", "iy", "iz")]
    nodes = _nodes(spark, sf_dir).select(name(F.col("depth"), F.col("ix"), F.col("iy"), F.col("iz")).alias("page"), name(F.col("depth") - 1, *half).alias("parent"))
    return analysis.reachable(nodes, spark.createDataFrame([("0-0-0-0",)], "page string"))


@query(GROUPS + ", r as (select resolution, max(row_end) over (order by resolution) as row_end from g) select resolution, row_end::bigint as row_end from (select distinct * from r) order by abs(row_end - (select count(*) from pts) / 4.0), resolution limit 1")
def l6_o8_nearest_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = catalog.resolutions(groups(spark, sf_dir), VIEW, RATIO, LEVELS).select("resolution", "row_end")
    total = packed(spark, sf_dir).count()
    return analysis.nearest(g, "row_end", F.lit(total / 4), "resolution")


@query(GROUPS + f", p as (select resolution, row_group, page, {_BOUNDS} from pk group by all) select g.index, page from p join g using (resolution, row_group) where g.index in (1, 2, 3) and {_meets(BOX, 'p.')}")
def f14_loaded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = groups(spark, sf_dir).filter(F.col("index").isin(1, 2, 3)).select("index")
    p = catalog.pages(packed(spark, sf_dir), groups(spark, sf_dir), VIEW).join(loaded, "index", "left_semi")
    return p.filter(geometry.overlaps(BOX, catalog.LOW, catalog.HIGH)).select("index", "page")


# A larger cloud, for measurements


@query("with i as (select (l_partkey * 100)::int as x, (l_suppkey * 100)::int as y, round(l_extendedprice * 100)::int as z from lineitem) select x, y, z, count(*) as n from i where x between 1000 and 150000 and y between 100 and 9000 and z between 100000 and 3000000 group by all")
def f1_lineitem_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_partkey") * 100).cast("int").alias("x"), (F.col("l_suppkey") * 100).cast("int").alias("y"), F.round(F.col("l_extendedprice") * 100).cast("int").alias("z"))
    return rows.filter(geometry.inside(Box((1000, 100, 100000), (150000, 9000, 3000000)))).groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as points, (count(*) * (count(*) - 1) // 2)::bigint as index_sum from lineitem")
def s3_numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_index of a table without a key: gapless, over all tasks."""
    rows = lineitem_points(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("points"), F.sum("source_index").alias("index_sum"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels of the largest standard box around the cloud's middle, from the stored layout."""
    cloud = stored(spark, sf_dir)
    extent = Box(cloud.metadata.bounds[:3], cloud.metadata.bounds[3:])
    return cloud.query_world(query_set(extent, extent.center)["large"], cloud.metadata.levels - 1)
