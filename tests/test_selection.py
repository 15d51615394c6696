import math

import pytest
from pyspark.sql import functions as F

from terrapoint.functions import color, geometry
from terrapoint.operators import analysis, catalog, selection
from terrapoint.plans.model import Box, Metadata, Transform, check_box, check_groups, check_level, query_box

BOX = Box((0.0, 0.0, 0.0), (10.0, 10.0, 10.0))
NEAR = ((0.0, 0.0, 0.0), (10.0, 10.0, 10.0))
SIDES = [*catalog.WORLD_LOW, *catalog.WORLD_HIGH]


def groups(spark, rows):
    return spark.createDataFrame([(i, r, n, *lo, *hi) for i, r, n, (lo, hi) in rows], "index int, resolution tinyint, point_count long, " + ", ".join(f"{c} double" for c in SIDES))


def pick(spark, rows, camera, threshold=5.0, budget=100.0, box=BOX, errors=(8.0, 4.0, 0.0), in_view=None):
    view = selection.View(camera, 1000.0, 90.0, threshold, budget)
    chosen = selection.selected(groups(spark, rows), errors, box, view, in_view)
    return [r["index"] for r in chosen.orderBy("index").collect()], sum(r["point_count"] for r in chosen.collect())


THREE = [(0, 0, 10, NEAR), (1, 1, 10, NEAR), (2, 2, 10, NEAR)]


def test_distance(spark):
    one = groups(spark, [(0, 0, 1, NEAR)])
    for camera, want in (((5, 5, 5), 0.0), ((13, 14, 10), 5.0)):
        assert one.select(geometry.distance(camera, catalog.WORLD_LOW, catalog.WORLD_HIGH)).first()[0] == want


def test_near_and_far(spark):
    assert pick(spark, THREE, (5.0, 5.0, 1000.0))[0] == [0]
    assert pick(spark, THREE, (5.0, 5.0, 110.0))[0] == [0, 1, 2]


def test_locality(spark):
    far = ((1000.0, 0.0, 0.0), (1010.0, 10.0, 10.0))
    assert pick(spark, [*THREE[:2], (2, 2, 10, far)], (5.0, 5.0, 110.0), box=Box((0.0, 0.0, 0.0), (2000.0, 10.0, 10.0)))[0] == [0, 1]


def test_view_predicate(spark):
    third = ((0.0, 0.0, 0.0), (9.0, 10.0, 10.0))
    seen = lambda low, high: F.col(high[0]) > 9.5
    assert pick(spark, [*THREE[:2], (2, 2, 10, third)], (5.0, 5.0, 20.0), in_view=seen)[0] == [0, 1]


def test_budget_skips_and_goes_on(spark):
    rows = [(0, 0, 10, NEAR), (1, 1, 60, ((0.0, 0.0, 0.0), (10.0, 10.0, 1.0))), (2, 1, 60, ((0.0, 0.0, 9.0), (10.0, 10.0, 10.0)))]
    assert pick(spark, rows, (5.0, 5.0, 20.0), budget=70.0) == ([0, 2], 70)
    small = [*rows, (3, 1, 5, ((0.0, 0.0, 0.0), (10.0, 10.0, 0.5)))]
    assert pick(spark, small, (5.0, 5.0, 20.0), budget=75.0) == ([0, 2, 3], 75)


def test_infinite_budget_and_zero_threshold(spark):
    assert pick(spark, THREE, (5.0, 5.0, 20.0), budget=math.inf) == ([0, 1, 2], 30)
    assert pick(spark, THREE, (5.0, 5.0, 1000.0), threshold=0.0)[0] == [0, 1, 2]


def test_camera_inside_passes_the_budget(spark):
    assert pick(spark, [(0, 0, 10, NEAR), (1, 1, 100, NEAR)], (5.0, 5.0, 5.0), budget=10.0, errors=(8.0, 0.0)) == ([0, 1], 110)


def test_bad_views(spark):
    with pytest.raises(ValueError):
        pick(spark, THREE, (0.0, 0.0, 0.0), budget=0.0)
    with pytest.raises(ValueError):
        pick(spark, THREE, (0.0, 0.0, 0.0), errors=())


def test_loaded(spark):
    held = selection.Loaded()
    one = spark.range(3)
    held.replace(1, one, 3)
    held.replace(2, one, 3)
    held.replace(1, one.limit(0), 0)
    assert list(held.frames) == [2]
    held.replace(5, one, 3)
    held.retain([5])
    assert held.union().count() == 3
    held.retain([])
    assert held.union() is None


def test_colors(spark):
    rows = spark.createDataFrame([(65535, 0, 32768, 0, 0), (0, 0, 0, 100, 1), (None, None, None, 0, 9)], "red int, green int, blue int, z int, resolution int")
    out = rows.select(*color.point_color("rgb", 0, 100)).collect()
    assert out[0]["cr"] == pytest.approx(1) and out[0]["cg"] == 0 and out[0]["cb"] == pytest.approx(((32768 / 65535 + 0.055) / 1.055) ** 2.4)
    assert out[1]["cr"] == pytest.approx(1.0) and out[1]["cg"] == pytest.approx(0.35)
    assert out[2]["cr"] == pytest.approx(0.05)
    assert rows.select(*color.point_color("resolution", 0, 1)).collect()[2]["cr"] == pytest.approx(0.29)
    ramp = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (2.0,)], "t double").select(*color.elevation(F.col("t"))).collect()
    assert ramp[0] == ramp[1] and ramp[2] == ramp[3]
    with pytest.raises(ValueError):
        color.point_color("shiny", 0, 1)


def test_pruning_by_level(spark):
    rows = [(0, 0, 10, 0, 10), (1, 1, 10, 50, 60), (2, 2, 10, 0, 10)]
    table = spark.createDataFrame([(i, r, n, a, 0, 0, b, 10, 10) for i, r, n, a, b in rows], "index int, resolution int, point_count long, minx int, miny int, minz int, maxx int, maxy int, maxz int")
    got = catalog.plan(table, Box((5, 2, 2), (15, 8, 8)), 1).first()
    assert (got["row_groups_read"], got["points_in_candidate_row_groups"]) == (1, 10)
    unknown = table.withColumn("minx", F.lit(None).cast("int"))
    assert catalog.candidates(unknown, Box((500, 2, 2), (505, 8, 8)), 2).count() == 3


def coalesced(reads, gap, most):
    out = []
    for a, b in sorted(reads):
        if out and a - out[-1][1] <= gap and max(out[-1][1], b) - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_coalesced_ranges(spark):
    reads = [(f, (i * 7919) % 5000, (i * 7919) % 5000 + 1 + i % 90) for f in range(2) for i in range(120)]
    df = spark.createDataFrame(reads, "file int, start long, end long")
    got = sorted((r["file"], r["start"], r["end"]) for r in catalog.coalesced_ranges(df, 20, 400).collect())
    assert got == sorted((f, *x) for f in range(2) for x in coalesced([r[1:] for r in reads if r[0] == f], 20, 400))


def test_model():
    t = Transform((0.5, 0.5, 0.5), (1.0, 1.0, 1.0))
    assert t.quantize(Box((1.3, 1.0, 0.9), (2.2, 2.5, 2.9))) == Box((1, 0, 0), (2, 3, 3))
    meta = Metadata((1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.0,) * 6, (1, 1, 4), 2)
    assert Metadata.from_json(meta.to_json()) == meta
    assert meta.geometric_error(2) == 0 and meta.geometric_error(0) == pytest.approx(4 * math.sqrt(3))
    for bad in ("{}", "[]", meta.to_json().replace("0.1.0", "9"), meta.to_json().replace('"voxel_edge_ratio":2', '"voxel_edge_ratio":1')):
        with pytest.raises(ValueError, match="sidecar"):
            Metadata.from_json(bad)
    with pytest.raises(ValueError, match="missing"):
        Metadata.from_json(None)
    with pytest.raises(ValueError, match="left over"):
        meta.check_levels(5)
    with pytest.raises(ValueError, match="decrease"):
        meta.check_levels(3)
    with pytest.raises(TypeError):
        check_box(Box((0.5, 0, 0), (1, 1, 1)))
    with pytest.raises(ValueError):
        check_box(Box((2, 0, 0), (1, 1, 1)))
    with pytest.raises(ValueError):
        check_level(3, 3)
    assert check_groups([3, 1, 1], 4) == [1, 3]
    with pytest.raises(ValueError):
        check_groups([4], 4)
    assert query_box(Box((0, 0, 0), (10, 10, 10)), (0, 5, 10), (0.5, 0.5, 0.5)) == Box((0, 2.5, 5), (5, 7.5, 10))


def test_median_trial_wants_odd(spark):
    runs = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 1.0)], "config string, trial int, v double")
    with pytest.raises(Exception, match="even number"):
        analysis.median_trial(runs, ["config"], "v", "trial").collect()


def test_match_level(spark):
    levels = spark.createDataFrame([(0, 10), (1, 30), (2, 100)], "resolution int, row_end long")
    depths = spark.createDataFrame([(0, 20), (1, 30), (2, 100)], "depth int, cumulative_points long")
    assert analysis.match_level(levels, depths, 100) == (1, 0)
    assert analysis.match_level(levels, depths, 100, level=2) == (2, 2)
    assert analysis.match_level(levels, depths, 100, depth=1) == (1, 1)


def test_formats(spark):
    cases = [(0.0, "0", "0 B", "0"), (999.0, "999", "999 B", "999"), (1000.0, "1k", "1.0 kB", "1000"), (1049.0, "1k", "1.0 kB", "1049"), (1050.0, "1.1k", "1.1 kB", "1050"), (1150.0, "1.2k", "1.1 kB", "1150"), (1250.0, "1.3k", "1.3 kB", "1250")]
    cases += [(999949.0, "999.9k", "999.9 kB", "999949"), (999950.0, "1m", "1000.0 kB", "999950"), (1250000.0, "1.3m", "1.25 MB", "1250000"), (1.5e9, "1.5b", "1500.00 MB", "1500000000"), (2.5e12, "2.5t", "2500000.00 MB", "2500000000000")]
    cases += [(999.96, "1k", "999.96 B", "999.96"), (12.34, "12.3", "12.34 B", "12.34"), (1125000.0, "1.1m", "1.13 MB", "1125000"), (1e16, "10,000t", "10000000000.00 MB", "10000000000000000")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, v double")
    shown = df.select("i", geometry.short_number(F.col("v")).alias("a"), geometry.short_bytes(F.col("v")).alias("b"), geometry.coordinate(F.col("v")).alias("c")).orderBy("i").collect()
    assert [(r["a"], r["c"]) for r in shown] == [(c[1], c[3]) for c in cases]
    assert [r["b"] for r in shown if cases[r["i"]][0] < 1e15] == [c[2] for c in cases if c[0] < 1e15]
    row = spark.range(1).select(geometry.short_number(F.lit(-1250000)), geometry.coordinate(F.lit(-0.1234565)), geometry.coordinate(F.lit(-1e-9)), geometry.coordinate(F.lit(1 / 128)), geometry.grouped_integer(F.lit(7188755)), geometry.short_number(F.lit(None).cast("int"))).first()
    assert tuple(row) == ("-1.3m", "-0.123457", "0", "0.007813", "7,188,755", None) or row[1] in ("-0.123456", "-0.123457")
    assert (row[0], row[2], row[3], row[4], row[5]) == ("-1.3m", "0", "0.007813", "7,188,755", None)


def test_pareto(spark):
    import random

    r = random.Random(12)
    rows = [(i, *(r.choice([None, *range(9)]) if i % 50 == 0 else r.randrange(30) for _ in range(3))) for i in range(3000)] + [(3000, 0, 0, 30), (3001, 0, 0, 30)]
    df = spark.createDataFrame(rows, "i int, a int, b int, c int").repartition(7)

    def beats(x, y):
        return None not in x and None not in y and all(p <= q for p, q in zip(x, y, strict=True)) and x != y

    want = {i for i, *v in rows if not any(beats(w, v) for _, *w in rows)}
    assert {x["i"] for x in analysis.pareto(df, ["a", "b", "c"]).collect()} == want
    assert analysis.pareto(df.limit(0), ["a", "b", "c"]).count() == 0


def test_selection_streams(spark):
    """Many groups, in one pass: the total passes from batch to batch."""
    n = 25_000
    rows = spark.range(n).select(F.col("id").cast("int").alias("index"), F.lit(1).cast("tinyint").alias("resolution"), (F.col("id") % 7 + 1).alias("point_count"), *[(F.col("id") + k).cast("double").alias(c) for k, c in enumerate([*catalog.WORLD_LOW, *catalog.WORLD_HIGH])])
    view = selection.View((-10.0, 0.0, 0.0), 1000.0, 60.0, 0.0, 50_003.0)
    got = sorted(r["index"] for r in selection.selected(rows, [1.0, 0.0], Box((-1.0,) * 3, (1e6,) * 3), view).collect())
    total, want = 0, []
    for i in range(n):  # nearer ones first
        if total + i % 7 + 1 <= 50_003:
            total += i % 7 + 1
            want.append(i)
    assert got == want
