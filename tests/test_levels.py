import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapoint.functions.hash64 import with_priority
from terrapoint.functions.hilbert import hilbert_index
from terrapoint.operators import levels, packing
from terrapoint.operators.ranks import ranked
from terrapoint.plans.model import Box, Transform, ladder_length

M = (1 << 64) - 1


def cloud(spark, rows):
    return spark.createDataFrame([(int(x), int(y), int(z), i) for i, (x, y, z) in enumerate(rows)], "x int, y int, z int, source_index long")


def leveled(spark, rows, n, ratio=2, scale=(1.0, 1.0, 1.0)):
    points = cloud(spark, rows)
    return levels.with_levels(points, levels.cloud_bounds(points), Transform(scale), ratio, n)


def counts(df, n):
    return [r["point_count"] for r in levels.level_counts(df, n).orderBy("resolution").collect()]


def splitmix(v):
    v = (v + 0x9E3779B97F4A7C15) & M
    v = ((v ^ v >> 30) * 0xBF58476D1CE4E5B9) & M
    v = ((v ^ v >> 27) * 0x94D049BB133111EB) & M
    return v ^ v >> 31


def priority(p, exponent):
    s = 0x9E3779B97F4A7C15 ^ exponent
    for c in p:
        s = splitmix(s ^ (c & 0xFFFFFFFF))
    return s


def test_priority(spark):
    rng = np.random.default_rng(1)
    rows = rng.integers(-(2**31), 2**31, (200, 3)).tolist()
    got = with_priority(cloud(spark, rows), 5).orderBy("source_index").collect()
    assert [(r["priority"] ^ -(2**63)) & M for r in got] == [priority(p, 5) for p in rows]


def test_partition_of_points(spark):
    out = leveled(spark, [(x, x % 7, 0) for x in range(100)], 5)
    assert out.count() == out.select("source_index").distinct().count() == 100


@pytest.mark.parametrize(
    ("rows", "n", "ratio", "scale", "want"),
    [
        ([(0, 0, 0), (1, 1, 1), (9, 0, 0)], 2, 4, (1.0, 1.0, 1.0), [2, 1]),
        ([(0, 0, 0), (100, 0, 0)], 10, 2, (1.0, 1.0, 1.0), [1, 1, 0, 0, 0, 0, 0, 0, 0, 0]),
        ([(0, 0, 0), (0, 0, 0), (1, 0, 0)], 2, 2, (1.0, 1.0, 1.0), [1, 2]),
        ([(0, 0, 0), (0, 0, 99)], 2, 2, (1.0, 1.0, 0.01), [1, 1]),
    ],
)
def test_counts(spark, rows, n, ratio, scale, want):
    assert counts(leveled(spark, rows, n, ratio, scale), n) == want


def test_level_count(spark):
    assert ladder_length(Box((0, 0, 0), (400000, 1, 1)), Transform(), 2) == 20
    points = cloud(spark, [(x, 0, 0) for x in range(101)])
    bounds = levels.cloud_bounds(points)
    n = levels.level_count(points, bounds, Transform(), 2, 8)
    assert n == 5
    assert counts(levels.with_levels(points, bounds, Transform(), 2, n), n)[0] == 7


def test_level_count_of_wide_cloud(spark):
    """More than 64 voxels of width 2^18 to 2^20: the search goes on past the widths that the query's SQL lists."""
    points = cloud(spark, [(i << 18, 0, 0) for i in range(344)])
    assert levels.level_count(points, levels.cloud_bounds(points), Transform(), 2, 64) == 1 + next(e for e in range(40) if len({(i << 18) >> e for i in range(344)}) <= 64) == 22


def test_order_of_rows_does_not_matter(spark):
    rows = [(x, 3 * x, 5 * x) for x in range(32)]
    points = spark.createDataFrame([(x, y, z, i) for i, (x, y, z) in reversed(list(enumerate(rows)))], "x int, y int, z int, source_index long")
    again = levels.with_levels(points, levels.cloud_bounds(points), Transform(), 64, 2)
    first = {r[0] for r in leveled(spark, rows, 2, 64).filter("resolution = 0").select("source_index").collect()}
    assert first == {r[0] for r in again.filter("resolution = 0").select("source_index").collect()} != {0}


@pytest.mark.parametrize(("ratio", "n"), [(2, 6), (3, 4), (4, 3)])
def test_levels_like_a_loop(spark, ratio, n):
    rng = np.random.default_rng(ratio)
    rows = rng.integers(-20, 40, (300, 3)).tolist()
    got = {r["source_index"]: r["resolution"] for r in leveled(spark, rows, n, ratio).collect()}
    low, left, want = [min(r[k] for r in rows) for k in range(3)], set(range(len(rows))), {}
    for level in range(n - 1):
        e, best = n - 1 - level, {}
        for i in sorted(left):
            cell = tuple((rows[i][k] - low[k]) // ratio**e for k in range(3))
            best[cell] = min(best.get(cell, (M + 1, 0)), (priority(rows[i], e), i))
        for _, i in best.values():
            want[i] = level
            left.remove(i)
    assert got == want | dict.fromkeys(left, n - 1)


def test_row_group_ends(spark):
    table = spark.createDataFrame([(0, 2), (1, 0), (2, 5)], "resolution tinyint, point_count long")
    assert [r["row_group_end"] for r in levels.row_group_ends(table, 2).orderBy("resolution").collect()] == [1, 1, 4]


def test_empty_cloud(spark):
    assert levels.cloud_bounds(cloud(spark, [(0, 0, 0)]).limit(0)) is None


LATTICE = [(x, y, z) for x in range(4) for y in range(4) for z in range(4)][::-1]


def spans(df, key):
    out = df.groupBy(key).agg(*[(F.max(a) - F.min(a)).alias(a) for a in "xyz"], F.count(F.lit(1)).alias("n")).collect()
    return len(out), {(r["x"], r["y"], r["z"], r["n"]) for r in out}


def test_packing_lattice(spark):
    assert spans(packing.pack_levels(leveled(spark, LATTICE, 1), 8), "row_group") == (8, {(1, 1, 1, 8)})
    assert spans(packing.pack_pages(packing.pack_levels(leveled(spark, LATTICE, 1), 64), 8), "page") == (8, {(1, 1, 1, 8)})


def test_packing_partial_leaf(spark):
    out = packing.pack_levels(leveled(spark, [(x, x % 3, x % 5) for x in range(19)], 1), 8)
    assert sorted((r[0], r[1]) for r in out.groupBy("row_group").count().collect()) == [(0, 8), (1, 8), (2, 3)]


def root(n, power):
    k = 1
    while k**power < n:
        k += 1
    return k


def pack(points, cap):
    """Row by row: slabs, strips, leaves."""
    def sizes(total, parts):
        return [total // parts + (i < total % parts) for i in range(parts)]

    leaves, out = -(-len(points) // cap), []
    rest = sorted(points)
    for slab in sizes(leaves, root(leaves, 3)):
        mine, rest = sorted(rest[: slab * cap], key=lambda p: (p[1], p[0], p[2], p[3])), rest[slab * cap :]
        n = -(-len(mine) // cap)
        for strip in sizes(n, root(n, 2)):
            part, mine = sorted(mine[: strip * cap], key=lambda p: (p[2], p[0], p[1], p[3])), mine[strip * cap :]
            out += part
    return {p[3]: i // cap for i, p in enumerate(out)}


@pytest.mark.parametrize(("n", "cap"), [(257, 8), (100, 7), (64, 64), (5, 2)])
def test_packing_like_a_loop(spark, n, cap):
    rng = np.random.default_rng(n)
    rows = rng.integers(0, 20, (n, 3)).tolist()
    for large in (True, False):
        out = packing.packed(leveled(spark, rows, 1), ["resolution"], cap, "leaf", large)
        assert {r["source_index"]: r["leaf"] for r in out.collect()} == pack([(*p, i) for i, p in enumerate(rows)], cap)


def test_orders(spark):
    points = spark.createDataFrame([(i, 0, 0, i, float("nan") if i == 3 else -0.0 if i == 5 else 0.0 if i == 4 else float(-i)) for i in range(16)], "x int, y int, z int, source_index long, gps_time double")
    paged = packing.pack_pages(packing.pack_levels(points.withColumn("resolution", F.lit(0).cast("tinyint")), 8), 4)
    pages = {r["source_index"]: (r["row_group"], r["page"]) for r in paged.collect()}
    for order in packing.ORDERS:
        out = packing.with_place(paged, order).collect()
        assert {r["source_index"]: (r["row_group"], r["page"]) for r in out} == pages
        assert sorted((*pages[r["source_index"]], r["place"]) for r in out) == [(g, p, k) for g in range(2) for p in range(2) for k in range(4)]
    by_time = {r["source_index"]: r["place"] for r in packing.with_place(paged, "gps-time").collect()}
    assert [by_time[i] for i in (2, 1, 0, 3)] == [0, 1, 2, 3]
    assert by_time[5] < by_time[4]
    with pytest.raises(ValueError, match="gps_time"):
        packing.with_place(paged.drop("gps_time"), "gps-time")
    with pytest.raises(ValueError, match="order"):
        packing.with_place(paged, "random")


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_hilbert_cells_are_neighbours(bits):
    n = 1 << bits
    cells = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    index = hilbert_index(cells, bits)
    assert sorted(index) == list(range(n**3))
    assert set(np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1)) == {1}


def test_hilbert_rows_of_different_bits():
    rng = np.random.default_rng(3)
    bits = rng.integers(1, 22, 200)
    cells = rng.integers(0, 1 << 21, (200, 3)) >> (21 - bits)[:, None]
    assert hilbert_index(cells, bits).tolist() == [int(hilbert_index(c[None], int(b))[0]) for c, b in zip(cells, bits, strict=True)]


def test_ranks(spark):
    rows = [(i % 3, (i * 37) % 101, i) for i in range(500)]
    out = ranked(spark.createDataFrame(rows, "g int, v int, i int"), ["g"], ["v", "i"]).collect()
    for g in range(3):
        mine = sorted((r["v"], r["i"], r["rank"]) for r in out if r["g"] == g)
        assert [m[2] for m in mine] == list(range(len(mine)))
