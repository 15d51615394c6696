"""Every registered query of the core on the smallest tables, beside its SQL."""

import pytest
from compare import check, connect
from conftest import DATA

from terrapoint.plans.queries import QUERIES, SQL

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, con, name):
    check(spark, con, QUERIES[name], SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["p26_short_numbers", "l1_ladder_length", "p13_p20_srgb"])
def test_like_sql_at_scale(spark, name):
    """At scale 0.1 there are points at 1,050,000, 1,150,000 and so on, and a longer ladder."""
    folder = f"{DATA}/sf0.1"
    c = connect(folder)
    check(spark, c, QUERIES[name], SQL[name], folder)
    if name != "l1_ladder_length":
        assert QUERIES[name](spark, folder).count() == c.sql("select count(*) from events").fetchall()[0][0]


def test_schema_check_of_all_columns(spark):
    from terrapoint.sources.points import STORED

    got = [r["column"] for r in QUERIES["s5_schema_check"](spark, FOLDER).collect()]
    assert got == [n for n, _, _ in STORED]


def test_bytes_per_column(spark):
    """Footers, beside the same files read here."""
    from collections import Counter
    from pathlib import Path

    import pyarrow.parquet as pq

    from terrapoint.plans.queries import stored

    want = Counter()
    for f in Path(stored(spark, FOLDER).path.removeprefix("file:")).glob("resolution=*/part-*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for i in range(meta.num_row_groups):
            for k in range(meta.num_columns):
                want[meta.row_group(i).column(k).path_in_schema] += meta.row_group(i).column(k).total_compressed_size
    assert {r["column_name"]: r["compressed_bytes"] for r in QUERIES["a9_bytes_per_column"](spark, FOLDER).collect()} == want


def test_stored_parts(spark):
    """What comes part by part is what one query finds."""
    from terrapoint.plans.queries import BOX, LEVEL, stored

    cloud = stored(spark, FOLDER)
    one = sorted(map(tuple, cloud.query_quantized(BOX, LEVEL).collect()))
    parts = [r for _, part in cloud.chunks(BOX, LEVEL) for r in part.collect()]
    assert one == sorted(map(tuple, parts))
