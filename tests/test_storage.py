import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from terrapoint.plans.cloud import PointCloud
from terrapoint.plans.layout import LayoutOptions, laid_out, write
from terrapoint.plans.model import Box, Transform
from terrapoint.sources import exporter, las
from terrapoint.sources.files import files_below, footers, opened
from terrapoint.sources.points import STORED, broken, complete

SCALE = Transform((0.01, 0.01, 0.01), (0.0, 0.0, 0.0))


def record(n=40, point_format=10):
    """Raw fields of the full record."""
    i = np.arange(n)
    out = {
        "x": i, "y": i % 5, "z": i % 3, "intensity": 1000 + i, "flags": np.full(n, 1 | 2 << 4), "class": np.full(n, 2), "user_data": i, "source": 200 + i,
        "class_flags": (i % 2 == 0) * 1 | (i % 3 == 0) * 2 | (i % 5 == 0) * 4 | (i % 7 == 0) * 8 | (i % 4) << 4 | (i % 2 == 0) * 64 | (i == n - 1) * 128,
        "angle": i, "gps": 1e6 + i, "red": 10 + i, "green": 20 + i, "blue": 30 + i, "nir": 40 + i,
        "wave_index": np.ones(n), "wave_offset": i * 64, "wave_size": np.full(n, 64), "wave_at": np.full(n, 0.5), "wx": np.ones(n), "wy": np.full(n, 2), "wz": np.full(n, 3),
    }
    names = np.dtype(las.FORMATS[point_format]).names
    return {k: v for k, v in out.items() if k in names}


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("las") / "full.las")
    las.write_las(path, record(), SCALE, 10, "WKT")
    spark.dataSource.register(las.LasDataSource)
    return spark.read.format("las").option("path", path).option("records", 7).load()


def test_full_record(points):
    rows = points.orderBy("source_index").collect()
    assert len(rows) == 40 and len(points.columns) == 31
    for i, r in enumerate(rows):
        assert (r["source_index"], r["x"], r["y"], r["z"], r["intensity"]) == (i, i, i % 5, i % 3, 1000 + i)
        assert (r["return_number"], r["number_of_returns"], r["classification"], r["scanner_channel"]) == (1, 2, 2, i % 4)
        assert [r[c] for c in ("synthetic", "key_point", "withheld", "overlap")] == [i % 2 == 0, i % 3 == 0, i % 5 == 0, i % 7 == 0]
        assert (r["scan_direction_flag"], r["edge_of_flight_line"]) == (i % 2 == 0, i == 39)
        assert r["scan_angle"] == pytest.approx(i * 0.006) and r["gps_time"] == 1e6 + i and r["nir"] == 40 + i
        assert (r["waveform_data_offset"], r["waveform_packet_size"], r["waveform_z_t"]) == (i * 64, 64, 3)
    assert broken(complete(points)).filter("nulls > 0 or out_of_range > 0 or mixed").count() == 0


def test_layout_and_queries(spark, points, tmp_path):
    for order in ("spatial", "gps-time"):
        done = laid_out(points, SCALE, LayoutOptions(levels=3, row_group_size=8, page_rows=4, page_order=order))
        path = str(tmp_path / order)
        summary = write(done, path)
        assert summary["points"] == 40 and summary["rowGroups"] >= 5
        cloud = PointCloud(spark, path)
        assert cloud.metadata == done.metadata
        assert sorted(r["red"] - 10 for r in cloud.points.collect()) == list(range(40))
        box = Box((0.05, 0.0, 0.0), (0.2, 0.03, 0.01))
        for level in range(3):
            rows = cloud.query_world(box, level)
            want = cloud.points.filter(f"resolution <= {level} and x between 5 and 20 and y <= 3 and z <= 1")
            assert sorted(r["x"] for r in rows.collect()) == sorted(r["x"] for r in want.collect())
        for f in tmp_path.glob(f"{order}/resolution=*/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            sizes = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
            assert all(n == 8 for n in sizes[:-1]) and sizes[-1] <= 8
    assert cloud.query_world(Box((1.0, 0.0, 0.0), (0.0, 1.0, 1.0)), 0).count() == 0
    inf, nan = float("inf"), float("nan")
    assert cloud.query_row_groups([0, 1], Box((-inf, -inf, -inf), (inf, inf, inf))).count() == cloud.groups.filter(F.col("index") < 2).agg(F.sum("point_count")).first()[0]
    assert cloud.query_row_groups([0, 1], Box((nan, 0.0, 0.0), (1.0, 1.0, 1.0))).count() == 0
    with pytest.raises(TypeError):
        cloud.query_world(Box((nan, 0.0, 0.0), (1.0, 1.0, 1.0)), 0)
    with pytest.raises(ValueError, match="level"):
        cloud.query_world(Box((1.0, 0.0, 0.0), (0.0, 1.0, 1.0)), 9)
    plan = cloud.query_quantized(Box((5, 0, 0), (20, 3, 1)), 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(x,5)" in plan
    with pytest.raises(ValueError, match="no points"):
        laid_out(points.limit(0), SCALE)
    with pytest.raises(ValueError, match="must not be the input"):
        write(done, path, path)


def test_exporter(points, tmp_path):
    done = laid_out(points, SCALE, LayoutOptions(levels=3, row_group_size=8, page_rows=4))
    path = str(tmp_path / "one.parquet")
    n = exporter.export(done, path)
    f = pq.ParquetFile(path)
    assert f.metadata.num_row_groups == n == done.metadata.level_row_group_ends[-1]
    assert [c.name for c in f.schema_arrow] == [s[0] for s in STORED]
    assert f.schema_arrow.metadata[b"point_cloud"].decode() == done.metadata.to_json()
    assert str(f.schema_arrow.field("waveform_data_offset").type) == "uint64" and not f.schema_arrow.field("x").nullable
    assert "DELTA_BINARY_PACKED" in f.metadata.row_group(0).column(0).encodings
    table = f.read().to_pandas()
    assert sorted(table["red"] - 10) == list(range(40)) and (table["gps_time"] - 1e6 == table["red"] - 10).all()


def test_several_inputs(spark, tmp_path):
    paths = [str(tmp_path / f"{k}.las") for k in range(3)]
    for path, i, scale in zip(paths, (np.arange(1, 4), np.arange(10, 12), np.arange(3)), (SCALE, SCALE, Transform()), strict=True):
        las.write_las(path, {"x": i, "y": 0 * i, "z": 0 * i, "intensity": i}, scale, 0)
    spark.dataSource.register(las.LasDataSource)
    rows = spark.read.format("las").option("path", ",".join(paths[:2])).load().orderBy("source_index").collect()
    assert [(r["source_index"], r["intensity"], r["red"]) for r in rows] == list(zip(range(5), (1, 2, 3, 10, 11), [None] * 5, strict=True))
    with pytest.raises(ValueError, match="transform differs"):
        las.check_same([las.read_header(p) for p in paths])
    with pytest.raises(ValueError, match="LAZ"):
        las.read_header("a.laz")


def test_files_written_in_tasks(spark, tmp_path):
    """Files of a few points each, in order, over several tasks."""
    df = spark.range(1000, numPartitions=3).selectExpr("cast(999 - id as int) as x", "cast(id % 7 as int) as y", "cast(-id as int) as z", "cast(id * 0.5 as double) as gps", "id as key")
    paths = las.write_las_parts(df, ["key"], f"file://{tmp_path}/parts", SCALE, 3, "WKT", records=90)
    headers = [las.read_header(p) for p in paths]
    las.check_same(headers)
    assert sum(h.count for h in headers) == 1000 and max(h.count for h in headers) <= 90 and headers[0].crs == "WKT"
    spark.dataSource.register(las.LasDataSource)
    rows = spark.read.format("las").option("path", ",".join(paths)).load().orderBy("source_index").collect()
    assert [(r["source_index"], r["x"], r["y"], r["z"], r["gps_time"]) for r in rows] == [(i, 999 - i, i % 7, -i, i * 0.5) for i in range(1000)]
    empty = las.write_las_parts(df.limit(0), ["key"], str(tmp_path / "none"), SCALE)
    assert [las.read_header(p).count for p in empty] == [0]


def test_writing_las_holds_one_file(tmp_path):
    """Memory for the packed records of one file: neither copies of them nor the batches they came from."""
    n, made = 400000, []
    size = n * np.dtype(las.FORMATS[3]).itemsize
    i = np.arange(n, dtype=np.int32)
    columns = {"x": i, "y": i % 7, "z": -i, "gps": i * 0.5}
    batches = (pa.RecordBatch.from_arrays([pa.array(c[at : at + 9000] + k * n) for c in columns.values()], list(columns)) for k in range(2) for at in range(0, n, 9000))
    for write in (lambda: las.write_las(f"{tmp_path}/a.las", columns, SCALE) or [f"{tmp_path}/a.las"], lambda: las.write_batches(batches, f"{tmp_path}/b", SCALE, records=n)):
        tracemalloc.start()
        made += write()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert size < peak < 1.5 * size
    assert [las.read_header(p).count for p in made] == [n] * 3
    assert open(made[0], "rb").read() == open(made[1], "rb").read()
    last = las.read_header(made[2])
    assert np.array_equal(las.records_to_columns(open(made[2], "rb").read()[last.data_offset :], last)["x"], i + n)


def test_las_files_leave_the_driver_out(spark, monkeypatch):
    """No row of the view passes the driver; the files are where executors see them."""
    from pyspark.sql import DataFrame

    from terrapoint.plans import queries
    from terrapoint.plans.tables import shared_folder

    monkeypatch.setattr(queries, "_layouts", {})
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("rows were brought to the driver"))
    paths = queries._las_files(spark, f"{DATA}/sf0.001")
    assert len(paths) >= 2 and all(p.startswith(shared_folder(spark)) for p in paths)
    assert queries.s4_crs(spark, f"{DATA}/sf0.001").collect()[0][0] == 'LOCAL_CS["test"]'


def test_encodings(spark, points, tmp_path):
    """Three encodings of intensity, as the footers name them."""
    want = {"dictionary": ("RLE_DICTIONARY", None), "delta": ("DELTA_BINARY_PACKED", "DICTIONARY"), "plain": ("PLAIN", "DELTA")}
    for name, (has, lacks) in want.items():
        path = str(tmp_path / name)
        few = points.withColumn("intensity", (F.col("intensity") % 2).cast("int"))  # many values fall back from a dictionary
        write(laid_out(few, SCALE, LayoutOptions(levels=2, row_group_size=20, page_rows=10, intensity_encoding=name)), path)
        found = footers(spark, path).filter("column_name = 'intensity'").collect()
        assert found
        for r in found:
            assert has in r["encodings"].split(",") and (lacks is None or lacks not in r["encodings"]), (name, r["encodings"])
        if name != "plain":
            assert all("DELTA_BINARY_PACKED" in r["encodings"] for r in footers(spark, path).filter("column_name in ('x', 'y', 'z')").collect())
        assert PointCloud(spark, path).points.count() == 40
    with pytest.raises(ValueError, match="encoding"):
        LayoutOptions(intensity_encoding="none").check()


def test_files_by_address(spark, tmp_path):
    path = tmp_path / "a.las"
    las.write_las(str(path), record(), SCALE, 10, "WKT")
    spark.dataSource.register(las.LasDataSource)
    for name in (f"file:{path}", f"file://{path}"):
        assert spark.read.format("las").option("path", name).load().count() == 40
    with pytest.raises(Exception, match="scheme|Unrecognized|filesystem"):
        opened("nostore://a/b")
    (tmp_path / "_skipped").mkdir()
    assert files_below(spark, str(tmp_path), ".las") == [f"file:{path}"]
