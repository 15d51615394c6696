"""Point clouds seen in tables that hold none, and the stored schema."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import Transform

#: The transform of the views below.
VIEW = Transform((0.01, 0.01, 0.01), (0.0, 0.0, 0.0))

#: The stored columns in file order, with Spark's type and whether null is allowed.
STORED = (
    ("x", "int", False), ("y", "int", False), ("z", "int", False),
    ("red", "int", True), ("green", "int", True), ("blue", "int", True),
    ("intensity", "int", False), ("return_number", "smallint", False), ("number_of_returns", "smallint", False),
    ("scan_direction_flag", "boolean", False), ("edge_of_flight_line", "boolean", False), ("classification", "smallint", False),
    ("synthetic", "boolean", False), ("key_point", "boolean", False), ("withheld", "boolean", False), ("overlap", "boolean", False),
    ("scanner_channel", "smallint", False), ("scan_angle", "float", False), ("user_data", "smallint", False),
    ("point_source_id", "int", False), ("gps_time", "double", True), ("nir", "int", True),
    ("wave_packet_descriptor_index", "smallint", True), ("waveform_data_offset", "decimal(20,0)", True), ("waveform_packet_size", "bigint", True),
    ("return_point_waveform_location", "float", True), ("waveform_x_t", "float", True), ("waveform_y_t", "float", True), ("waveform_z_t", "float", True),
    ("extra_bytes", "binary", True),
)
#: The greatest value of unsigned columns, which Spark stores in a wider type.
UNSIGNED = {
    **dict.fromkeys(("red", "green", "blue", "intensity", "point_source_id", "nir"), 65535),
    **dict.fromkeys(("return_number", "number_of_returns", "classification", "scanner_channel", "user_data", "wave_packet_descriptor_index"), 255),
    "waveform_packet_size": 4294967295, "waveform_data_offset": 18446744073709551615,
}


def events_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as points: user, second of the day and value, with made-up intensity and colour (null for every tenth)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    event = F.col("event_id")

    def color(factor: int) -> Column:
        return F.when(event % 10 == 0, F.lit(None)).when(event % 10 == 1, F.lit(0)).otherwise((event * factor) % 65536).cast("int")

    return events.select(
        event.cast("long").alias("source_index"),
        (F.col("user_id") * 1000).cast("int").alias("x"),
        (F.floor(micros / 1000000) % 86400).cast("int").alias("y"),
        F.round(F.col("value") * 100).cast("int").alias("z"),
        color(431).alias("red"), color(257).alias("green"), color(911).alias("blue"),
        ((event * 7) % 65536).cast("int").alias("intensity"),
        (event % 5).cast("smallint").alias("classification"),
        (micros / F.lit(1e6)).alias("gps_time"),
    )


#: The same in DuckDB.
EVENTS_SQL = """select event_id::bigint as source_index, (user_id * 1000)::int as x, ((epoch_us(ts) // 1000000) % 86400)::int as y,
  round(value * 100)::int as z,
  (case event_id % 10 when 0 then null when 1 then 0 else (event_id * 431) % 65536 end)::int as red,
  (case event_id % 10 when 0 then null when 1 then 0 else (event_id * 257) % 65536 end)::int as green,
  (case event_id % 10 when 0 then null when 1 then 0 else (event_id * 911) % 65536 end)::int as blue,
  ((event_id * 7) % 65536)::int as intensity, (event_id % 5)::smallint as classification, epoch_us(ts) / 1e6 as gps_time from events"""


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as points, for measurements; source_index numbers rows by all columns, as no key is unique."""
    from ..operators.ranks import ranked

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = [c for c in rows.columns]
    xyz = {"x": (F.col("l_partkey") * 100).cast("int"), "y": (F.col("l_suppkey") * 100).cast("int"), "z": F.round(F.col("l_extendedprice") * 100).cast("int")}
    return ranked(rows, [], keys, "source_index").select("source_index", *[c.alias(a) for a, c in xyz.items()])


def complete(points: DataFrame) -> DataFrame:
    """points with all stored columns, in order: missing required ones are 0 or false, missing optional ones null."""
    out = []
    for name, kind, optional in STORED:
        if name in points.columns:
            out.append(F.col(name).cast(kind).alias(name))
        else:
            missing = F.lit(None) if optional else F.lit(False) if kind == "boolean" else F.lit(0)
            out.append(missing.cast(kind).alias(name))
    return points.select(*out, *[c for c in points.columns if c not in {n for n, _, _ in STORED}])


def broken(points: DataFrame) -> DataFrame:
    """(column, nulls, out_of_range, mixed) for stored columns: nulls where none may be, values beyond the unsigned type, and optional
    columns that only some points have."""
    have = [(n, k, o) for n, k, o in STORED if n in points.columns]
    total = F.count(F.lit(1))
    rows = []
    for name, _, optional in have:
        c = F.col(name)
        wide = F.count_if((c < 0) | (c > F.lit(Decimal(UNSIGNED[name])))) if name in UNSIGNED else F.lit(0).cast("long")
        nulls = F.count_if(c.isNull())
        mixed = (nulls > 0) & (nulls < total) if optional else F.lit(False)
        rows.append(F.struct(F.lit(name).alias("column"), (F.lit(0).cast("long") if optional else nulls).alias("nulls"), wide.alias("out_of_range"), mixed.alias("mixed")))
    return points.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
