"""From points to stored files: levels, packing, order, Parquet and the catalogue beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..operators.levels import cloud_bounds, level_count, level_counts, row_group_ends, with_levels
from ..operators.packing import ORDERS, pack_levels, pack_pages, with_place
from .model import Metadata, Transform
from .tables import forget, written

SIDECAR = "_point_cloud.json"
#: How intensity is encoded. Parquet's Java writer chooses what it uses without a dictionary by the format's version, for all columns: delta
#: for integers in version 2, plain in version 1. So "plain" stores coordinates plain too.
ENCODINGS = ("dictionary", "delta", "plain")


@dataclass(frozen=True)
class LayoutOptions:
    voxel_edge_ratio: int = 2
    coarse_points: int = 8192
    levels: int | None = None
    row_group_size: int = 262_144
    page_rows: int = 8192
    page_order: str = "spatial"
    intensity_encoding: str = "dictionary"
    zstd_level: int = 9

    def check(self) -> None:
        if self.voxel_edge_ratio < 2 or min(self.coarse_points, self.row_group_size, self.page_rows) < 1 or (self.levels is not None and self.levels < 1):
            raise ValueError("ratio must be at least 2, sizes and levels positive")
        if self.page_rows > self.row_group_size:
            raise ValueError("a page can't have more rows than its row group")
        if self.page_order not in ORDERS or self.intensity_encoding not in ENCODINGS:
            raise ValueError("unknown page order or encoding")


@dataclass(frozen=True)
class Packed:
    """points with resolution, row_group, page and place; and what was found on the way."""

    points: DataFrame
    metadata: Metadata
    options: LayoutOptions
    level_points: tuple[int, ...]


def laid_out(points: DataFrame, transform: Transform, options: LayoutOptions | None = None, crs: dict | None = None) -> Packed:
    """Assigns every point its level, row group, page and place. points: x, y, z, source_index (unique), and anything else."""
    options = options or LayoutOptions()
    options.check()
    bounds = cloud_bounds(points)
    if bounds is None:
        raise ValueError("the input has no points")
    ratio = options.voxel_edge_ratio
    levels = options.levels or level_count(points, bounds, transform, ratio, options.coarse_points)
    # only coordinates travel through the shuffles of levels and packing; the other columns join at the end
    keys = points.select("source_index", "x", "y", "z", *[c for c in ("gps_time",) if c in points.columns])
    leveled = written(with_levels(keys, bounds, transform, ratio, levels))
    counts = level_counts(leveled, levels)
    ends = [r["row_group_end"] for r in row_group_ends(counts, options.row_group_size).orderBy("resolution").collect()]  # a row for each level
    sizes = [r["point_count"] for r in counts.orderBy("resolution").collect()]
    placed = with_place(pack_pages(pack_levels(leveled, options.row_group_size), options.page_rows), options.page_order)
    rest = [c for c in points.columns if c not in keys.columns]
    out = placed.join(points.select("source_index", *rest), "source_index") if rest else placed
    world = [transform.decode(bounds.min), transform.decode(bounds.max)]
    metadata = Metadata(transform.scale, transform.offset, (*world[0], *world[1]), tuple(ends), ratio, crs)
    return Packed(out.drop("page_place"), metadata, options, tuple(sizes))


def write(packed: Packed, path: str, source: str | None = None) -> dict:
    """Writes path/resolution=R/*.parquet, the catalogue and the sidecar; gives a summary.

    Tasks get ranges of whole row groups, and the writer's row limits equal the layout's, so Parquet row groups and pages are the
    packed ones. A directory holds one level, so no row group mixes levels. Paths that begin with _ are not read as points.
    """
    if source is not None and source.rstrip("/") == path.rstrip("/"):
        raise ValueError("the output must not be the input")
    spark, o, meta = packed.points.sparkSession, packed.options, packed.metadata
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = packed.points.withColumn("x", F.col("x").alias("x", metadata={"point_cloud": meta.to_json()}))
    ordered = rows.repartitionByRange(n, "resolution", "row_group").sortWithinPartitions("resolution", "row_group", "page", "place")
    writer = ordered.write.mode("overwrite").partitionBy("resolution").option("compression", "zstd")
    for key, value in {
        "parquet.compression.codec.zstd.level": o.zstd_level, "parquet.writer.version": "PARQUET_1_0" if o.intensity_encoding == "plain" else "PARQUET_2_0", "parquet.block.row.count.limit": o.row_group_size,
        "parquet.page.row.count.limit": o.page_rows, "parquet.enable.dictionary#x": "false", "parquet.enable.dictionary#y": "false",
        "parquet.enable.dictionary#z": "false", "parquet.enable.dictionary#gps_time": "false",
        "parquet.enable.dictionary#intensity": str(o.intensity_encoding == "dictionary").lower(),
    }.items():
        writer = writer.option(key, str(value))
    writer.parquet(path)
    stored = spark.read.parquet(path)
    # one scan of the points for both tables: pages are counted and bounded, row groups are sums of pages
    by_page = written(catalog.counted(stored, "page"))
    catalog.row_groups(by_page, meta.transform, meta.voxel_edge_ratio, meta.levels, counted_before=True).write.mode("overwrite").parquet(f"{path}/_catalog/row_groups")
    groups = spark.read.parquet(f"{path}/_catalog/row_groups")
    catalog.pages(by_page, groups, meta.transform, counted_before=True).write.mode("overwrite").parquet(f"{path}/_catalog/pages")
    forget(by_page)
    write_text(spark, f"{path}/{SIDECAR}", meta.to_json())
    return {"points": sum(packed.level_points), "levels": list(packed.level_points), "rowGroups": meta.level_row_group_ends[-1], "bounds": list(meta.bounds)}


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """None if there is no such file."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
