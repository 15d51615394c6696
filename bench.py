"""Times headline queries; prints one JSON line.

The five standard boxes (a cube, three thin slabs, a large one) run over the stored layout, each as a full read of the matching points'
six columns: one warm-up, then the median of three. Layout, levels and expressions are timed over the whole cloud.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from terrapoint.operators import analysis, catalog, levels, packing, selection  # noqa: E402
from terrapoint.plans import queries as q  # noqa: E402
from terrapoint.plans.layout import LayoutOptions, laid_out, write  # noqa: E402
from terrapoint.plans.cloud import PointCloud  # noqa: E402
from terrapoint.plans.model import Box, query_set  # noqa: E402
from terrapoint.sources.points import VIEW, events_points  # noqa: E402


def consumed(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(f, runs: int = 3) -> float:
    f()
    out = []
    for _ in range(runs):
        began = time.perf_counter()
        f()
        out.append(time.perf_counter() - began)
    return round(median(out), 4)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out: dict[str, float] = {}
    points = events_points(spark, folder).cache()
    points.count()
    began = time.perf_counter()
    path = f"{tempfile.mkdtemp()}/cloud"
    options = LayoutOptions(voxel_edge_ratio=q.RATIO, levels=q.LEVELS, row_group_size=8192, page_rows=512)
    write(laid_out(points, VIEW, options), path)
    out["layout"] = round(time.perf_counter() - began, 4)
    cloud = PointCloud(spark, path)
    b = levels.cloud_bounds(points)
    extent = Box(VIEW.decode(b.min), VIEW.decode(b.max))
    center = [v * 0.01 for v in analysis.representative_center(points).first()]
    level = cloud.metadata.levels - 1
    for name, box in query_set(extent, center).items():
        out[f"box-{name}"] = timed(lambda box=box: consumed(cloud.query_world(box, level)))
    out["levels"] = timed(lambda: consumed(levels.with_levels(points, b, VIEW, q.RATIO, q.LEVELS)), 1)
    leveled = levels.with_levels(points, b, VIEW, q.RATIO, q.LEVELS).cache()
    out["pack"] = timed(lambda: consumed(packing.pack_pages(packing.pack_levels(leveled, 8192), 512)), 1)
    out["hilbert"] = timed(lambda: consumed(packing.with_place(packing.pack_pages(packing.pack_levels(leveled, 8192), 512), "hilbert")), 1)
    out["select"] = timed(lambda: selection.selected(cloud.groups, q.ERRORS, q.WORLD, q.VIEWER).collect())
    out["metrics"] = timed(lambda: catalog.metrics(cloud.groups, cloud.query_quantized(q.BOX, 1), q.BOX, 1).collect())
    for name in ("p9_priority", "p16_point_color", "f1_f2_point_in_box", "f1_lineitem_box", "l2_occupied_voxels", "a10_a11_medians"):
        out[name] = timed(lambda name=name: consumed(q.QUERIES[name](spark, folder)))
    total = round(sum(v for k, v in out.items() if k.startswith("box-")), 4)
    rows = cloud.points.agg(F.count(F.lit(1))).first()[0]
    print(json.dumps({"metric": "sum of the medians of five box queries", "value": total, "unit": "sec", "queries": out, "sf": os.path.basename(folder.rstrip("/")), "points": rows, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
