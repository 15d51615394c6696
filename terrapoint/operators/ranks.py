"""Row numbers over a whole table or large groups, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import written


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with `name`, each row's place from 0 in its group by `order`; ties are broken by nothing, so order must be total.

    Rows are sorted by range over all tasks and written; a table of (task, group) counts, small, gives the
    offsets. The place within a task and group is a window over that task's rows.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [*groups, *order]
    parts = written(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", *groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part", *groups).orderBy(*order)) - 1
    return parts.withColumn(name, inside).join(offsets, ["_part", *groups]).withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
