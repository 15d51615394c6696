"""What the operators share: words, row ids, grouped batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import forget, shared_folder, written

__all__ = ["WORD_BREAK", "forget", "grouped", "shared_folder", "small_batches", "with_row_ids", "written"]

#: A word: code points other than space and \t \n \v \f \r.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
#: Bytes of a batch that goes to a Python worker, about.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of texts that this session sends to Python workers, where a larger bound holds: both
    sides of the pipe hold a whole batch, outside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = str(spark.conf.get(name)).rstrip("b")
    if not have.isdigit() or int(have) > BATCH:
        spark.conf.set(name, f"{BATCH}b")


def with_row_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(rid, id, text): rid is unique and ordered as the ids are. With carry, also rest: all columns, as a struct.

    Where ids are whole, unique and not null, rid is the id. Otherwise rows are ordered by id (null
    first), then text, and numbered; the numbered rows are written, so that they stay the same.
    """
    spark = docs.sparkSession
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *rest)
    names = ["id", "text", *["rest"] * carry]
    clash = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").limit(1)
    if not clash.take(1):
        return rows.select(F.col("id").alias("rid"), *names)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    return written(ordered.select(F.monotonically_increasing_id().alias("rid"), *names))


def grouped(frames: Iterator[pa.RecordBatch], key: str, least: Callable[[pa.Table], int], enough: int) -> Iterator[pa.Table]:
    """Joins the batches of a partition that is sorted by `key` into tables that hold whole groups.

    A table is given out as soon as `least(table)` reaches `enough` at the end of a group.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in frames:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += least(batch)
        if size >= enough:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            cut = int((keys != keys[-1]).nonzero()[0][-1]) + 1 if (keys != keys[-1]).any() else 0
            if cut:
                yield table.slice(0, cut)
                rest = table.slice(cut)
                held = rest.to_batches()
                size = least(rest)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
