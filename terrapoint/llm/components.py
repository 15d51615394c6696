"""Connected components of links, and dealing groups out in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, grouped, written

#: Members of a group that meet in one block, at most about twice as many.
BLOCK = 1024


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the least node that links reach.

    Large-star and small-star rounds (Kiveris et al., 2014): each round points neighbours at the least node
    nearby, so the number of rounds grows with the logarithm of the longest path. Each round's links are
    written; the sides of its joins are tables, so Spark can split a node with very many links.
    """
    edges = written(links.select("a", "b").filter("a <> b").distinct())
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        forget(least)
        # now every link points down; each node's links move to its least neighbour
        least = written(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        moved = large.select(F.col("a").alias("u"), "b").join(least, "u").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = written(moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct())
        forget(least)
        forget(large)
        signs = [x.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first() for x in (edges, small)]
        forget(edges)
        edges = small
        if signs[0] == signs[1]:
            stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index that each of n items reaches by the pairs (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def dealt(rows: DataFrame, spread: str, block: int | None = None, alone: bool = False) -> DataFrame:
    """rows (key, ...) in which at least two share a key, with `block` and `chunk`. With alone, all rows: then only keys
    of over `block` rows, of which there are few, are joined to the rows.

    Groups of over `block` (BLOCK) rows are cut into chunks by a hash of column `spread`, and each pair of chunks is a block:
    two rows of a group meet in one block. Rows of one chunk meet in the block of that chunk with itself; elsewhere
    only rows of different chunks are to be compared.
    """
    block = block or BLOCK
    sizes = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > (block if alone else 1)).select("key", F.ceil(F.col("n") / block).cast("int").alias("chunks")))
    met = rows.join(sizes, "key", "left" if alone else "inner").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64("key", spread), F.col("chunks")).cast("int")
    met = met.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.struct(F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    return met.withColumn("block", F.xxhash64("key", pair["i"], pair["j"])).withColumn("alone", F.col("chunk") == F.col("other")).drop("chunks", "other")


def per_block(rows: DataFrame, compare: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """compare(rows of one block) for each block, in the tasks that the blocks are dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "block", lambda t: t.num_rows, 1):
            block = table.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for b, e in zip(edges[:-1], edges[1:], strict=True):
                if e - b > 1:
                    yield from compare(table.slice(b, e - b))

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)
