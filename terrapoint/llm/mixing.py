"""Mixes sources to target weights by weighted fair queueing. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_BREAK, written

#: Leading hex digits of a document's shuffle key that name its bin: 16 ** BIN bins a source.
BIN = 3


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, WORD_BREAK, -1), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source.

    Sources in code point order, null last, weigh weights[0], weights[1], ..., over and over, and share the total of
    all sizes. A target stops at `most` times its source's size; the excess goes to the others by weight, until
    none is above. Sources that stop are those that would first when the shares grow together, so one
    pass in the order of size / weight finds them. The table has a row for each source, not for each document.
    """
    nth = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("ratio", F.col("source_size") / F.col("weight")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    known = (
        ranked.withColumn("before_cap", F.coalesce(F.sum("cap").over(order), F.lit(0.0)))
        .withColumn("before_weight", F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
    )
    share = (F.col("total") - F.col("before_cap")) / (F.col("all_weight") - F.col("before_weight"))
    stops = F.col("cap") <= share * F.col("weight")
    level = F.max(F.when(~stops, share)).over(everything)
    return known.select("source", "source_size", F.when(stops, F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", bins: int = BIN, size_col: str | None = None) -> DataFrame:
    """(row, size, source_size, target, finish, times): one row for each document; row holds its columns as a struct.

    Each source's documents are shuffled by a hash of id and size, which is the same in every run, and queue up
    once, twice, up to `most` times. A document's virtual finish time is the words of its source up to its
    end, divided by the source's target (see targets()). All are sorted by range of finish time, and the mix
    takes them up to the last finish time at which the words taken stay within the total of all sizes. times: how
    often the mix takes the document; finish: its first finish time.

    Size: words of the text, 0 for null texts, or what size_col has, so that texts need not travel. Null sources are a source of their own. A document of a source
    without words finishes at 0 and is taken once, with no words. Documents of equal key (equal id
    and size) follow each other; equal rows may trade places, which changes no result. Documents that
    finish together are taken or left together. An empty table gives an empty result. Extra columns stay in `row`.
    Prefix sums take two levels: bins of the shuffle key within a source, then documents within a bin, so that no
    task holds a whole source.
    """
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0).cast("long")) if size_col else word_count(F.col(text_col).cast("string"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("string").alias("id"), size.alias("size"))
    key = F.md5(F.concat(F.coalesce("id", F.lit("")), F.lit("|"), F.col("size").cast("string")).cast("binary"))
    rows = rows.withColumn("key", key).withColumn("bin", F.substring("key", 1, bins)).withColumn("named", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    binned = written(rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")))
    by_source = targets(binned.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, float(most))
    before = F.sum("bin_size").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
    offsets = binned.withColumn("before", F.coalesce(before, F.lit(0))).alias("b").join(by_source.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select(F.coalesce("b.source", F.lit("")).alias("named"), F.col("b.source").isNull().alias("none"), "b.bin", "before", "source_size", "target")
    # merged where the window's shuffle has put them: 16 ** bins rows for each of any number of sources are not for a broadcast
    inside = W.partitionBy("named", "none", "bin").orderBy("key", "id").rowsBetween(W.unboundedPreceding, 0)
    queued = (
        rows.withColumn("inside", F.sum("size").over(inside))
        .join(written(offsets).hint("merge"), ["named", "none", "bin"])
        .select("row", "size", "key", "source_size", "target", (F.col("before") + F.col("inside")).alias("through"))
    )
    queued = written(queued)

    def finish(epoch: Column) -> Column:
        return F.when(F.col("target") > 0, (epoch * F.col("source_size") + F.col("through")) / F.col("target")).otherwise(F.lit(0.0))

    epochs = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: finish(e))
    times = queued.filter("size > 0").select("size", "key", F.explode(epochs).alias("finish"))
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = written(times.repartitionByRange(n, "finish").sortWithinPartitions("finish").select("size", "finish", F.spark_partition_id().alias("part")))
    parts = ranged.groupBy("part").agg(F.sum("size").alias("words"))
    parts = parts.withColumn("before", F.coalesce(F.sum("words").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    budget = binned.agg(F.coalesce(F.sum("bin_size"), F.lit(0)).alias("n")).first()["n"]
    # only the part in which the budget ends needs its documents in order
    cut = parts.filter(F.col("before") <= budget).orderBy(F.desc("part")).limit(1).first()
    last = 0.0
    if cut:
        running = F.sum("size").over(W.partitionBy("part").orderBy("finish").rangeBetween(W.unboundedPreceding, 0))
        end = ranged.filter(F.col("part") == cut["part"]).withColumn("through", F.lit(cut["before"]) + running).filter(F.col("through") <= budget)
        whole = ranged.filter(F.col("part") < cut["part"])
        last = end.agg(F.max("finish").alias("f")).unionByName(whole.agg(F.max("finish").alias("f"))).agg(F.coalesce(F.max("f"), F.lit(-1.0)).alias("f")).first()["f"]
    taken = F.size(F.filter(epochs, lambda f: f <= F.lit(last)))
    times_ = F.when(F.col("target") > 0, taken).otherwise(F.lit(1)).cast("long")
    return queued.select("row", "size", "source_size", "target", finish(F.lit(0)).alias("finish"), times_.alias("times"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


SQL = """
with d as (
  select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as size from documents),
k as (select *, md5(coalesce(cast(doc_id as varchar), '') || '|' || cast(size as varchar)) as key from d),
q as (select *, sum(size) over (partition by source order by key, cast(doc_id as varchar) rows unbounded preceding) as through from k),
s0 as (select source, sum(size) as source_size from d group by source),
s1 as (select *, [5.0, 2.0, 1.0][cast((row_number() over (order by source is null, source) - 1) % 3 as int) + 1]::double as weight from s0),
s2 as (select *, source_size / weight as ratio, source_size * 3.0::double as cap from s1),
s3 as (select *, coalesce(sum(cap) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0) as bc,
  coalesce(sum(weight) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0) as bw,
  sum(source_size) over () as total, sum(weight) over () as aw from s2),
s4 as (select *, (total - bc) / (aw - bw) as share from s3),
s as (select source, source_size, total, case when cap <= share * weight then cap
  else max(case when cap > share * weight then share end) over () * weight end as target from s4),
o as (select q.*, s.source_size, s.target, s.total, unnest([0, 1, 2]) as epoch from q join s on q.source is not distinct from s.source),
f as (select *, case when target > 0 then (epoch * source_size + through) / target else 0.0 end as finish from o),
c as (select *, sum(size) over (order by finish range between unbounded preceding and current row) as words from f),
l as (select max(finish) as last from c where words <= total and size > 0)
select doc_id, cast(any_value(size) as bigint) as size, cast(any_value(source_size) as bigint) as source_size, any_value(target) as target,
  cast(sum(case when finish <= last then size else 0 end) as bigint) as taken
from f, l group by doc_id
"""
