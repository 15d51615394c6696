"""Finds windows of symbols that occur more than once in a collection of documents.

The plan, for any unit (bytes, words):

1. Minimizers are counted, with partial sums in each task; those met once can't belong to a repeat.
2. Segments (see segments.py) whose minimizer is repeated stay: a semi-join, whose skewed side Spark can split.
3. Equal segments fold into their first one (a hash aggregation). A segment that is alone under its
   minimizer is settled. The texts of all others are cut from the documents.
4. An engine compares the folded segments that share a minimizer, a bounded shard of them at a time, cut down
   to the windows that share enough around the minimizer with another to have an equal. Minimizers with
   over `crowd` different segments, such as those at the ends of a passage that many documents share, are cut
   into ever narrower pieces that fold by partial aggregation instead, so no task meets them all.
5. Verdicts return to every occurrence, then to the documents, by joins.

Tables between the steps are written to the shared folder. Strings are named by 128 bits; the engine compares
the bytes or words themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments as S
from .common import forget, grouped, small_batches, written

#: Different segments under one minimizer that an engine compares at once.
CROWD = 400
#: Symbols of one shard, about.
SHARD = 1 << 20
#: Bytes of texts that a task takes at a time, about.
SLICE = 1 << 21

#: engine(symbols of all strings, begin, length, rid, start) -> (string, offset) of each window found.
Engine = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int, column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A few rows at a time: at most `rows`, and about `most` bytes of a column of texts, or else one longer text."""
    for batch in batches:
        through = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(through, (through[at - 1] if at else 0) + most, "right"))
            to = min(max(to, at + 1), at + rows)
            yield batch.slice(at, to - at)
            at = to


def _symbols(unit: str) -> Callable[[bytes], np.ndarray]:
    return S.byte_symbols if unit == "byte" else S.word_symbols


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _minimizers(unit: str, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            parts = (_symbols(unit)(x) for x in _bytes(batch.column("text")))
            for sym, ends, _, _ in S.chunks(parts, window):
                m, c = np.unique(S.minimizers(sym, ends, window, gram), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(m)), pa.array(c.astype(np.int64))], ["m", "c"])

    return run


def _segments(unit: str, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            rid = batch.column("rid").to_numpy()
            parts = (_symbols(unit)(x) for x in _bytes(batch.column("text")))
            for sym, ends, owner, shift in S.chunks(parts, window):
                s = S.segments(sym, ends, window, gram)
                doc = np.searchsorted(ends, s.start, "right")
                place = (s.start + shift[doc]) << 9 | s.multi.astype(np.int64) << 8 | s.n
                columns = [_signed(s.m), _signed(s.h), rid[owner[doc]], place]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["m", "h", "rid", "place"])

    return run


def _cut(unit: str, window: int):
    """Cuts the listed segments from each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            lists = batch.column("listed")
            flat, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
            m, h, place = (flat.field(x) for x in ("m", "h", "place"))
            start, n = place.to_numpy() >> 9, place.to_numpy() & 255
            strings, at = [], 0
            begin, end = start.tolist(), (start + n + window - 1).tolist()
            for text, k in zip(_bytes(batch.column("text")), count.tolist(), strict=True):
                spans = zip(begin[at : at + k], end[at : at + k], strict=True)
                if unit == "byte":
                    strings += [text[b:e] for b, e in spans]
                else:
                    words = text.split()
                    strings += [b" ".join(words[b:e]) for b, e in spans]
                at += k
            rid = pa.array(np.repeat(batch.column("rid").to_numpy(), count))
            yield pa.RecordBatch.from_arrays([m, h, rid, pa.array(start), pa.array(n), pa.array(strings, pa.binary())], ["m", "h", "rid", "start", "n", "string"])

    return run


STRING = "m long, h long, rid long, start long, n long, string binary"


def _pieces(unit: str, window: int, gram: int, width: int):
    """Cuts pieces (see segments.pieces) from the windows [offset, offset + n) of each string.

    key: what all windows of the piece's kind share; name: the whole piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, "string"):
            out: list[tuple] = []
            for r in batch.to_pylist():
                string = r["string"]
                words = string.split() if unit == "word" else []
                part = (lambda b, e, s=string: s[b:e]) if unit == "byte" else (lambda b, e, s=words: b" ".join(s[b:e]))
                for o, n, b, e in zip(*(x.tolist() for x in S.pieces(_symbols(unit)(string), r["n"], r["m"] & (1 << 64) - 1, window, gram, width)), strict=True):
                    content = part(o, o + n + window - 1)
                    key = xxhash.xxh3_128_digest(part(b, e))
                    out.append((r["m"], r["h"], r["rid"], r["start"] + o, r["offset"] + o, n, content, key, xxhash.xxh3_128_digest(content)))
            columns = zip(*out, strict=True) if out else [()] * 9
            types = [pa.int64()] * 6 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], ["m", "h", "rid", "start", "offset", "n", "string", "key", "name"])

    return run


def _crowded(strings: DataFrame, unit: str, window: int, gram: int, spare_first: bool, tables: list[DataFrame]) -> DataFrame:
    """(m, h, hits) for strings under crowded minimizers, by folding ever narrower pieces of them.

    Pieces that are equal fold by partial aggregation. Different pieces with equal shared symbols go on to be cut
    more narrowly; pieces of single windows, at last, are equal or have nothing to share.
    """
    schema = "m long, h long, rid long, start long, offset long, n long, string binary, key binary, name binary"
    left, found = strings.withColumn("offset", F.lit(0).cast("long")), []
    for width in (24, 6, 1):
        cut = written(left.mapInArrow(_pieces(unit, window, gram, width), schema))
        folded = written(cut.groupBy("key", "name").agg(F.min(F.struct("rid", "start")).alias("first"), F.count(F.lit(1)).alias("times")))
        tables += [cut, folded]
        hits = cut.select("m", "h", "rid", "start", "offset", "n", "name").join(folded.filter("times > 1").select("name", "first"), "name")
        if spare_first:
            hits = hits.filter(F.struct("rid", "start") != F.col("first"))
        found.append(hits.select("m", "h", (F.shiftleft("offset", 9) + F.col("n")).alias("hit")))
        if width == 1:
            break
        several = written(folded.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("key"))
        tables.append(several)
        open_ = folded.join(several, "key", "left_semi").select("name", F.col("first.rid").alias("rid"), F.col("first.start").alias("start"))
        left = cut.join(open_, ["name", "rid", "start"], "left_semi").drop("key", "name")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every.groupBy("m", "h").agg(F.collect_list("hit").alias("hits"))


def _shards(table: pa.Table, length: np.ndarray, most: int) -> Iterator[slice]:
    """Cuts rows that are sorted by m where m changes, after `most` symbols or more."""
    m = table.column("m").to_numpy()
    edges = np.append(np.flatnonzero(m[1:] != m[:-1]) + 1, len(m))
    total, at = np.concatenate([[0], np.cumsum(length)]), 0
    for e in edges.tolist():
        if total[e] - total[at] >= most or e == len(m):
            yield slice(at, e)
            at = e


def _distinct(strings: list[bytes]) -> np.ndarray:
    """A number for each word of the strings, the same for equal words only."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for s in strings for w in s.split()), np.int64)


def _compare(unit: str, window: int, gram: int, engine: Engine, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "m", lambda t: pc.sum(t.column("n")).as_py() + t.num_rows * (window - 1), most):
            lengths = table.column("n").to_numpy() + window - 1
            for rows in _shards(table, lengths, most):
                shard, length = table.slice(rows.start, rows.stop - rows.start), lengths[rows]
                strings = shard.column("string").to_pylist()
                m, h = shard.column("m").to_numpy(), shard.column("h").to_numpy()
                sym = np.frombuffer(b"".join(strings), np.uint8) if unit == "byte" else _distinct(strings)
                hashed = S.byte_symbols(sym) if unit == "byte" else S.word_symbols(b" ".join(strings))
                first, last = S.partners(hashed, np.cumsum(length) - length, length, m.view(np.uint64), window, gram)
                paired = np.flatnonzero(first <= last)
                if not len(paired):
                    continue
                begin, first = (np.cumsum(length) - length)[paired] + first[paired], first[paired]
                length, m, h = last[paired] - first + window, m[paired], h[paired]
                at = np.cumsum(length) - length
                sym = sym[np.arange(length.sum()) + np.repeat(begin - at, length)]
                rid, start = (shard.column(x).to_numpy()[paired] for x in ("rid", "start"))
                string, offset = engine(sym, at, length, rid, start + first)
                if not len(string):
                    continue
                offset = offset + first[string]
                by = np.lexsort((offset, string))
                string, offset = string[by], offset[by]
                # runs of consecutive windows of one string
                edge = np.flatnonzero(np.concatenate([[True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)]))
                hit = offset[edge] << 9 | np.diff(np.append(edge, len(offset)))
                which, head = np.unique(string[edge], return_index=True)
                hits = pa.ListArray.from_arrays(pa.array(np.append(head, len(hit)), pa.int32()), pa.array(hit, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(m[which]), pa.array(h[which]), hits], ["m", "h", "hits"])

    return run


def repeats(rows: DataFrame, unit: str, window: int, gram: int, engine: Engine, spare_first: bool, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """(rid, spans): for each document with repeats, the windows found, as an array of start * 512 + n: n
    consecutive windows, of which the first starts at symbol `start`.

    rows: (rid, text) with unique rid; null texts hold nothing. A window is found if it occurs more than once; with
    spare_first, only if it also starts earlier (smaller rid, or same rid and smaller start).
    """
    small_batches(rows.sparkSession)
    texts = rows.select("rid", "text").filter("text is not null")
    repeated = written(texts.select("text").mapInArrow(_minimizers(unit, window, gram), "m long, c long").groupBy("m").agg(F.sum("c").alias("c")).filter("c > 1").select("m"))
    segs = texts.mapInArrow(_segments(unit, window, gram), "m long, h long, rid long, place long")
    kept = written(segs.join(repeated, "m", "left_semi"))
    forget(repeated)
    folded = written(kept.groupBy("m", "h").agg(F.min(F.struct("rid", "place")).alias("first"), F.count(F.lit(1)).alias("times")))
    multi = F.col("first.place").bitwiseAND(256) > 0
    shared = written(folded.groupBy("m").agg(F.count(F.lit(1)).alias("kinds"), F.max(multi).alias("multi")).filter("kinds > 1 or multi"))
    open_ = folded.join(shared, "m").select("m", "h", F.col("first.rid").alias("rid"), F.col("first.place").alias("place"), (F.col("kinds") > crowd).alias("crowded"))
    tables = [folded, shared]

    def cut(crowded: bool) -> DataFrame:
        mine = open_.filter("crowded" if crowded else "not crowded")
        lists = mine.groupBy("rid").agg(F.collect_list(F.struct("m", "h", "place")).alias("listed"))
        return texts.join(lists, "rid").mapInArrow(_cut(unit, window), STRING)

    found = cut(False).repartition("m").sortWithinPartitions("m").mapInArrow(_compare(unit, window, gram, engine, shard), "m long, h long, hits array<long>")
    if shared.filter(F.col("kinds") > crowd).limit(1).take(1):
        found = found.unionByName(_crowded(cut(True), unit, window, gram, spare_first, tables))
    verdicts = written(folded.join(found, ["m", "h"], "left"))
    for table in tables:
        forget(table)
    whole = F.struct("rid", "place") != F.col("first") if spare_first else F.col("times") > 1
    start = F.shiftright("place", 9)
    hit = kept.join(verdicts, ["m", "h"]).filter(whole | F.col("hits").isNotNull())
    spans = F.when(whole, F.array(F.shiftleft(start, 9) + F.col("place").bitwiseAND(255))).otherwise(F.transform("hits", lambda x: F.shiftleft(start, 9) + x))
    return hit.select("rid", spans.alias("spans")).groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def covered(spans: pa.Array, sizes: np.ndarray, window: int) -> np.ndarray:
    """Which symbols lie in one of the windows, for documents of these sizes, laid end to end."""
    total, begin = int(sizes.sum()), np.cumsum(sizes) - sizes
    spans = spans.fill_null([])
    flat = spans.flatten().to_numpy(zero_copy_only=False)
    start = (flat >> 9) + np.repeat(begin, np.diff(spans.offsets.to_numpy()))
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, start, 1)
    np.subtract.at(edge, start + (flat & 511) + window - 1, 1)
    np.cumsum(edge, out=edge)
    return edge[:total] > 0


def runs(mask: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Begin and end of each run of true values in each document, as array<struct<begin, end>>."""
    ends = np.cumsum(sizes)
    new = np.zeros(len(mask) + 1, bool)
    new[np.concatenate([[0], ends])] = True
    before = np.concatenate([[False], mask])
    after = np.concatenate([mask, [False]])
    first = np.flatnonzero(after & (new | ~before))
    last = np.flatnonzero(before & (new | ~after))
    owner = np.searchsorted(ends, first, "right")
    shift = (ends - sizes)[owner]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(first - shift), pa.array(last - shift)], ["begin", "end"]))
