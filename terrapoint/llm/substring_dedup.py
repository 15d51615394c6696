"""Removes passages of words that occur more than once, by suffix automata of reference shards.

Sending an automaton of each shard of the corpus past every document would cost the square of the corpus. A
shard here is a set of minimizers (see repeats.py): its reference strings are all different segments under
those, and only documents' segments under the same minimizers stream through its automaton, in the task that built
it. No other segment can match 35 of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import with_row_ids
from .repeats import CROWD, covered, repeats, runs, slices

GRAM = 8
#: Words of one reference shard, about; segments that share a minimizer stay together.
REFERENCE = 1 << 15


def _engine(window: int):
    def engine(sym, begin, length, rid, start):
        words = sym.tolist()
        strings = [words[b : b + n] for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
        reference = SuffixAutomaton(strings)
        string, offset = [], []
        for i, s in enumerate(strings):
            for end, (n, places) in enumerate(reference.matching(s, window)):
                if n == window and places > 1:
                    string.append(i)
                    offset.append(end - window + 1)
        return np.array(string, np.int64), np.array(offset, np.int64)

    return engine


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            texts = batch.column("text").fill_null("").cast(pa.binary()).to_pylist()
            split = [x.split() for x in texts]  # at the same six bytes as segments.word_bounds()
            sizes = np.array([len(x) for x in split], np.int64)
            mask = covered(batch.column("spans"), sizes, window)
            kept, at = [], 0
            for words, n in zip(split, sizes.tolist(), strict=True):
                kept.append(b" ".join(compress(words, ~mask[at : at + n])))
                at += n
            new = [pa.array(sizes), pa.array(kept, pa.binary()).cast(pa.string()), runs(mask, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *new], ["id", "n_words", "kept", "removed"])

    return run


def remove_repeated_passages(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(id, n_words, kept, removed) for each row.

    Each word covered by `window` consecutive words that also start anywhere else, in this document or another,
    is removed, in every place; passages are judged on the input. Words are runs of bytes other than \\x20
    and \\x09-\\x0D, unchanged. kept: the remaining words, joined by one space. removed:
    array<struct<begin, end>>, the maximal runs, counted in words. Null and empty texts have no words. Rows that
    share an id, or are equal, count as documents of their own. An empty table gives an empty result.
    Other columns are not read, whatever their names.
    """
    if window < 2 * GRAM:
        raise ValueError(f"window must be at least {2 * GRAM}")
    rows = with_row_ids(docs, id_col, text_col)
    found = repeats(rows, "word", window, GRAM, _engine(window), False, crowd, REFERENCE)
    schema = "id long, n_words long, kept string, removed array<struct<begin:long,end:long>>"
    return rows.join(found, "rid", "left").select("id", "text", "spans").mapInArrow(_remove(window), schema)


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
