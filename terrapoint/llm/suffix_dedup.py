"""Removes long strings of bytes that occurred earlier, by column-wise Burrows-Wheeler construction.

A transform of whole documents would take a round for each byte of the longest one, each over the whole
corpus. Strings of `window` bytes decide, though, so the collections here hold the segments of
repeats.py, of at most window + 127 bytes each: as many rounds, over shards of about a megabyte,
each of which is complete for the windows it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bcr import repeated_windows
from .common import with_row_ids
from .repeats import CROWD, covered, repeats, runs, slices

GRAM = 24


def _engine(window: int):
    def engine(sym, begin, length, rid, start):
        return repeated_windows(sym, begin, length, rid, start, window)

    return engine


def _remove(window: int, characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            text = batch.column("text").fill_null("").cast(pa.large_binary())
            sizes = pc.binary_length(text).to_numpy().astype(np.int64)
            begin = text.buffers()[1] and np.frombuffer(text.buffers()[1], np.int64)[text.offset]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[begin or 0 :][: sizes.sum()]
            mask = covered(batch.column("spans"), sizes, window)
            if characters:
                of = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)
                broken = np.zeros(len(data) + 1, bool)
                broken[of[mask]] = True
                mask = broken[of]
            left = np.concatenate([[0], np.cumsum(~mask, dtype=np.int32)])[np.concatenate([[0], np.cumsum(sizes)])]
            kept = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[~mask])])
            rest = [x for x in batch.schema.names if x not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in rest), pa.array(sizes), kept.cast(pa.binary()), runs(mask, sizes)], [*rest, "n_bytes", "kept", "removed"])

    return run


def remove_repeated_strings(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, characters: bool = False, crowd: int = CROWD) -> DataFrame:
    """(id, n_bytes, kept, removed) for each row, and with carry also rest, a struct of the row's columns.

    Each byte covered by a string of `window` bytes that also starts earlier (smaller id, or the same
    document and a smaller place) is removed; strings are judged on the input and don't cross documents.
    kept: the remaining bytes, which may split a character; with characters, one that loses a byte goes as a whole. removed: array<struct<begin, end>>, the
    maximal runs. Null texts count as empty. Texts shorter than window stay as they are. Null ids come first;
    rows that share an id are ordered by a hash of their text, so that of repeated rows one stays. An empty
    table gives an empty result. Columns of other names, also "rid" or "spans", don't matter.
    """
    if window < 2 * GRAM:
        raise ValueError(f"window must be at least {2 * GRAM}")
    rows = with_row_ids(docs, id_col, text_col, carry)
    found = repeats(rows, "byte", window, GRAM, _engine(window), True, crowd)
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("removed", T.ArrayType(span))]
    schema = T.StructType([*(f for f in rows.schema if f.name in ("id", "rest")), *new])
    return rows.join(found, "rid", "left").select("id", *["rest"] * carry, "text", "spans").mapInArrow(_remove(window, characters), schema)


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
