"""Byte-level BPE over Arrow batches, with the tokenizers library.

The vocabulary's file (a tokenizer.json) is read on the driver and sent along, about 1.5 MB, so executors need no
copy of it. Texts are split by the vocabulary's own pattern; nothing is a special token. Long texts are encoded
in pieces cut where the pattern always ends a match, so memory follows the piece.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a piece of a long text, about.
PIECE = 1 << 16
#: Fixed value: the pattern by which such vocabularies split text before merging.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

#: A space between ASCII letters ends one match and begins the next, whatever stands around it.
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else the
    next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(shown)))
    return out


def pieces(text: str) -> list[str]:
    """Cuts a long text where no match of the pattern runs across."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = _CUT.search(text, at + PIECE)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def token_bytes(tokenizer: str) -> list[bytes]:
    """The bytes of each id, from the text of a tokenizer.json; empty for ids that the vocabulary doesn't have."""
    own = {c: b for b, c in byte_characters().items()}
    spec = json.loads(tokenizer)
    vocab = spec["model"]["vocab"]
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    out = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for token, i in vocab.items():
        out[i] = bytes(own[c] for c in token)
    for token, i in added.items():
        out[i] = token.encode()
    return out


def _load(tokenizer: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    before = json.loads(tokenizer)
    split = before.get("pre_tokenizer") or {}
    if before.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
        raise ValueError("the vocabulary must be byte-level, without normalizer and prefix space")
    out = Tokenizer.from_str(tokenizer)
    out.encode_special_tokens = True
    return out


#: Ids of matches that this worker has met, as bytes of int32, by vocabulary.
_known: dict[int, dict[str, bytes]] = {}
#: Matches that a worker remembers, about 200 MB; then it begins anew.
REMEMBERED = 1_000_000


def _lists(parts: list[list[bytes]]) -> pa.ListArray:
    counts = [sum(map(len, x)) // 4 for x in parts]
    flat = np.frombuffer(b"".join(y for x in parts for y in x), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), pa.int32()), pa.array(flat))


def _by_match(tokenizer, known: dict[str, bytes], texts: list[str]) -> list[list[bytes]]:
    """Ids of each text. A match of the pattern has the same ids wherever it stands, so the library encodes each
    different match once, a batch at a time."""
    split = [[PATTERN.findall(p) for p in pieces(t)] for t in texts]
    met = set()
    for parts in split:
        met.update(*parts)
    if len(known) + len(met) > REMEMBERED:
        known.clear()
    new = [m for m in met if m not in known]
    for k in range(0, len(new), 10_000):
        some = new[k : k + 10_000]
        for m, x in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
            known[m] = array("i", x.ids).tobytes()
    return [[b"".join(map(known.__getitem__, p)) for p in parts] for parts in split]


def _with_offsets(tokenizer, texts: list[str]) -> tuple[list[list[bytes]], list[list[dict]]]:
    ids, spans = [], []
    for text in texts:
        shift, parts, found = 0, [], []
        for p in pieces(text):
            x = tokenizer.encode(p, add_special_tokens=False)
            parts.append(array("i", x.ids).tobytes())
            found += [{"begin": b + shift, "end": e + shift} for b, e in x.offsets]
            shift += len(p)
        ids.append(parts)
        spans.append(found)
    return ids, spans


def _encode(sent, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _load(sent.value)
        known = _known.setdefault(hash(sent.value), {})
        for whole in batches:
            for k in range(0, whole.num_rows, 100):
                batch = whole.slice(k, 100)
                texts = [x or "" for x in batch.column("text").to_pylist()]
                rest = [x for x in batch.schema.names if x != "text"]
                columns = [batch.column(x) for x in rest]
                if offsets:
                    ids, spans = _with_offsets(tokenizer, texts)
                    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                    yield pa.RecordBatch.from_arrays([*columns, _lists(ids), pa.array(spans, span)], [*rest, "ids", "offsets"])
                else:
                    yield pa.RecordBatch.from_arrays([*columns, _lists(_by_match(tokenizer, known, texts))], [*rest, "ids"])

    return run


def encoded(docs: DataFrame, tokenizer_file: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """All columns of docs but the text, then ids, array<int>, and on request offsets, array<struct<begin, end>> in characters.

    tokenizer_file: a byte-level BPE tokenizer.json, on the driver. Null and empty texts have no ids. Each row is
    encoded by itself and whole: repeated rows and ties don't matter, an empty table gives an empty result, columns
    named ids or offsets give way to the new ones, and other columns pass through, nulls included.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text())
    new = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if offsets:
        span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
        new.append(T.StructField("offsets", T.ArrayType(span)))
    rest = [c for c in docs.columns if c not in (text_col, "text", *(f.name for f in new))]
    rows = docs.select(*[docs[f"`{c}`"] for c in rest], docs[f"`{text_col}`"].cast("string").alias("text"))
    return rows.mapInArrow(_encode(sent, offsets), T.StructType([*(f for f in rows.schema if f.name != "text"), *new]))


def _decode(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(sent.value)
        size = np.array([len(x) for x in tokens])
        data, first = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                lists = part.column("ids").fill_null([])
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                n = size[ids]
                ends = np.concatenate([[0], np.cumsum(n)])
                out = data[np.arange(ends[-1]) + np.repeat(first[ids] - ends[:-1], n)]
                offsets = lists.offsets.to_numpy()
                edges = ends[offsets - offsets[0]]
                decoded = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, decoded.cast(pa.binary())], [*part.schema.names, "decoded"])

    return run


def decoded(rows: DataFrame, tokenizer_file: str) -> DataFrame:
    """All columns of rows, which has ids, and decoded, the bytes that the ids stand for.

    The byte table is reversed and bytes are joined, so characters split between ids come out whole; ids
    cut from the middle of a text may begin or end within a character, for which see characters(). Null lists have no bytes.
    """
    sent = rows.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text())
    rows = rows.select(*[c for c in rows.columns if c != "decoded"])
    return rows.mapInArrow(_decode(sent), T.StructType([*rows.schema, T.StructField("decoded", T.BinaryType())]))


def characters(parts: list[bytes]) -> list[str]:
    """Text of consecutive byte strings; a character split between two of them goes to the one that ends it, and bytes that make
    no character become U+FFFD."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    return [decoder.decode(p, i + 1 == len(parts)) for i, p in enumerate(parts)]


def digest(rows: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
