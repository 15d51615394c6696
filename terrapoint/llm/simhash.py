"""Near-duplicates by SimHash and anchor-point covering.

A fingerprint's 64 bits are cut into parts A, B and C of 23, 23 and 18 bits. Anchors are the words of product codes: for A or B the
perfect binary Golay code, whose covering radius is 3, times all words (radius 0) over bits of another part. Each
fingerprint has one home anchor within 3 in the Golay part, and goes to every anchor within 3 + 1 there, 5.3 on average, and to its own
word in the exact part. So it meets, at a home anchor, all that differ in at most one bit of the Golay part and in none of the
exact one. With B1, B2 and C1, C2 the halves of B and C, and A1, A2, A3 the thirds of A, two fingerprints that differ in 4 bits or less

* differ in at most one bit of A and of B, and so meet at A x B1 or A x B2;
* or are equal in A, or in B, and meet there (code of all words);
* or else differ in at most two bits of A and of B and one of C: they meet at one of the 18 products of a third of A, a third of B and a half of C;
* or else differ in three bits of A or of B, one of the other and none of C: they meet at C x B1 or C x B2, or at C x A1 or C x A2.

Here B1, B2, A1, A2, C1 and C2 are halves. A fingerprint goes to 35 anchors, whatever the corpus holds, among 2^23 to 2^30 of each kind. Different
fingerprints are compared at each anchor; equal ones fold before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import grouped, small_batches, written
from .components import components, dealt, local_roots

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
_LANE = np.arange(8) * 256

#: Fixed value: generator polynomial of the binary Golay code of length 23, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
RADIUS = 3
#: Fingerprints that meet in one block, at most about twice as many.
BLOCK = 4096
#: Blocks of at most so many fingerprints are compared together, so many rows or a little more at a time.
SMALL = 64
TOGETHER = 1 << 16


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of a text: a bit is 1 if set in over half the XXH64 hashes of the word shingles, repeats included."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[b:e], 42) for b, e in zip(starts, ends[shingle - 1 :] or ends[-1:], strict=False)])
    lanes = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.bincount((lanes + _LANE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(lanes)).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(x or b"", shingle) for x in texts], np.uint64)
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(prints.view(np.int64))], [*names, "print"])

    return run


def _remainder(words: np.ndarray) -> np.ndarray:
    """Of 23-bit words as polynomials, divided by the generator: 0 for the words of the code."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GOLAY << (bit - 11), 0)
    return words


def _errors(most: int) -> list[np.ndarray]:
    """For each remainder, all 23-bit words of at most `most` ones that have it."""
    every = np.arange(1 << 23)
    every = every[np.bitwise_count(every) <= most]
    rest = _remainder(every)
    by = np.lexsort((np.bitwise_count(every), rest))
    return np.split(every[by], np.flatnonzero(np.diff(rest[by])) + 1)


def anchors(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all anchors that fingerprints go to, and the place of the fingerprint that each one is of."""
    if not _near:
        lists = _errors(RADIUS + 1)
        width = max(map(len, lists))
        _near.append(np.array([[*x, *[-1] * (width - len(x))] for x in lists]))
    part = lambda shift, size: (bits >> np.uint64(shift)).astype(np.int64) & (1 << size) - 1
    a, b, c, every = part(41, 23), part(18, 23), part(0, 18), np.arange(len(bits))
    names, whose = [], []
    error = _near[0][_remainder(a)]
    row, column = np.nonzero(error >= 0)
    anchor = a[row] ^ error[row, column]
    for x in (b >> 11, b & 0x7FF):
        names.append(anchor << 12 | x[row])
        whose.append(row)
    thirds = lambda x: (x >> 15, x >> 7 & 0xFF, x & 0x7F)
    exact = [x << 17 | y << 9 | z for x in thirds(a) for y in thirds(b) for z in (c >> 9, c & 0x1FF)]
    exact += [c << 12 | x for x in (a >> 11, a & 0x7FF, b >> 11, b & 0x7FF)]
    for x in (a, b, *exact):
        names.append(x)
        whose.append(every)
    return np.concatenate([x | kind << 40 for kind, x in enumerate(names)]), np.concatenate(whose)


_near: list[np.ndarray] = []


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, print), one for each anchor that a fingerprint goes to."""
    for batch in batches:
        prints = batch.column("print").to_numpy()
        keys, whose = anchors(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[whose])], ["key", "print"])


def _near_pairs(bits: np.ndarray, starts: np.ndarray, sizes: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of fingerprints of one block within the distance: small blocks side by side, large ones in squares."""
    last = np.repeat(starts + sizes, sizes)
    here = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    for k in range(1, SMALL):
        here = here[here + k < last[here]]
        near = here[np.bitwise_count(bits[here] ^ bits[here + k]) <= distance]
        yield near, near + k
    for b, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        block = bits[b : b + n]
        for at in range(0, n, 512):
            i, j = np.nonzero(np.bitwise_count(block[at : at + 512, None] ^ block[None, at:]) <= distance)
            later = i < j
            yield i[later] + at + b, j[later] + at + b


def _links(distance: int):
    """Links (a, b) from rows in the order of their blocks: each fingerprint to the first that it reaches in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "block", lambda t: t.num_rows, TOGETHER):
            block, bits = table.column("block").to_numpy(), table.column("print").to_numpy().view(np.uint64)
            starts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1])
            sizes = np.diff(starts, append=len(block))
            i, j = (np.concatenate(x) for x in zip(*_near_pairs(bits, starts, sizes, distance), strict=True))
            if len(i):
                root = local_roots(len(bits), i, j)
                linked = np.flatnonzero(root != np.arange(len(bits)))
                yield pa.RecordBatch.from_arrays([pa.array(bits[linked].view(np.int64)), pa.array(bits[root[linked]].view(np.int64))], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, fingerprint, component_id) for each row, and with carry also rest, a struct of the row's columns.

    Words are runs of bytes other than \\x20 and \\x09-\\x0D, with A-Z lower-cased; texts of fewer words than a shingle have
    one, of all their words; empty and null texts have the fingerprint 0, which links like any other. Rows
    link at `distance` (4 at most) or fewer differing bits; component_id is the least id that links reach, the
    row's own included. Null ids don't count as least; a component without any id has none. Repeated
    rows are rows of their own. Texts are taken whole, however long, a batch of about 8 MB or one longer text at a time. An empty table gives an empty result.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the anchors cover distances up to 4")
    small_batches(docs.sparkSession)
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *rest)
    schema = T.StructType([*(f for f in rows.schema if f.name != "text"), T.StructField("print", T.LongType())])
    prints = written(rows.mapInArrow(_fingerprints(shingle), schema))
    kinds = written(prints.groupBy("print").agg(F.min("id").alias("least")))
    anchored = kinds.select("print").mapInArrow(_anchored, "key long, print long")
    met = dealt(anchored, "print", BLOCK, alone=True).select("block", "print")
    links = met.repartition("block").sortWithinPartitions("block").mapInArrow(_links(distance), "a long, b long")
    roots = written(components(links))
    reached = kinds.join(roots, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    least = written(reached.groupBy("root").agg(F.min("least").alias("component_id")))
    named = written(written(reached).join(least, "root").select("print", "component_id"))
    found = prints.join(named, "print")
    return found.select("id", *["rest"] * carry, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")
