"""Near-duplicate vectors by lattice hashing.

A table projects unit vectors on 8 random orthogonal directions, scales, and decodes to the nearest point of the lattice E8.
A vector lies in the cell of its nearest point, its home, and also visits the cells of the next nearest
neighbours of that point. Pairs of a home and any member of its cell are verified by cosine, in blocks. A pair
is counted in the first table, and there in the lesser cell, where it meets, which both vectors' lists of cells tell.
Equal vectors fold into one before, named by 128 bits, with their number as weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH, small_batches, written
from .components import components, dealt, local_roots, per_block
from .segments import mix


@dataclass(frozen=True)
class Tables:
    """tables; neighbouring cells that a vector visits in each; what one lattice unit stands for, in root mean squares of a
    unit vector's projections, which are 1 / sqrt(dimension): so recall and selectivity are the same in any dimension."""

    tables: int = 4
    visits: int = 4
    cell: float = 1.28
    seed: int = 7


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        bits = np.array([signs >> k & 1 for k in range(8)])
        if bits.sum() % 2 == 0:
            out.append(0.5 - bits)
    return np.array(out)


ROOTS = _roots()


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and if the sum is odd, round the worst entry the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    off = x[odd] - r[odd]
    worst = np.abs(off).argmax(axis=1)
    r[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 = D8 and D8 + 1/2 to each row."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cells(unit: np.ndarray, label: np.ndarray, options: Tables) -> np.ndarray:
    """Names of the cells of each vector: (vectors, tables, 1 + visits), the home first."""
    rng = np.random.default_rng((options.seed, unit.shape[1]))
    name = rng.integers(1, 1 << 62, 10, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(unit), options.tables, 1 + options.visits), np.uint64)
    for t in range(options.tables):
        directions = np.linalg.qr(rng.standard_normal((max(unit.shape[1], 8), 8)))[0][: unit.shape[1]]
        x = unit @ directions * (math.sqrt(unit.shape[1]) / options.cell)
        home = decode_e8(x)
        # the neighbours nearest to x are those that lie most in the direction of x - home
        toward = (x - home) @ ROOTS.T
        next_ = np.argsort(-toward, axis=1, kind="stable")[:, : options.visits]
        points = np.concatenate([home[:, None], home[:, None] + ROOTS[next_]], axis=1)
        whole = (2 * points).astype(np.int64).view(np.uint64)
        h = (whole * name[:8]).sum(axis=2) + label.astype(np.int64).view(np.uint64)[:, None] * name[8] + np.uint64(t) * name[9] + np.uint64(unit.shape[1])
        out[:, t] = mix(h)
    return out


def _place(options: Tables, item: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                lists = batch.column("vector")
                length = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                begin = np.cumsum(length) - length
                for dim in np.unique(length):
                    rows = np.flatnonzero(length == dim)
                    v = flat[begin[rows, None] + np.arange(dim)]
                    named = cells(_unit(v), batch.column("label").to_numpy()[rows], options)
                    n, each = len(rows), options.tables * (1 + options.visits)
                    which = np.repeat(np.arange(n), each)
                    table = np.tile(np.repeat(np.arange(options.tables), 1 + options.visits), n)
                    home = np.tile(np.arange(1 + options.visits) == 0, n * options.tables)
                    lists_ = [x.tobytes() for x in named]
                    vectors = [x.tobytes() for x in v.astype(item)]
                    ids, weight = batch.column("cid").to_numpy()[rows], batch.column("weight").to_numpy()[rows]
                    step = max(1, BATCH // (8 * (each + int(dim))))
                    for a in range(0, n * each, step):
                        w = which[a : a + step]
                        columns = [named.reshape(-1)[a : a + step].view(np.int64), ids[w], weight[w], table[a : a + step], home[a : a + step]]
                        binary = [pa.array([x[i] for i in w], pa.binary()) for x in (lists_, vectors)]
                        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), *binary], ["key", "cid", "weight", "table", "home", "cells", "vector"])

    return run


PLACED = "key long, cid long, weight long, table long, home boolean, cells binary, vector binary"


def _compare(options: Tables, cosine: float, item: type):
    def compare(block: pa.Table) -> Iterator[pa.RecordBatch]:
        if not any(block.column("home").to_pylist()):
            return
        n, t = block.num_rows, int(block.column("table")[0].as_py())
        key = block.column("key").to_numpy().view(np.uint64)[0]
        cid, weight = block.column("cid").to_numpy(), block.column("weight").to_numpy()
        home, chunk = block.column("home").to_numpy(zero_copy_only=False), block.column("chunk").to_numpy()
        alone = bool(block.column("alone")[0].as_py())
        vector = _unit(np.frombuffer(b"".join(block.column("vector").to_pylist()), item).reshape(n, -1).astype(np.float64))
        named = np.frombuffer(b"".join(block.column("cells").to_pylist()), np.uint64).reshape(n, options.tables, 1 + options.visits)
        found = []
        for at in range(0, n, 512):
            near = vector[at : at + 512] @ vector.T >= cosine
            near &= home[at : at + 512, None] | home[None, :]
            i, j = np.nonzero(near)
            i += at
            later = (i < j) & (alone | (chunk[i] != chunk[j]))
            found.append((i[later], j[later]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(i):
            return
        root = local_roots(n, i, j)
        first = np.ones(len(i), bool)
        meets = lambda a, b, s: (named[a, s, :1] == named[b, s]).any(axis=1)  # noqa: E731  a's home is among b's cells
        for s in range(t):
            first &= ~(meets(i, j, s) | meets(j, i, s))
        # where each visits the other's home, two cells see the pair
        both = meets(i, j, t) & meets(j, i, t)
        first &= ~both | (np.minimum(named[i, t, 0], named[j, t, 0]) == key)
        links = np.bincount(i[first], weight[j[first]], n) + np.bincount(j[first], weight[i[first]], n)
        linked = np.unique(np.concatenate([i, j]))
        yield pa.RecordBatch.from_arrays([pa.array(cid[linked]), pa.array(links[linked].astype(np.int64)), pa.array(cid[root[linked]])], ["cid", "links", "root"])

    return compare


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, options: Tables | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is at least `cosine`.
    Vectors that are null, empty, zero, or hold a null or a component that isn't finite link with nothing. n_links: other rows linked
    directly. component_id: the least id that links reach, the row's own included; null ids don't count as least. kept:
    id = component_id. Equal rows are rows of their own and link with each other. Vectors of different
    lengths don't link. An empty table gives an empty result; other columns aren't read.

    Pairs near the threshold can be missed; with the default tables fewer than one in a thousand of those at 0.98
    is (measured in the tests), and none that is found lies below it.
    """
    options = options or Tables()
    v = F.col("vector")
    kind, item = ("double", np.float64) if dict(vectors.dtypes)[vector_col] == "array<double>" else ("float", np.float32)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"), F.col(label_col).cast("long").alias("label"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    sound = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    small_batches(vectors.sparkSession)
    plain = F.transform(v, lambda x: x + F.lit(0).cast(kind))
    rows = rows.withColumn("name", F.when(sound, F.struct(F.xxhash64("label", plain).alias("a"), F.xxhash64(F.lit(1), "label", plain).alias("b"))))
    folded = rows.filter("name is not null").groupBy("name").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
    classes = written(folded.withColumn("cid", F.monotonically_increasing_id()))
    placed = classes.select("cid", "label", "vector", "weight").mapInArrow(_place(options, item), PLACED)
    found = written(per_block(dealt(placed, "cid"), _compare(options, cosine, item), "cid long, links long, root long"))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    reached = classes.join(counts, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
    reached = written(reached.select("name", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")))
    least = written(reached.groupBy("root").agg(F.min("least").alias("component_id")))
    named = written(reached.join(least, "root").select("name", "n_links", "component_id"))
    out = rows.select("id", "name").join(named, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")
