"""Reshards documents by minimum-cost flow: shards of near equal bytes, moving the fewest.

Documents of an old shard fall into blocks by a hash of their id, checksum and size. The driver gets a row for each block, `old
shards x blocks` at most, whatever the corpus holds, solves the flow from old shards to new capacities, and fills the
flows with whole blocks. Documents then follow their block.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Blocks of an old shard at most.
BLOCKS = 2048
#: Bytes of a document besides its text.
HEADER = 16
#: Rows of a file that rewrite() makes, at most.
FILE_ROWS = 1 << 20


def min_cost_flow(supply: Sequence[int], demand: Sequence[int], cost: Sequence[Sequence[int]]) -> dict[tuple[int, int], int]:
    """Units sent from each source to each sink, all supply, at the least total cost; demand is an upper limit.

    Successive shortest paths with potentials. Costs are not negative; total demand is at least total supply.
    """
    n, m = len(supply), len(demand)
    left, room = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    height = [0] * (n + m)  # potentials: sources, then sinks
    while any(left):
        dist: list[float] = [0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        back: list[int] = [-1] * (n + m)
        queue = [(0, i) for i in range(n) if left[i]]
        done = [False] * (n + m)
        while queue:
            d, v = heapq.heappop(queue)
            if done[v]:
                continue
            done[v] = True
            if v < n:
                steps = [(n + j, cost[v][j]) for j in range(m)]
            else:
                steps = [(i, -cost[i][v - n]) for i in range(n) if flow.get((i, v - n))]
            for u, c in steps:
                e = d + c + height[v] - height[u]
                if e < dist[u]:
                    dist[u], back[u] = e, v
                    heapq.heappush(queue, (e, u))
        end = min((n + j for j in range(m) if room[j]), key=lambda v: dist[v] + height[v])
        if dist[end] == float("inf"):
            raise ValueError("demand is less than supply")
        path, v = [], end
        while back[v] >= 0:
            path.append((back[v], v))
            v = back[v]
        amount = min(left[v], room[end - n], *(flow[(u, a - n)] for a, u in path if a >= n))
        for a, u in path:
            if a < n:
                flow[(a, u - n)] += amount
            else:
                flow[(u, a - n)] -= amount
        left[v] -= amount
        room[end - n] -= amount
        height = [h + (d if d < float("inf") else 0) for h, d in zip(height, dist, strict=True)]
    return {k: x for k, x in flow.items() if x}


def fill(blocks: Sequence[tuple[int, int, int]], flow: dict[tuple[int, int], int], capacity: Sequence[int]) -> dict[tuple[int, int], int]:
    """New shard of each block (old shard, block, bytes): flows filled by the largest blocks first, then evened out by moves
    of blocks that shrink the greatest surplus."""
    want: dict[int, dict[int, int]] = defaultdict(dict)
    for (i, j), x in flow.items():
        want[i][j] = x
    room, place = list(capacity), {}
    held: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    by_old: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for block in blocks:
        by_old[block[0]].append(block)
    for i, mine in sorted(by_old.items()):
        # a block that stays counts first: it costs nothing to move
        open_ = [(-x, j != i, j) for j, x in sorted(want[i].items())] or [(0, True, j) for j in range(len(capacity))]
        heapq.heapify(open_)
        for block in sorted(mine, key=lambda b: (-b[2], b[1])):
            need, other, j = heapq.heappop(open_)
            heapq.heappush(open_, (need + block[2], other, j))
            place[block[:2]] = j
            room[j] -= block[2]
            held[j].append((block[2], *block[:2]))
    for x in held.values():
        x.sort()
    for _ in range(4 * len(blocks)):
        full, free = min(range(len(room)), key=lambda j: (room[j], j)), max(range(len(room)), key=lambda j: (room[j], -j))
        gap = room[free] - room[full]
        # the largest block that leaves the pair more even than it was
        k = next((k for k in range(len(held[full]) - 1, -1, -1) if 0 < held[full][k][0] < gap and 2 * held[full][k][0] <= gap + held[full][0][0]), None)
        if k is None:
            break
        block = held[full].pop(k)
        place[block[1:]] = free
        room[full] += block[0]
        room[free] -= block[0]
        held[free].append(block)
        held[free].sort()
    return place


def resharded(docs: DataFrame, old: Column, n_old: int, n_new: int, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS, carry: bool = False) -> DataFrame:
    """(id, size, text_crc32, old, shard, slot), and with carry also row, a struct of the columns.

    old: the shard that a row lies in, from 0 to n_old - 1. New capacities are equal, so shards have near equal
    bytes: within a block or so of each other, where no document is larger than a shard. A byte that stays in the shard of
    its old number costs nothing, any other costs one. size: UTF-8 bytes of the text plus 16; null texts have
    none, as empty ones. slot: the row's place in its shard, without gaps from 0, in the order of blocks, ids
    (null first) and checksums. Rows of equal id and different texts lie in blocks of their own; rows without an id are also dealt
    out by their place in the input, so that any number of equal ones stays even. Equal rows may trade slots. An empty table
    gives an empty result. Other columns, whatever their names, matter only as part of row.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    key = F.col(id_col).cast("long")
    size, checksum = (F.octet_length(text) + HEADER).cast("long"), F.crc32(text)
    salt = F.when(key.isNull(), F.monotonically_increasing_id())
    block = F.pmod(F.xxhash64(key, checksum, size, salt), F.lit(blocks)).cast("int")
    rows = written(docs.select(key.alias("id"), size.alias("size"), checksum.alias("text_crc32"), old.cast("int").alias("old"), block.alias("block"), *rest))
    sums = rows.groupBy("old", "block").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy("old", "block").collect()
    total = sum(r["bytes"] for r in sums)
    capacity = [total // n_new + (j < total % n_new) for j in range(n_new)]
    supply = [0] * n_old
    for r in sums:
        supply[r["old"]] += r["bytes"]
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(n_new)] for i in range(n_old)])
    place = fill([(r["old"], r["block"], r["bytes"]) for r in sums], flow, capacity)
    first, plan = [0] * n_new, []
    for r in sums:
        j = place[(r["old"], r["block"])]
        plan.append((r["old"], r["block"], j, first[j]))
        first[j] += r["n"]
    planned = spark.createDataFrame(plan, "old int, block int, shard int, first long")
    nth = F.row_number().over(W.partitionBy("old", "block").orderBy("id", "text_crc32", "size"))
    numbered = rows.withColumn("nth", nth).join(F.broadcast(planned), ["old", "block"])  # n_old * blocks rows at most
    return numbered.select("id", "size", "text_crc32", "old", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), *["row"] * carry)


def rewrite(plan: DataFrame, path: str, file_rows: int = FILE_ROWS) -> list[int]:
    """Replaces path/shard=N for each shard N that changes, and gives their numbers. plan: resharded(..., carry=True).

    A shard whose rows neither come nor go keeps its files, and one that loses all its rows goes. New files are written beside
    the shards first, under a name that readers skip; then each old folder is moved aside and the new one takes its place, so that
    at no time the only copy of a row is gone. Old folders are deleted at the end. A file holds `file_rows` rows at most, in the order of slots.
    Columns of the rows named shard or slot give way. An empty plan changes nothing.
    """
    spark = plan.sparkSession
    moves = plan.groupBy("old", "shard").agg(F.count(F.lit(1)).alias("n")).collect()  # old shards x new ones at most
    changed = sorted({x for r in moves if r["old"] != r["shard"] for x in (r["old"], r["shard"])})
    if not changed:
        return []
    names = [f.name for f in plan.schema["row"].dataType if f.name not in ("shard", "slot")]
    rows = plan.filter(F.col("shard").isin(changed)).select("shard", "slot", *[F.col(f"row.`{c}`") for c in names])
    part = F.floor(F.col("slot") / file_rows)
    staged, aside = (f"{path.rstrip('/')}/_{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    rows.repartition("shard", part).sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(staged)
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(to(aside))
    filled = {r["shard"] for r in moves}
    for n in changed:
        here, name = to(f"{path.rstrip('/')}/shard={n}"), f"shard={n}"
        if files.exists(here) and not files.rename(here, to(f"{aside}/{name}")):
            raise OSError(f"can't move {name} aside; its new files are in {staged}")
        if n in filled and not files.rename(to(f"{staged}/{name}"), here):
            raise OSError(f"can't put {name} in place; its new files are in {staged}, its old ones in {aside}")
    for folder in (aside, staged):
        files.delete(to(folder), True)
    return changed


def digest(plan: DataFrame) -> DataFrame:
    return plan.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
