"""Sharding by Karmarkar-Karp differencing (operator 8).

Groups of rows with equal texts are indivisible and go to shards so that the
shards' bytes are nearly equal (law ``bytes``).

Differencing for ``k`` shards keeps *partial partitions*: ``k`` sums each.  A
single group starts as one sum and zeros.  The two partials of largest spread
(largest minus smallest sum) are combined, the largest sum of the one with the
smallest of the other, until one partial is left; its sums are the shards.

Distributed form: a task runs differencing over its own groups and returns one
partial partition (``k`` sums) besides each group's bin; the driver then
continues the same differencing over the tasks' partials, whose number is the
number of tasks, never of groups.  Because a partial keeps its spread, the
second level works as the first: oppositely ordered, largest spread first.

Slots: rows get gapless numbers within a shard by counts per (chunk, shard) and
prefix sums over chunks; a chunk is a hash of ``doc_id``, so a group that holds
a third of all rows is spread over all tasks for this.

Defined results: null text has no bytes (size 16, crc 0) and is one group,
apart from the empty text; repeated rows belong to their text's group and each
gets a slot; rows with null ``doc_id`` are rows like others; fewer groups than
shards leave shards empty; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, shards_for, to_batch

OVERHEAD = 16
GROUPS_PER_TASK = 200_000


class Partial:
    """A partial partition: sums in ascending order, and what lies in each bin."""

    __slots__ = ("sums", "bins")

    def __init__(self, sums: list[int], bins: list):
        self.sums, self.bins = sums, bins


def difference(items: list[Partial], k: int) -> Partial:
    """Karmarkar-Karp: combine the two partials of largest spread until one is left.

    ``bins`` are linked pairs, so that combining costs O(k), not the group size.
    """
    if not items:
        return Partial([0] * k, [None] * k)
    heap = [(p.sums[0] - p.sums[-1], i, p) for i, p in enumerate(items)]
    heapq.heapify(heap)
    n = len(items)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if a.sums[-2] == 0 and b.sums[-2] == 0 and k > 1:  # two single groups: no need to sort all bins
            joined = Partial([*a.sums[:-2], b.sums[-1], a.sums[-1]], [*a.bins[:-2], b.bins[-1], a.bins[-1]])
        else:
            sums = [x + y for x, y in zip(a.sums, reversed(b.sums))]
            bins = [x if y is None else y if x is None else (x, y) for x, y in zip(a.bins, reversed(b.bins))]
            order = sorted(range(k), key=sums.__getitem__)
            joined = Partial([sums[i] for i in order], [bins[i] for i in order])
        heapq.heappush(heap, (joined.sums[0] - joined.sums[-1], n, joined))
        n += 1
    return heap[0][2]


def members(tree) -> list:
    """Leaves of a bin's linked pairs."""
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if x.__class__ is tuple:
            stack += x
        elif x is not None:
            out.append(x)
    return out


def assign(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of every row; see the module text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.col(text_col)
    rows = scratch.save(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"none")).alias("grp"),
        ),
        "rows",
    )
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    total = rows.count()
    tasks = shards_for(spark, total, GROUPS_PER_TASK)
    schema = pa.schema([("part", pa.int32()), ("bin", pa.int32()), ("grp", pa.binary()), ("bytes", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part, keys, items = TaskContext.get().partitionId(), [], []
        for b in batches:
            for g, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                items.append(Partial([0] * (shards - 1) + [n], [None] * (shards - 1) + [len(keys)]))
                keys.append(g)
        if not keys:
            return
        items.sort(key=lambda p: (-p.sums[-1], keys[p.bins[-1]]))
        done = difference(items, shards)
        sizes = np.zeros(len(keys), np.int64)
        for p in items:
            sizes[p.bins[-1]] = p.sums[-1]
        for j, tree in enumerate(done.bins):
            got = members(tree)
            if got:
                yield to_batch(schema, part=[part] * len(got), bin=[j] * len(got), grp=[keys[i] for i in got], bytes=sizes[got].tolist())

    # hashed by hand, so that the task count holds and no shuffle is coalesced
    placed = scratch.save(groups.repartition(tasks, "grp").mapInArrow(run, "part int, bin int, grp binary, bytes long"), "placed")
    sums: dict[int, list[int]] = {}
    for r in placed.groupBy("part", "bin").agg(F.sum("bytes").alias("n")).collect():  # tasks x shards numbers
        sums.setdefault(r["part"], [0] * shards)[r["bin"]] = r["n"]
    tops = []
    for part in sorted(sums):
        order = sorted(range(shards), key=lambda j: (sums[part][j], j))
        tops.append(Partial([sums[part][j] for j in order], [(part, j) for j in order]))
    # leaves are (part, bin) pairs: kept in lists, as members() opens tuples
    for p in tops:
        p.bins = [[x] for x in p.bins]
    final = difference(tops, shards)
    to_shard = [(part, j, s) for s, tree in enumerate(final.bins) for leaf in members(tree) for part, j in leaf]
    lookup = spark.createDataFrame(to_shard, "part int, bin int, shard int")
    where = placed.join(F.broadcast(lookup), ["part", "bin"]).select("grp", "shard")  # tasks x shards rows at most
    found = rows.join(where, "grp")
    chunks = shards_for(spark, total, 1_000_000)
    found = scratch.save(found.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(chunks)).alias("chunk")), "found")
    counts = found.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32")) - 1
    return (
        found.withColumn("local", local)
        .join(counts, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("local")).cast("long").alias("slot"))
    )
