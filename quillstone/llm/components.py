"""Connected components by alternating large and small stars.

Edges are rewired towards smallest neighbours until every component is a star
around its smallest node.  Each round is two aggregations and joins whose rows
never exceed twice the edges; a node of very many edges is split by adaptive
skew joins, and minima are pre-aggregated before the shuffle.  Rounds are
written tables, so a lost executor repeats at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def labels(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` after one round of both stars.

    Nodes of equal labels are connected; connected nodes may still differ.
    Enough to skip needless comparisons, at a fraction of :func:`components`.
    """
    state = scratch.save(_small(_large(edges.select("a", "b").where("a <> b").distinct())).where("a <> b"), "stars")
    up = state.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    tops = state.select(F.col("b").alias("node")).distinct().join(up, "node", "left_anti").select("node", F.col("node").alias("component"))
    return scratch.save(up.unionByName(tops), "labels")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` of every node that has an edge ``(a, b)``; others are alone.

    Null ends and loops are ignored; repeated edges count once; no edges give
    an empty table.
    """
    state = scratch.save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = state.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
    while mark[0]:
        new = scratch.save(_small(_large(state)).where("a <> b").distinct(), "stars")
        now = new.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        scratch.drop(state)
        state, done = new, now == mark
        mark = now
        if done:
            break
    pairs = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = pairs.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out._scratch_path = state._scratch_path
    return out
