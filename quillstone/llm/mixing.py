"""Mixing sources to target weights by hierarchical budgets (operator 9).

Weights form a tree (domain, language, source).  A token budget flows from the
root: every node divides its budget among its children by weight; a child takes
no more than its capacity (tokens times ``max_epochs``), and what it cannot take
is divided among its siblings by weight, again and again.  Because a child's
capacity is that of its whole subtree, a shortage reaches an ancestor's other
children only if all siblings are full.

Each leaf then reads its documents in seeded epochs: epoch ``e`` orders them by
a hash of (seed, e, doc_id); whole epochs come first, then the prefix of the
next one that starts within the remaining tokens (the document that crosses the
budget is taken whole, so a leaf exceeds its budget by less than one document).

Scale: leaf totals are one aggregation; the tree (bounded, ``MAX_LEAVES``, an
error beyond) is solved on the driver with exact integers.  Prefixes need no
sort of a leaf: hash order is cut into ranges of about ``RANGE_DOCS``
documents, ranges are summed, and only the one range of a leaf where its budget
ends is ordered row by row.  A source with a third of all rows is therefore
spread like any other.

Defined results: tokens are words; null or blank text has none and is never
selected (it can fill no budget); null tree values form a leaf ``null``; null or
repeated ``doc_id`` are ordered by their texts, equal rows are separate and
interchangeable documents; absent weights are 1 for each child, weights of 0
close a branch; an empty table or budget selects nothing; further columns are
carried along, whatever their names, save that the added ones replace input
columns of the same name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch

MAX_LEAVES = 200_000
RANGE_DOCS = 256


def token_count(text: Column) -> Column:
    """Words of the text, the unit of budgets."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def divide(budget: int, weights: Sequence[float], capacity: Sequence[int]) -> list[int]:
    """Shares of ``budget`` by weight, each within its capacity; shortages go to the others.

    Exact: weights are taken as the fractions that they are, shares are whole
    numbers, and what rounding leaves goes to the largest remainders.
    """
    share = [0] * len(weights)
    part = [Fraction(w) for w in weights]
    open_ = [i for i, w in enumerate(part) if w > 0 and capacity[i] > 0]
    left = min(budget, sum(capacity[i] for i in open_))
    while open_ and left > 0:
        total = sum(part[i] for i in open_)
        full = [i for i in open_ if left * part[i] >= capacity[i] * total]
        if not full:
            exact = {i: left * part[i] / total for i in open_}
            for i in open_:
                share[i] = int(exact[i])
            rest = left - sum(share[i] for i in open_)
            for i in sorted(open_, key=lambda i: (share[i] - exact[i], i))[:rest]:
                share[i] += 1
            break
        for i in full:
            share[i] = capacity[i]
        left -= sum(capacity[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return share


def budgets(leaves: Mapping[tuple, int], weights: Mapping[tuple, float], budget: int, max_epochs: int) -> dict[tuple, int]:
    """Token budget of each leaf path; ``leaves`` has tokens, ``weights`` is by node path."""

    def solve(prefix: tuple, paths: list[tuple], amount: int, out: dict) -> None:
        depth = len(prefix)
        if len(paths) == 1 and len(paths[0]) == depth:
            out[paths[0]] = amount
            return
        kids: dict = {}
        for p in paths:
            kids.setdefault(p[depth], []).append(p)
        names = sorted(kids, key=lambda x: (x is None, str(x)))
        caps = [max_epochs * sum(leaves[p] for p in kids[n]) for n in names]
        for n, share in zip(names, divide(amount, [weights.get((*prefix, n), 1.0) for n in names], caps)):
            solve((*prefix, n), kids[n], share, out)

    out: dict[tuple, int] = {}
    if leaves:
        # branches closed by a weight of 0 have no capacity
        closed = {k for k, w in weights.items() if w <= 0}
        live = {p: (0 if any(p[: i + 1] in closed for i in range(len(p))) else n) for p, n in leaves.items()}
        leaves = live
        solve((), list(leaves), min(budget, max_epochs * sum(leaves.values())), out)
    return out


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[tuple, float],
    *,
    budget: int | None = None,
    fraction: float = 1.0,
    max_epochs: int = 4,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Selected rows of ``docs`` with ``mix_epoch``, ``mix_tokens`` and the tree's ``mix_<level>`` added.

    ``budget`` is in tokens (words); without it, ``fraction`` of all tokens.
    """
    spark = docs.sparkSession
    levels_out = [f"mix_{n}" for n in levels]
    added = {n.lower() for n in (*levels_out, "mix_tokens", "mix_epoch")}
    carried = [c for c in docs.columns if c.lower() not in added]
    # private names: the row in one struct, its tree path, its token count and a key that orders it
    path = [f"l{i}" for i in range(len(levels_out))]
    key = F.xxhash64(F.col(id_col).cast("string"), F.xxhash64(text_col))
    marked = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), *(e.cast("string").alias(n) for n, e in zip(path, levels.values())), token_count(F.col(text_col)).alias("tokens"), key.alias("key")
    ).where("tokens > 0")
    narrow = Scratch(spark, "mix").save(marked.drop("row"), "rows")
    stats = narrow.groupBy(*path).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(stats) > MAX_LEAVES:
        raise ValueError(f"the tree has more than {MAX_LEAVES} leaves")
    leaves = {tuple(r[n] for n in path): r["tokens"] for r in stats}
    count = {tuple(r[n] for n in path): r["n"] for r in stats}
    if budget is None:
        budget = int(sum(leaves.values()) * Fraction(fraction))
    share = budgets(leaves, weights, budget, max_epochs)
    plan = [(*p, share[p] // leaves[p], share[p] % leaves[p], -(-count[p] // RANGE_DOCS)) for p in leaves]
    ddl = ", ".join(f"{n} string" for n in path) + ", full int, rest long, ranges int"
    plan = F.broadcast(spark.createDataFrame(plan, ddl))  # one row a leaf, MAX_LEAVES at most

    order = F.xxhash64(F.lit(seed), F.col("full"), F.col("key"))
    # the upper 32 bits as an unsigned number, cut into equal ranges; keeps the order of the hash
    at = F.floor((F.shiftright(order, 32) + F.lit(1 << 31)) * F.col("ranges") / F.lit(1 << 32)).cast("int")
    leaf = lambda x, y: [F.col(f"{x}.{n}").eqNullSafe(F.col(f"{y}.{n}")) for n in path]

    def placed(df: DataFrame) -> DataFrame:
        return df.alias("a").join(plan.alias("b"), leaf("a", "b")).select("a.*", "full", "rest", at.alias("range"), order.alias("order"))

    sums = placed(narrow).where("rest > 0").groupBy(*path, "range").agg(F.sum("tokens").alias("s"), F.first("rest").alias("rest"))
    sums = sums.withColumn("to", F.sum("s").over(Window.partitionBy(*path).orderBy("range")))
    last = sums.where("to >= rest and to - s < rest").select(*path, F.col("range").alias("last"), (F.col("rest") - F.col("to") + F.col("s")).alias("room"))
    rows = placed(marked).alias("a").join(F.broadcast(last).alias("b"), leaf("a", "b"), "left").select("a.*", "last", "room")  # one row a leaf
    whole = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full")))).where("epoch < full or range < last")
    before = Window.partitionBy(*path).orderBy("order", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where("range = last").withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).where("before < room").withColumn("epoch", F.col("full"))
    result = [*(F.col("row").getField(c).alias(c) for c in carried), *(F.col(n).alias(m) for n, m in zip(path, levels_out)), F.col("tokens").alias("mix_tokens"), F.col("epoch").alias("mix_epoch")]
    return whole.select(*result).unionByName(edge.select(*result))
