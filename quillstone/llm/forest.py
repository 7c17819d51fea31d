"""Embedding near-duplicates by a random-projection forest with spill (operator 4).

*Trees.*  A tree splits recursively: a random direction, the median of the
projections as threshold, and a spill band around it, in which a vector goes to
both sides, however many lie in it.  Splitting stops at small nodes, and at
nodes that a split does not thin out (a dense group lies wholly in the band):
such a group stays together in one leaf, whatever its size, so its pairs are
never parted.  Trees are fitted on at most ``SAMPLE`` vectors (the documented
bound) and then place every vector.

*How many trees.*  Each sample vector gets a partner at exactly the cosine asked
for, in a random direction.  Trees are added until every such pair has met in a
leaf, and then as many again, which squares the chance of a miss.  Several trees
with a narrow band write far fewer places than few trees with a wide one, since
each level multiplies the places; if the narrow band needs too many trees, the
next of ``SPILLS`` is taken.

*Leaves.*  All pairs of a leaf are compared, by matrix products in single
precision; what these leave open is decided in double precision.  A leaf twice
as large as others ought to be is cut into blocks and every pair of blocks is a
task of its own, so a group with a third of all rows is spread over the cluster.
Pairs are never written: a task returns, per vector, how many links it found,
and one edge towards the root of its locally joined group.

*Disk.*  Places go through the shuffle in turns: some trees, or a part of one
tree's blocks, of together ``PLACES`` places a vector; a turn's shuffle files go
when its result is written.  Vectors travel in single precision where that loses
nothing.  So disk stays at a fixed multiple of the table, whatever the depth of
the trees and the size of dense groups.

*Counting once.*  A link is counted only in the first leaf that its two vectors
share.  A task places those of its vectors that have a link in the earlier trees
again; placing is exact in whole numbers, so it gives the same leaves anywhere.

*Verify and union.*  Cosines are taken in double precision on the original
vectors; the roots' edges are joined to components.

Defined results: vectors that are null, zero, or with null or non-finite
components link with nothing and are their own component; only vectors of equal
length have a cosine, so each length has a forest of its own; components are
scaled by the largest before squaring, so none overflows or vanishes; equal vectors form a class of one representative, and
each of its rows counts the others; rows that share a ``vec_id`` are separate
rows of one node; null ``vec_id`` takes no part and is kept; an empty table
gives an empty table; other columns are ignored.  Equal 64-bit hashes of vectors
are taken as equal vectors.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, may_be_least, to_batch
from quillstone.llm.components import components

SAMPLE = 20_000
LEAF = 3_072
LEAST_SAMPLE = 24
SPILL = 0.05
SPILLS = (0.01, 0.02, SPILL)
#: Trees until all partners have met; as many again follow.
MOST_TREES = 24
THINNING = 0.85
BLOCK = 4_096
#: Places a vector that a turn shuffles, or bytes of places if that is more; bytes of a block in double precision.
PLACES = 2
TURN_BYTES = 64 << 20
BLOCK_BYTES = 128 << 20
#: Unit vectors and directions are rounded to this many steps: products of two sum up below 2**24, so without rounding in single precision.
STEPS = 1 << 11
SEED = 4_711


class Tree:
    """Split nodes in arrays; children below zero are leaves ``-1 - child``."""

    def __init__(self, points: np.ndarray, leaf_size: float, seed: int, spill: float = SPILL):
        rng = np.random.default_rng(seed)
        self.spill, self.leaves = spill, 0
        self.direction: list[np.ndarray] = []
        self.threshold: list[float] = []
        self.children: list[list[int]] = []
        self.root = self._grow(points, np.arange(len(points)), leaf_size, rng, 0)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, points, rows, leaf_size, rng, depth) -> int:
        if len(rows) <= leaf_size or depth >= 24:
            return self._leaf()
        direction = rng.standard_normal(points.shape[1]).astype(np.float32)
        direction /= np.linalg.norm(direction)
        p = points[rows] @ direction
        t = float(np.median(p))
        left, right = rows[p <= t + self.spill], rows[p >= t - self.spill]
        if max(len(left), len(right)) > THINNING * len(rows):
            return self._leaf()
        me = len(self.children)
        self.direction.append(direction)
        self.threshold.append(t)
        self.children.append([0, 0])
        self.children[me][0] = self._grow(points, left, leaf_size, rng, depth + 1)
        self.children[me][1] = self._grow(points, right, leaf_size, rng, depth + 1)
        return me

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, leaf)`` of every place of every point."""
        rows_out, leaf_out, stack = [], [], [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                rows_out.append(rows)
                leaf_out.append(np.full(len(rows), -1 - node, np.int64))
                continue
            p = points[rows] @ self.direction[node]
            t = self.threshold[node]
            stack.append((self.children[node][0], rows[p <= t + self.spill]))
            stack.append((self.children[node][1], rows[p >= t - self.spill]))
        if not rows_out:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(rows_out), np.concatenate(leaf_out)


class Forest:
    """Fitted trees that place rounded unit vectors (:func:`rounded`) level by level, with the same result in any batch.

    Nodes and leaves are numbered over all trees; tree ``t`` has the leaves ``base[t]`` to ``base[t + 1]``.
    """

    def __init__(self, trees: list[Tree], dim: int):
        self.dim, self.base = dim, np.cumsum([0, *(t.leaves for t in trees)])
        first = np.cumsum([0, *(len(t.children) for t in trees)])
        number = lambda node, t: np.where(node < 0, node - self.base[t], node + first[t])
        self.roots = np.array([number(t.root, k) for k, t in enumerate(trees)], np.int64)
        self.children = np.concatenate([np.empty((0, 2), np.int64), *(number(np.array(t.children, np.int64).reshape(-1, 2), k) for k, t in enumerate(trees))])
        self.direction = np.concatenate([np.empty((0, dim), np.int16), *(rounded(np.array(t.direction, np.float32).reshape(-1, dim)).astype(np.int16) for t in trees)])
        middle = np.array([x for t in trees for x in t.threshold], np.float64)
        band = np.repeat([t.spill for t in trees], [len(t.threshold) for t in trees])
        self.low, self.high = (middle - band) * STEPS * STEPS, (middle + band) * STEPS * STEPS

    def __len__(self) -> int:
        return len(self.roots)

    def place(self, q: np.ndarray, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """``(row, leaf)`` of every place of every point in the trees from ``first`` to before ``end``, ascending."""
        rows_out, leaf_out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        step = max(1, (1 << 21) // (self.dim * max(end - first, 1)))
        for at in range(0, len(q), step):
            n = min(step, len(q) - at)
            row, node = np.repeat(np.arange(at, at + n), end - first), np.tile(self.roots[first:end], n)
            rows, leaves = [], []
            while len(row):
                done = node < 0
                rows.append(row[done])
                leaves.append(-1 - node[done])
                row, node = row[~done], node[~done]
                p = np.einsum("ij,ij->i", q[row], self.direction[node].astype(np.float32))
                left, right = p <= self.high[node], p >= self.low[node]
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([self.children[node[left], 0], self.children[node[right], 1]])
            row, leaf = np.concatenate(rows), np.concatenate(leaves)
            order = np.argsort((row - at) * (self.base[-1] + 1) + leaf)
            rows_out.append(row[order])
            leaf_out.append(leaf[order])
        return np.concatenate(rows_out), np.concatenate(leaf_out)

    def table(self, q: np.ndarray, first: int, end: int) -> np.ndarray:
        """The leaves of each point in a row, ascending, filled up with -1."""
        row, leaf = self.place(q, first, end)
        at = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row]
        out = np.full((len(q), int(at.max(initial=0)) + 1), -1, np.int32)
        out[row, at] = leaf
        return out


def rounded(x: np.ndarray) -> np.ndarray:
    return np.rint(x * STEPS).astype(np.float32)


def first_shared(leaves: np.ndarray, others: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest leaf that row ``p`` of ``leaves`` shares with row ``q`` of ``others``, -1: none."""
    out, todo = np.full(len(p), -1, np.int32), np.arange(len(p))
    for c in range(leaves.shape[1]):  # ascending, so the first match is the smallest
        v = leaves[p[todo], c]
        hit = (v >= 0) & (others[q[todo]] == v[:, None]).any(axis=1)
        out[todo[hit]] = v[hit]
        todo = todo[~hit]
        if not len(todo):
            break
    return out


def grow(points: np.ndarray, total: int, cosine: float, *, leaf: int = LEAF, spills: tuple = SPILLS, most: int = MOST_TREES, seed: int = SEED) -> Forest:
    """A forest for ``total`` vectors, fitted on the sample ``points`` (unit rows); see the module text."""
    n, dim = points.shape
    size = max(LEAST_SAMPLE, leaf * n / max(total, 1)) if total > n else leaf
    rng = np.random.default_rng(seed)
    x = np.tile(points, (-(-SAMPLE // n), 1))[: max(n, SAMPLE)] if n > leaf else points
    y = x
    if dim > 1:
        y = rng.standard_normal(x.shape, np.float32)
        y -= (y * x).sum(axis=1, keepdims=True) * x
        y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
        y = cosine * x + np.sqrt(1 - cosine * cosine) * y
    qx, qy = rounded(x), rounded(y)
    for spill in spills:
        trees, apart = [], np.arange(len(x))
        while len(apart) and len(trees) < most:
            trees.append(Tree(points, size, seed + len(trees), spill))
            if trees[-1].leaves == 1:
                return Forest(trees[-1:], dim)  # all pairs meet in it
            one, all_of = Forest(trees[-1:], dim), np.arange(len(apart))
            apart = apart[first_shared(one.table(qx[apart], 0, 1), one.table(qy[apart], 0, 1), all_of, all_of) < 0]
        if not len(apart):
            break
    return Forest(trees + [Tree(points, size, seed + len(trees) + t, spill) for t in range(len(trees))], dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def clean_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, vec)``: usable vectors as f8 bytes; others have null ``vec``."""
    schema = pa.schema([("vec_id", pa.int64()), ("vec", pa.binary())])

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(1):
                x = v.as_py()
                ok = bool(x) and all(c is not None for c in x)
                if ok:
                    a = np.array(x, "<f8")
                    ok = bool(np.isfinite(a).all() and a.any())
                out.append((a + 0.0).tobytes() if ok else None)
            yield to_batch(schema, vec_id=b.column(0).to_pylist(), vec=out)

    return table.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(run, "vec_id long, vec binary")


def by_length(vectors: DataFrame) -> list[tuple[int, DataFrame]]:
    """``(dimension, rows)`` for each length of usable vectors with an id."""
    good = vectors.where("vec is not null and vec_id is not null")
    found = good.select(F.length("vec").alias("w")).distinct().orderBy("w").collect()
    return [(r["w"] // 8, good.where(F.length("vec") == r["w"])) for r in found]


def matrix(column: pa.Array | list, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if hasattr(column, "to_pylist") else column), "<f8").reshape(-1, dim)


def _coded(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, dim, vec)``: usable vectors as f4 bytes and a mark where that loses nothing, else as f8 bytes; others have null ``dim``."""
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                n = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                wide = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # null: not a number
                with np.errstate(over="ignore", invalid="ignore"):
                    narrow = wide.astype("<f4")
                    odd = narrow != wide
                stop = np.cumsum(n)
                count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[np.concatenate([[0], stop])])  # noqa: B023, E731
                good = (n > 0) & (count(~np.isfinite(wide)) == 0) & (count(wide != 0) > 0)
                short = count(odd) == 0
                w, f = wide.tobytes(), narrow.tobytes()
                vec = [(f[4 * (z - k) : 4 * z] + b"\1" if s else w[8 * (z - k) : 8 * z]) if g else None for g, s, k, z in zip(good.tolist(), short.tolist(), n.tolist(), stop.tolist())]
                yield to_batch(schema, vec_id=b.column(0), dim=[k if g else None for k, g in zip(n.tolist(), good.tolist())], vec=vec)

    return table.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(run, "vec_id long, dim int, vec binary")


def _decoded(column, dim: int) -> np.ndarray:
    """The rows of :func:`_coded` as a matrix in double precision."""
    raw = column.to_pylist()
    short = np.fromiter((len(r) % 2 for r in raw), bool, len(raw))
    if not short.any():
        return np.frombuffer(b"".join(raw), "<f8").reshape(-1, dim)
    out = np.empty((len(raw), dim))
    out[short] = np.frombuffer(b"".join([r[:-1] for r in raw if len(r) % 2]), "<f4").reshape(-1, dim)
    if not short.all():
        out[~short] = np.frombuffer(b"".join([r for r in raw if len(r) % 2 == 0]), "<f8").reshape(-1, dim)
    return out


def near_duplicates(table: DataFrame, *, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row; see the module text."""
    spark = table.sparkSession
    scratch = Scratch(spark, "forest")
    coded = _coded(table, id_col, vec_col)
    rows = scratch.save(coded.select("vec_id", "dim", F.when(F.col("dim").isNotNull(), F.xxhash64("vec")).alias("cls")), "rows")
    good = "dim is not null and vec_id is not null"
    dims = [r["dim"] for r in rows.where(good).select("dim").distinct().orderBy("dim").collect()]
    parts = [_links(coded.where(good).where(F.col("dim") == dim), dim, cosine, scratch) for dim in dims]
    classes, found = spark.createDataFrame([], CLASSES), spark.createDataFrame([], FOUND)
    for c, f in parts:
        classes, found = classes.unionByName(c), found.unionByName(f)
    # a node is a vec_id: classes that share one are joined, whatever their vectors
    held = rows.where(good).select("vec_id", "cls").distinct()
    shared = held.groupBy("vec_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a <> z").select("vec_id", "a")
    shared = held.join(shared, "vec_id").where("cls <> a").select("a", F.col("cls").alias("b"))
    comp = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")).unionByName(shared), scratch)
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    per = classes.join(links, "cls", "left").join(comp, F.col("cls") == comp.node, "left")
    per = per.select("cls", "least", F.coalesce("component", "cls").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    per = scratch.save(per, "classes")
    named = per.join(per.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("cls", "n_links", "component_id")
    rows_named = rows.join(named, "cls", "left")
    # a usable vector without an id takes no part, though it may equal a usable one
    n = F.when(F.col("vec_id").isNotNull(), F.col("n_links"))
    cid = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    scratch.release(rows, per)
    return rows_named.select("vec_id", F.coalesce(n, F.lit(0)).alias("n_links"), cid.alias("component_id"), F.coalesce(cid == F.col("vec_id"), F.lit(True)).alias("kept"))


CLASSES = "cls long, least long, m long"
FOUND = "cls long, links long, root long"
PLACED = "leaf long, i int, j int, side int, cls long, m long, vec binary"


def turns_of(load: list[float], most: float) -> list[tuple[int, int, int, int]]:
    """``(first tree, end, part, parts)`` of each turn, so that a turn has about ``most`` of the trees' loads at the most."""
    out: list[tuple[int, int, int, int]] = []
    first, held = 0, 0.0
    for t, own in enumerate(load):
        if t > first and held + own > most:
            out.append((first, t, 0, 1))
            first, held = t, 0.0
        held += own
        if own > most:
            parts = int(-(-own // most))
            out += [(t, t + 1, k, parts) for k in range(parts)]
            first, held = t + 1, 0.0
    return out + [(first, len(load), 0, 1)] * (first < len(load))


def _links(good: DataFrame, dim: int, cosine: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Classes ``(cls, least, m)`` of equal vectors of one length, and what the leaves found between them."""
    spark = good.sparkSession
    classes = good.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("m")).select("vec", F.xxhash64("vec").alias("cls"), "least", "m")
    classes = scratch.save(classes, "classes", free=True)
    total = classes.count()
    picked = classes.where(may_be_least(F.col("cls"), total, SAMPLE)).orderBy("cls", "vec").limit(SAMPLE).select("vec").toArrow().column(0) if total else []
    forest = grow(unit(_decoded(picked, dim)).astype(np.float32), total, cosine) if total else Forest([], dim)
    del picked
    base = forest.base
    # a block takes any leaf that is not far above the usual size, as far as memory allows
    usual = max(LEAF, LEAST_SAMPLE * total // SAMPLE)
    block = max(256, min(max(BLOCK, 2 * usual), BLOCK_BYTES // (8 * dim)))
    step = max(64, (1 << 20) // dim)

    def leaf_sizes(batches):
        held = np.zeros(base[-1], np.int64)
        for b in batches:
            for at in range(0, b.num_rows, step):
                q = rounded(unit(_decoded(b.column(0).slice(at, step), dim)))
                held += np.bincount(forest.place(q, 0, len(forest))[1], minlength=len(held))
        at = np.flatnonzero(held)
        if len(at):
            yield to_batch(pa.schema([("leaf", pa.int64()), ("n", pa.int64())]), leaf=at, n=held[at])

    sizes = np.zeros(base[-1], np.int64)  # leaves are bounded by the sample
    for r in classes.select("vec").mapInArrow(leaf_sizes, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    blocks = np.maximum(1, -(-sizes // block))
    load = [float((sizes * blocks)[a:z].sum()) for a, z in zip(base, base[1:])]
    schema = pa.schema([("leaf", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("cls", pa.int64()), ("m", pa.int64()), ("vec", pa.binary())])

    def deal(batches, first, end, part, parts):
        for b in batches:
            for at in range(0, b.num_rows, step):
                some = b.slice(at, step)
                cls, m = some.column(1).to_numpy(), some.column(2).to_numpy()
                q = rounded(unit(_decoded(some.column(0), dim)))
                row, leaf = forest.place(q, first, end)
                nb = blocks[leaf]
                mine = np.repeat(cls[row] % nb, nb)
                other = np.arange(len(mine)) - np.repeat(np.cumsum(nb) - nb, nb)
                row, leaf, i, j = np.repeat(row, nb), np.repeat(leaf, nb), np.minimum(mine, other), np.maximum(mine, other)
                now = np.flatnonzero((leaf + 31 * i + 17 * j) % parts == part)
                for lo in range(0, len(now), step):
                    k = now[lo : lo + step]
                    r = row[k]
                    yield to_batch(schema, leaf=leaf[k], i=i[k], j=j[k], side=(mine != i)[k], cls=cls[r], m=m[r], vec=some.column(0).take(pa.array(r)))

    def compare(cell: pa.Table) -> pa.Table:
        leaf, same = cell.column("leaf")[0].as_py(), cell.column("i")[0].as_py() == cell.column("j")[0].as_py()
        tree = int(np.searchsorted(base, leaf, "right")) - 1
        x = unit(_decoded(cell.column("vec"), dim))
        cls, m, side = (cell.column(c).to_numpy() for c in ("cls", "m", "side"))
        left = np.arange(len(x)) if same else np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        a, b = x[left].astype(np.float32), x[right].astype(np.float32)
        slack = 1.2e-7 * (dim + 8)  # above the rounding of a product in single precision
        links, root = np.zeros(len(x), np.int64), np.arange(len(x))
        where, leaves = np.full(len(x), -1), np.empty((0, 1), np.int32)  # leaves of the rows that have a link

        def join(p, q):
            """Union of the pairs; roots stay fully compressed."""
            while len(p):
                u, v = root[p], root[q]
                lo, hi = np.minimum(u, v), np.maximum(u, v)
                apart = lo != hi
                if not apart.any():
                    return
                p, q = p[apart], q[apart]
                np.minimum.at(root, hi[apart], lo[apart])
                while (root[root] != root).any():
                    root[:] = root[root]

        def count(p, q):
            """Count the links that no earlier leaf holds."""
            nonlocal leaves
            seen = np.unique(np.concatenate([p, q]))
            new = seen[where[seen] < 0]
            if len(new):
                where[new] = np.arange(len(leaves), len(leaves) + len(new))
                got = forest.table(rounded(x[new]), 0, tree + 1)
                width = max(leaves.shape[1], got.shape[1])
                leaves = np.concatenate([np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=-1) for a in (leaves, got)])
            keep = first_shared(leaves, leaves, where[p], where[q]) == leaf
            p, q = p[keep], q[keep]
            links[:] += np.bincount(p, m[q], len(x)).astype(np.int64) + np.bincount(q, m[p], len(x)).astype(np.int64)
            join(p, q)

        held, n, rows = [], 0, max(64, (4 << 20) // max(len(right), 1))
        for at in range(0, len(left), rows):
            skip = at if same else 0
            g = a[at : at + rows] @ b[skip:].T
            p, q = np.nonzero(g >= cosine - slack)
            if same:
                p, q = p[q > p], q[q > p]
            for lo in range(0, len(p), 1 << 16):
                u, v = p[lo : lo + (1 << 16)], q[lo : lo + (1 << 16)]
                sure = g[u, v] > cosine + slack
                u, v = left[u + at], right[v + skip]
                near = np.flatnonzero(~sure)
                sure[near] = np.einsum("ij,ij->i", x[u[near]], x[v[near]]) >= cosine
                held.append((u[sure], v[sure]))
                n += len(held[-1][0])
                if n >= 1 << 16:
                    count(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if n:
            count(*map(np.concatenate, zip(*held)))
        seen = np.flatnonzero(links)
        return pa.table({"cls": cls[seen], "links": links[seen], "root": cls[root[seen]]})

    found = spark.createDataFrame([], FOUND)
    for first, end, part, parts in turns_of(load, max(PLACES * total, TURN_BYTES // (4 * dim + 64))):
        dealt = classes.select("vec", "cls", "m").mapInArrow(partial(deal, first=first, end=end, part=part, parts=parts), PLACED)
        found = found.unionByName(scratch.save(dealt.groupBy("leaf", "i", "j").applyInArrow(compare, FOUND), "found", free=True))
    return classes.select("cls", "least", "m"), found
