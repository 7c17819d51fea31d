"""MinHash near-duplicates by a multi-index Hamming join (operator 7).

1. *Sets.*  Lower-case A-Z, words are runs of other than ASCII white space, a
   document's set holds the hashes of its ``words``-word shingles; a document
   with fewer words has its whole word sequence as one element.
2. *Classes.*  Documents of equal sets form one class; all later work is on
   classes, so a group of exact copies of any size costs one row.
3. *Signatures.*  ``COMPONENTS`` minima of ``b = 16`` bits each.
4. *Multi-index join.*  Two signatures that differ in at most ``RADIUS``
   components must, by the pigeonhole principle, differ in at most
   ``RADIUS // chunks`` components of some chunk.  Each class therefore emits,
   for each chunk, one key for every way to leave out that many components:
   pairs within the radius share a key, without exception.
5. *Links.*  Candidates pass the Hamming test on whole signatures, then the
   exact test ``100 * |A & B| >= percent * |A | B|`` on whole sets.
6. *No pairs within groups.*  Only connectivity is asked for, so a key's
   classes are first compared with one centre (the class that has most company
   in its keys, as the least changed copy of a group has), found links are
   contracted to components, and this is repeated with other centres for the
   keys that still hold several components.  What then remains is compared
   completely, each pair of classes of different components once, in the first
   key it shares: a key's classes are dealt into blocks of bounded rows and
   elements, and a task holds two blocks at a time.  A first pass over
   signatures keeps the classes that have a partner within the radius; a second
   gets the whole sets of these, tests the pairs exactly and returns a spanning
   forest of the links.  No pass returns more rows than it read; nothing is capped.

At similarity s a component differs with probability 1 - s; with 64 components
and radius 25 a pair at exactly 0.8 is within the radius with probability
0.9998, and farther pairs cannot be linked wrongly because of step 5.

Defined results: null or blank text has an empty set, links with nothing and
is its own component; null ``doc_id`` rows are kept with a null component and
``kept`` true; rows that share a ``doc_id`` are one node; an empty table gives
an empty table; other columns are ignored.  Equal 64-bit set hashes are taken
as equal sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, slices, spread, to_batch
from quillstone.llm.components import components
from quillstone.llm.components import labels as connected

COMPONENTS = 64
CHUNKS = 13
RADIUS = 25
STAR_ROUNDS = 2
BLOCK = 1_024
BLOCK_ELEMENTS = 1 << 21
WORD_CACHE = 100_000

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """Word -> 64-bit hash; holds at most WORD_CACHE words of at most 64 bytes (about 15 MB)."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= WORD_CACHE:
                self.clear()
            self[word] = h
        return h


def word_hashes(text: str | None, cache: WordHashes) -> np.ndarray:
    """64-bit hashes of a text's words, in order."""
    if not text:
        return np.empty(0, _U)
    words = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z fold, only ASCII white space splits
    return np.fromiter(map(cache.__getitem__, words), _U, len(words))


def shingle_set(text: str | None, words: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    with np.errstate(over="ignore"):
        h = word_hashes(text, cache)
        if not len(h):
            return h
        width = min(words, len(h))
        acc = np.full(len(h) - width + 1, width, _U)
        for j in range(width):
            acc = mix64(acc * _U(0x9E3779B97F4A7C15) + h[j : j + len(acc)])
        return np.unique(acc)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_011)
    a = rng.integers(1, 1 << 63, COMPONENTS, dtype=np.uint64) | _U(1)
    return a, rng.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64)


_A, _B = _permutations()


def signature(elements: np.ndarray) -> np.ndarray:
    """``COMPONENTS`` minima, 16 bits each, of a non-empty set."""
    low = np.full(COMPONENTS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(elements), 1024):
            part = ((elements[i : i + 1024, None] * _A + _B) >> _U(32)).astype(np.uint32)
            np.minimum(low, part.min(axis=0), out=low)
        return (mix64(low.astype(_U)) & _U(0xFFFF)).astype("<u2")


def chunk_keys(components_: int = COMPONENTS, chunks: int = CHUNKS, radius: int = RADIUS) -> list[tuple[int, ...]]:
    """Component sets whose values make the keys: each chunk less every choice of errors."""
    errors = radius // chunks
    out = []
    for part in np.array_split(np.arange(components_), chunks):
        for gone in combinations(range(len(part)), errors):
            out.append(tuple(int(c) for i, c in enumerate(part) if i not in gone))
    return out


_KEYS = chunk_keys()


def signature_keys(sigs: np.ndarray) -> np.ndarray:
    """All keys of each signature row, as int64."""
    s = sigs.astype(_U)
    out = np.empty((len(s), len(_KEYS)), _U)
    with np.errstate(over="ignore"):
        for k, cols in enumerate(_KEYS):
            acc = np.full(len(s), k + 1, _U)
            for c in cols:
                acc = mix64(acc * _U(0x9E3779B97F4A7C15) + s[:, c])
            out[:, k] = acc
    return out.view(np.int64)


def _prepare(docs: DataFrame, words: int) -> DataFrame:
    from xxhash import xxh3_64_intdigest

    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()), ("sig", pa.binary())])

    def run(batches):
        cache = WordHashes()  # freed with the task
        for s in slices(batches, ["doc_id", "text"]):
            n, cls, sig = [], [], []
            for t in s["text"]:
                e = shingle_set(t, words, cache)
                n.append(len(e))
                cls.append(int(np.uint64(xxh3_64_intdigest(e.tobytes())).astype(np.int64)) if len(e) else None)
                sig.append(signature(e).tobytes() if len(e) else None)
            yield to_batch(schema, doc_id=s["doc_id"], n_shingles=n, cls=cls, sig=sig)

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_shingles long, cls long, sig binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    from xxhash import xxh3_64_intdigest

    schema = pa.schema([("cls", pa.int64()), ("elements", pa.list_(pa.int64()))])

    def run(batches):
        cache = WordHashes()
        for s in slices(batches, ["text"]):
            sets = [e for e in (shingle_set(t, words, cache) for t in s["text"]) if len(e)]
            yield to_batch(schema, cls=[int(np.uint64(xxh3_64_intdigest(e.tobytes())).astype(np.int64)) for e in sets], elements=[e.view(np.int64) for e in sets])

    return docs.select("text").mapInArrow(run, "cls long, elements array<long>")


def _emit_keys(classes: DataFrame) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("slot", pa.int32()), ("cls", pa.int64())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                if part.num_rows:
                    cls = part.column(0).to_numpy(zero_copy_only=False)
                    sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(len(cls), -1)
                    keys = signature_keys(sigs)
                    yield to_batch(schema, key=keys.ravel(), slot=np.tile(np.arange(keys.shape[1], dtype=np.int32), len(cls)), cls=np.repeat(cls, keys.shape[1]))

    return classes.select("cls", "sig").mapInArrow(run, "key long, slot int, cls long")


def _within_radius(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose whole signatures differ in at most RADIUS components."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u2").reshape(b.num_rows, -1)
                y = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u2").reshape(b.num_rows, -1)
                keep = (x != y).sum(axis=1) <= RADIUS
                yield to_batch(schema, a=b.column(0).to_numpy(zero_copy_only=False)[keep], b=b.column(1).to_numpy(zero_copy_only=False)[keep])

    left = classes.select(F.col("cls").alias("a"), F.col("sig").alias("x"))
    right = classes.select(F.col("cls").alias("b"), F.col("sig").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def first_keys(same: np.ndarray) -> np.ndarray:
    """Index of the first key that each pair shares, from its equal components; -1: none."""
    first = np.full(len(same), -1, np.int64)
    for k in range(len(_KEYS) - 1, -1, -1):
        first[same[:, _KEYS[k]].all(axis=1)] = k
    return first


def cell_pairs(cell: np.ndarray, slot: np.ndarray, split: np.ndarray, side: np.ndarray, comp: np.ndarray, size: np.ndarray, sigs: np.ndarray, percent: int):
    """Pairs of rows of one cell within the radius that meet first in its key; yields ``(i, j)`` row numbers.

    Rows of a cell are adjacent.  Rows of a ``split`` cell meet the other side only.
    Row i is taken with row i + d for all cells at once, for d = 1, 2, ... until cells end.
    """
    i, d = np.arange(len(cell)), 0
    while True:
        d += 1
        i = i[i + d < len(cell)]
        i = i[cell[i] == cell[i + d]]
        if not len(i):
            return
        j = i + d
        ok = (comp[i] != comp[j]) & (~split[i] | (side[i] != side[j])) & (np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * percent)
        x, y = i[ok], j[ok]
        near = (sigs[x] == sigs[y]).sum(axis=1) >= COMPONENTS - RADIUS
        x, y = x[near], y[near]
        first = first_keys(sigs[x] == sigs[y]) == slot[x]
        if first.any():
            yield x[first], y[first]


def exact_links(i: np.ndarray, j: np.ndarray, comp: np.ndarray, elements: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidate pairs, links that pass the exact test on whole sets, as a spanning forest.

    Pairs whose ends are joined by then, or were one component before, are not tested: they add nothing.
    """
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    used = np.unique(np.concatenate([i, j]))
    at = np.concatenate([[0], np.cumsum([len(elements[u]) for u in used.tolist()])])
    flat = np.concatenate([elements[u] for u in used.tolist()])
    names, ids = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(names), bool)
    where = np.zeros(int(used[-1]) + 1, np.int64)
    where[used] = np.arange(len(used))
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.get(k, k)) != k:
            root[k] = root.get(up, up)
            k = up
        return k

    a, b = [], []
    edge = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True])
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        u = int(i[lo])
        mine = ids[at[where[u]] : at[where[u] + 1]]
        mark[mine] = True
        for v in j[lo:hi].tolist():
            x, y = find(int(comp[u])), find(int(comp[v]))
            if x == y:
                continue
            other = ids[at[where[v]] : at[where[v] + 1]]
            both = int(np.count_nonzero(mark[other]))
            if 100 * both >= percent * (len(mine) + len(other) - both):
                root[max(x, y)] = min(x, y)
                a.append(u)
                b.append(v)
        mark[mine] = False
    return np.array(a, np.int64), np.array(b, np.int64)


_CELL = ("key", "slot", "lo", "hi", "side", "cls", "comp", "size", "sig")


def _by_cell(batches, handle):
    """Call ``handle(table)`` on tables of whole cells; rows come sorted by (key, slot, lo, hi)."""
    held: list[pa.RecordBatch] = []  # ends with the cell that the next batch may continue
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3)]
        if held:
            old, new = tuple(int(held[-1].column(i)[held[-1].num_rows - 1].as_py()) for i in (0, 2, 3)), tuple(int(c[0]) for c in cols)
            if old != new:
                yield from handle(pa.Table.from_batches(held))
                held = []
        last = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from handle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from handle(pa.Table.from_batches(held))


def _columns(t: pa.Table):
    key, slot, lo, hi, side, cls, comp, size = (t.column(i).to_numpy() for i in range(8))
    sigs = np.frombuffer(b"".join(t.column(8).to_pylist()), "<u2").reshape(t.num_rows, -1)
    cell = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    return cell, slot, lo != hi, side, cls, comp, size, sigs


def _candidates(rest: DataFrame, percent: int) -> DataFrame:
    """Rows of cells that have a partner within the radius; ``rest`` has key, slot, n, volume, cls, comp, size, sig.

    A key of ``n`` classes, together ``volume`` elements, is cut into blocks of bounded
    rows and elements; a class meets every block of its key, in cell (low block, high block).
    """
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("volume") / BLOCK_ELEMENTS)).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    cells = rest.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = cells.select("key", "slot", F.least("own", "o").alias("lo"), F.greatest("own", "o").alias("hi"), (F.col("own") > F.col("o")).cast("int").alias("side"), "cls", "comp", "size", "sig")

    def run(batches):
        def flag(t: pa.Table):
            cell, slot, split, side, _, comp, size, sigs = _columns(t)
            met = np.zeros(t.num_rows, bool)
            for x, y in cell_pairs(cell, slot, split, side, comp, size, sigs, percent):
                met[x] = met[y] = True
            if met.any():
                yield from t.filter(pa.array(met)).to_batches()

        yield from _by_cell(batches, flag)

    dealt = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "slot", "lo", "hi")
    return dealt.mapInArrow(run, dealt.schema)


def _compare_rest(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Spanning links among the classes of each key: candidates first, then whole sets of those alone.

    No pair leaves a task: the first pass returns rows that have a partner, at most its input,
    the second, which joins their sets, at most one link for each row.
    """
    cells = _candidates(rest, percent)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        def verify(t: pa.Table):
            cell, slot, split, side, cls, comp, size, sigs = _columns(t)
            found = list(cell_pairs(cell, slot, split, side, comp, size, sigs, percent))
            if found:
                column = t.column(9).combine_chunks()
                offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
                elements = [values[offsets[r] : offsets[r + 1]] for r in range(t.num_rows)]
                x, y = exact_links(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), comp, elements, percent)
                if len(x):
                    yield to_batch(schema, a=np.minimum(cls[x], cls[y]), b=np.maximum(cls[x], cls[y]))

        yield from _by_cell(batches, verify)

    whole = cells.join(sets, "cls").select(*_CELL, "elements")
    dealt = whole.repartition("key", "lo", "hi").sortWithinPartitions("key", "slot", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that pass the exact test on whole sets."""
    left = sets.select(F.col("cls").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("elements").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    joined = pairs.join(left, "a").join(right, "b").withColumn("n", both)
    return joined.where(F.lit(100) * F.col("n") >= F.lit(percent) * (F.size("x") + F.size("y") - F.col("n"))).select("a", "b")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row; see the module text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prepared = scratch.save(_prepare(docs, words), "prepared")
    full = prepared.where("cls is not null")
    classes = scratch.save(full.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig")), "classes")
    keys = scratch.save(_emit_keys(classes), "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    raw = scratch.save(keys.join(shared, "key"), "shared")
    scratch.drop(keys)
    # how much company a class has in all its keys: the least changed copy of a group has most
    weight = raw.groupBy("cls").agg(F.sum("n").alias("weight")).join(classes.select("cls", "size"), "cls")
    active = scratch.save(raw.join(weight, "cls").select("key", "slot", "cls", "size", "weight"), "active")
    scratch.drop(raw)
    wanted = classes.join(active.select("cls").distinct(), "cls", "left_semi").select(F.col("rep").alias("doc_id"))
    found = _sets(docs.join(wanted, "doc_id", "left_semi"), words)
    sets = scratch.save(found.groupBy("cls").agg(F.first("elements").alias("elements")), "sets")

    links = labels = None
    for turn in range(STAR_ROUNDS + 1):
        rows = active.withColumn("comp", F.col("cls"))
        if labels is not None:
            rows = active.join(labels, active.cls == labels.node, "left").select(*active.columns, F.coalesce("component", "cls").alias("comp"))
        # the centre: most company, a little shaken so that each round tries another one
        shake = F.col("weight") * (1 - F.pmod(F.xxhash64("cls", F.lit(turn)), F.lit(1000)) / 1000 * F.lit(0.1 * min(turn, 3)))
        state = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("volume"), F.max(F.struct(shake.alias("h"), "cls", "comp", "size")).alias("mid")).where("lo < hi")
        state = state.select("key", "n", "volume", F.col("mid.cls").alias("c"), F.col("mid.comp").alias("other"), F.col("mid.size").alias("csize"))
        if turn < STAR_ROUNDS:
            near = F.least(rows["size"], state["csize"]) * 100 >= F.greatest(rows["size"], state["csize"]) * percent
            pairs = rows.join(state, (rows["key"] == state["key"]) & (rows["comp"] != state["other"]) & near).select(F.least("cls", "c").alias("a"), F.greatest("cls", "c").alias("b"))
            pairs = scratch.save(_within_radius(pairs.distinct(), classes), "pairs")
            new = scratch.save(_linked(pairs, sets, percent), "links")
            scratch.drop(pairs)
        else:
            rest = rows.select("key", "slot", "cls", "comp", "size").join(state.select("key", "n", "volume"), "key").join(classes.select("cls", "sig"), "cls")
            new = scratch.save(_compare_rest(rest, sets, percent), "links")
        links = new if links is None else links.unionByName(new)
        if turn < STAR_ROUNDS:
            labels = connected(links, scratch)
    rep = classes.select(F.col("cls").alias("k"), "rep")
    between = links.join(rep.select(F.col("k").alias("a"), F.col("rep").alias("x")), "a").join(rep.select(F.col("k").alias("b"), F.col("rep").alias("y")), "b")
    members = full.join(rep.withColumnRenamed("k", "cls"), "cls").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    comp = components(between.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(members), scratch)
    scratch.release(prepared, comp)
    out = prepared.join(comp, prepared.doc_id == comp.node, "left")
    cid = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), F.coalesce(cid == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, with all their columns.

    Of rows that share the kept ``doc_id`` one stays (the smallest text).
    """
    marks = near_duplicates(docs, words=words, percent=percent)
    scratch = Scratch(docs.sparkSession, "minhash")
    marks = scratch.save(marks, "marks")
    once = marks.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("kept").cast("int")).alias("k"))
    gone = once.where("k = 0 and doc_id is not null").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti")
    again = scratch.save(once.where("n > 1 and doc_id is not null").select("doc_id"), "again")
    if again.isEmpty():
        return left
    twice = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("r"))
    return left.join(again, "doc_id", "left_anti").unionByName(twice.select("doc_id", "r.*").select(*docs.columns))
