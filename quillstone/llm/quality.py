"""Quality by ordinal cumulative-link regression on graded ratings (operator 2).

Grades come from the rating table: 0 for low quality, 1 for good text that is
toxic, 2 for good clean text.  The model is proportional odds,

    P(grade <= k) = sigmoid(threshold[k] - score),   score = weights . features,

with one weight vector shared by all grades and ordered thresholds.  Features
are hashed (2^24 buckets and 2^20 for shapes): each distinct word without end
punctuation, its first four and five characters, and the share of distinct
words of each whole-word character shape; besides, the share of words that
repeat the word before (shares count in full from 1/8).

Weights are the maximum of the cumulative-link likelihood under an L1 penalty
(``PENALTY``), which chooses the features, and are then fitted again on these
with a tenth of it, which takes off most of the shrinking.  Features of fewer
than ``MIN_DOCUMENTS`` texts are left out; signs are free.

The expected grade and the tail probability P(grade >= ``top``) are returned; a
document is kept if the tail probability is at least ``KEEP_AT``.

Fitting uses at most ``SAMPLE`` rated documents of together at most
``SAMPLE_BYTES`` bytes, those with the smallest hash of their id (the documented
bound); their features come to the driver, everything else reads all rows.
Scoring is one narrow pass with the sparse weights in the closure and a word
cache of bounded size that ends with its task.

Defined results: null or blank text holds nothing to keep: expected grade and
tail probability 0, not kept; repeated ratings of a document take the lowest
quality and the highest toxicity; of repeated ``doc_id`` the smallest text is
fitted on; null ratings are ignored; with fewer than two grades rated there is
nothing to tell apart and every document gets the top grade and is kept; null
``doc_id`` is passed through; repeated rows are scored each; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import slices, spread, to_batch, trim

BUCKETS = 1 << 24
SAMPLE = 4_000
SAMPLE_BYTES = 32 << 20
MIN_DOCUMENTS = 4
PENALTY = 3e-3
REFIT = 0.1
KEEP_AT = 0.7
TOP = 2
CACHE_WORDS, SCORED_WORDS, CACHED_LENGTH = 60_000, 200_000, 40
SHAPES = 1 << 20
REPEATS = BUCKETS  # bucket of the share of words that repeat their predecessor
#: A shape that makes up this inverse share of a text's words counts in full.
SATURATE = 8.0

_SHAPE = [(re.compile(p), r) for p, r in ((r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a"), (r"\d+", lambda m: "0"), (r"([^\w])\1+", lambda m: m[1] * 2))]


def _bucket(kind: str, value: str) -> int:
    from xxhash import xxh32_intdigest

    return xxh32_intdigest(f"{kind}\0{value}".encode("utf-8", "replace")) % BUCKETS


def word_buckets(word: str) -> tuple[tuple[int, ...], int]:
    """Buckets of a word's presence features, and of its shape."""
    core = word.lower().strip(".,;:!?")
    shape = word
    for pattern, repl in _SHAPE:
        shape = pattern.sub(repl, shape)
    return (_bucket("w", core), _bucket("4", core[:4]), _bucket("5", core[:5])), BUCKETS + 1 + _bucket("s", shape) % SHAPES


class Buckets(dict):
    """Word -> buckets; at most CACHE_WORDS words of at most CACHED_LENGTH characters (about 25 MB)."""

    def __missing__(self, word: str):
        found = word_buckets(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


def repeats(words: list[str]) -> float:
    return sum(map(eq, words, islice(words, 1, None))) / len(words)


def features(text: str | None, buckets: Buckets) -> dict[int, float]:
    words = (text or "").split()
    distinct = set(words)
    out: dict[int, float] = {}
    shapes: dict[int, int] = {}
    for w in distinct:
        present, shape = buckets[w]
        for b in present:
            out[b] = 1.0
        shapes[shape] = shapes.get(shape, 0) + 1
    for b, n in shapes.items():
        out[b] = min(1.0, SATURATE * n / len(distinct))
    if words:
        out[REPEATS] = min(1.0, SATURATE * repeats(words))
    return out


@dataclass
class OrdinalModel:
    """Sparse weights and ordered thresholds."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def tails(self, score: float) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..."""
        return [1.0 / (1.0 + np.exp(np.clip(t - score, -500, 500))) for t in self.thresholds]


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


class Likelihood:
    """Mean negative log-likelihood of sparse rows; ``raw`` holds the first threshold and log gaps."""

    def __init__(self, grades: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, size: int):
        self.grades, self.row, self.col, self.value, self.size, self.n = grades, row, col, value, size, len(grades)
        self.levels = int(grades.max())

    def thresholds(self, raw: np.ndarray) -> np.ndarray:
        return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])

    def start(self) -> np.ndarray:
        """Thresholds of the grades' shares, without features."""
        share = np.array([(self.grades <= k).mean() for k in range(self.levels)]).clip(0.001, 0.999)
        cut = np.log(share / (1 - share))
        return np.concatenate([[cut[0]], np.log(np.maximum(np.diff(cut), 0.01))])

    def __call__(self, w: np.ndarray, raw: np.ndarray):
        """``(loss, gradient by weights, gradient by raw)``."""
        g, n = self.grades, self.n
        s = np.bincount(self.row, self.value * w[self.col], n)
        z = np.concatenate([np.full((n, 1), -60.0), self.thresholds(raw)[None, :] - s[:, None], np.full((n, 1), 60.0)], axis=1)
        c = _sigmoid(z)
        hi, lo = c[np.arange(n), g + 1], c[np.arange(n), g]
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        by_w = np.bincount(self.col, self.value * ((dhi - dlo) / n)[self.row], self.size)
        by_cut = np.array([(dlo[g == k + 1].sum() - dhi[g == k].sum()) / n for k in range(self.levels)])
        tail = np.cumsum(by_cut[::-1])[::-1]
        return -np.log(p).mean(), by_w, np.concatenate([[tail[0]], tail[1:] * np.exp(raw[1:])])

    def curvature(self) -> float:
        """Upper bound of the second derivative along weights, by power iteration."""
        v, top = np.ones(self.size), 1.0
        for _ in range(15):
            u = np.bincount(self.row, self.value * v[self.col], self.n)
            v = np.bincount(self.col, self.value * u[self.row], self.size)
            top = float(np.linalg.norm(v)) or 1.0
            v = v / top
        return 0.25 * top / self.n * 1.1


def minimise(f: Likelihood, penalty: float, w: np.ndarray, raw: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proximal gradient with restarted momentum, deterministic."""
    rate = 1.0 / f.curvature()
    y, t = w.copy(), 1.0
    for _ in range(steps):
        _, by_w, by_raw = f(y, raw)
        new = y - rate * by_w
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        raw = raw - 0.5 * by_raw
        if ((y - new) * (new - w)).sum() > 0:
            t = 1.0
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = np.abs(new - w).max()
        y, w, t = new + (t - 1) / nxt * (new - w), new, nxt
        if moved < 2e-4 and np.abs(by_raw).max() < 1e-4:
            break
    return w, raw


def fit(grades: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], *, min_documents: int = MIN_DOCUMENTS, penalty: float = PENALTY, refit: float = REFIT, steps: int = 250) -> OrdinalModel:
    """Penalised maximum likelihood; equal rows count once, so copies are no evidence.

    Features whose gradient stays below the penalty have weight 0 at the
    optimum, so only the others are worked on, and taken in as they exceed it.
    """
    once: dict[tuple, int] = {}
    for i, (g, (a, b)) in enumerate(zip(grades.tolist(), rows)):
        order = np.argsort(a, kind="stable")
        once.setdefault((g, a[order].tobytes(), b[order].tobytes()), i)
    pick = sorted(once.values())
    grades, rows = grades[pick], [rows[i] for i in pick]
    if len(np.unique(grades)) < 2:
        return OrdinalModel()
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(i) for i, _ in rows])
    del rows
    names, seen = np.unique(index, return_counts=True)
    names = names[seen >= min_documents]
    if not len(names):
        return OrdinalModel()
    at = np.minimum(np.searchsorted(names, index), len(names) - 1).astype(np.int32)
    keep = names[at] == index
    col, row, value = at[keep], row[keep], value[keep]
    del index, at, keep

    def part(use: np.ndarray) -> Likelihood:
        keep = use[col]
        return Likelihood(grades, row[keep], (np.cumsum(use, dtype=np.int32) - 1)[col[keep]], value[keep], int(use.sum()))

    full = Likelihood(grades, row, col, value, len(names))
    w, raw, live = np.zeros(full.size), full.start(), np.zeros(full.size, bool)
    while True:  # ends: ``live`` only grows
        more = (np.abs(full(w, raw)[1]) > penalty) & ~live
        if not more.any():
            break
        live |= more
        w[live], raw = minimise(part(live), penalty, w[live], raw, steps)
    chosen = w != 0
    if chosen.any():
        w[chosen], raw = minimise(part(chosen), penalty * refit, w[chosen], raw, steps)
    at = np.flatnonzero(w)
    return OrdinalModel({int(names[i]): float(w[i]) for i in at}, tuple(map(float, full.thresholds(raw))))


def rated(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)`` of ``labels(doc_id, quality, toxic)``."""
    r = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return r.select("doc_id", F.when(F.col("q") < 1, 0).when(F.col("t") > 0, 1).otherwise(2).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> OrdinalModel:
    """Fit on at most ``sample`` rated documents of together at most ``sample_bytes`` bytes."""
    spark = docs.sparkSession
    order = F.xxhash64("doc_id")
    chosen = rated(labels).select("doc_id", "grade", order.alias("h")).orderBy("h", "doc_id").limit(sample)  # top-k, merged from tasks
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(chosen), "doc_id")
    held, ids = 0, []
    for r in sizes.groupBy("h", "doc_id", "grade").agg(F.min("size").alias("size")).orderBy("h", "doc_id").collect():  # at most ``sample`` rows
        held += r["size"]
        if held > sample_bytes:
            break
        ids.append((r["doc_id"], r["grade"]))
    if not ids:
        return OrdinalModel()
    schema = pa.schema([("grade", pa.int32()), ("index", pa.binary()), ("value", pa.binary())])

    def run(batches):
        buckets = Buckets()
        for s in slices(batches, ["grade", "text"]):
            found = [features(t, buckets) for t in s["text"]]
            yield to_batch(
                schema,
                grade=s["grade"],
                index=[np.fromiter(f.keys(), "<i4", len(f)).tobytes() for f in found],
                value=[np.fromiter(f.values(), "<f4", len(f)).tobytes() for f in found],
            )

    picked = F.broadcast(spark.createDataFrame(ids, "doc_id long, grade int"))  # at most ``sample`` rows of two numbers
    shortest = F.min(F.struct(F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), "text")).alias("least")
    once = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id").groupBy("doc_id", "grade").agg(shortest)
    got = once.select("grade", F.col("least.text").alias("text")).mapInArrow(run, "grade int, index binary, value binary").collect()
    got.sort(key=lambda r: (r["grade"], bytes(r["index"]), bytes(r["value"])))
    return fit(np.array([r["grade"] for r in got], int), [(np.frombuffer(r["index"], "<i4"), np.frombuffer(r["value"], "<f4")) for r in got])


class Codes(dict):
    """Word -> number of its (live presence features, live shape); few such pairs exist, many words share them.

    Holds at most SCORED_WORDS words of at most CACHED_LENGTH characters (about 40 MB).
    """

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights, self.kinds, self.number = weights, [], {}

    def __missing__(self, word: str) -> int:
        present, shape = word_buckets(word)
        kind = tuple(b for b in present if b in self.weights), shape if shape in self.weights else -1
        n = self.number.get(kind)
        if n is None:
            n = self.number[kind] = len(self.kinds)
            self.kinds.append(kind)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= SCORED_WORDS:
                self.clear()
            self[word] = n
        return n


class Scorer:
    """Scores of texts by the codes of their distinct words."""

    def __init__(self, model: OrdinalModel):
        self.model, self.codes = model, Codes(model.weights)

    def score(self, text: str) -> float:
        words = text.split()
        distinct = set(words)
        weights, kinds = self.model.weights, self.codes.kinds
        shapes: dict[int, int] = {}
        flags: set[int] = set()
        for code, n in Counter(map(self.codes.__getitem__, distinct)).items():
            present, shape = kinds[code]
            flags.update(present)
            if shape >= 0:
                shapes[shape] = shapes.get(shape, 0) + n
        score = sum(map(weights.__getitem__, sorted(flags)))
        if REPEATS in weights:
            score += weights[REPEATS] * min(1.0, SATURATE * repeats(words))
        for s in sorted(shapes):
            score += weights[s] * min(1.0, SATURATE * shapes[s] / len(distinct))
        return score

    def tails(self, text: str | None) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ...; see the defined results."""
        if not self.model.thresholds:
            return [1.0] * TOP
        if text is None or not text.strip():
            return [0.0] * len(self.model.thresholds)
        return self.model.tails(self.score(text))


def score_documents(docs: DataFrame, model: OrdinalModel, *, keep_at: float = KEEP_AT) -> DataFrame:
    """``(doc_id, expected_grade, tail_probability, kept)`` of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("kept", pa.bool_())])

    def run(batches):
        scorer = Scorer(model)
        for s in slices(batches, ["doc_id", "text"]):
            tails = list(map(scorer.tails, s["text"]))
            yield to_batch(schema, doc_id=s["doc_id"], expected_grade=[float(sum(t)) for t in tails], tail_probability=[float(t[-1]) for t in tails], kept=[bool(t[-1] >= keep_at) for t in tails])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


#: Whole rows that pass a worker at a time.
KEEP_ROWS = 1_024


def keep_documents(docs: DataFrame, model: OrdinalModel, *, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, unchanged, in one narrow pass."""
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(model)
        for whole in batches:
            for lo in range(0, whole.num_rows, KEEP_ROWS):
                b = whole.slice(lo, KEEP_ROWS)
                keep = [bool(scorer.tails(t.as_py())[-1] >= keep_at) for t in b.column(at)]
                yield b.filter(pa.array(keep, pa.bool_()))
        del scorer
        trim()  # idle workers stay beside the stages that follow

    return docs.mapInArrow(run, docs.schema)
