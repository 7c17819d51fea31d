"""Hidden Markov language model (operator 10).

Tokens are words (runs of other than ASCII white space, A-Z folded) and one end
token for each document.  Documents with ``crc32(doc_id) mod 5 = 1`` are held
out; all others train.

*Counts.*  Every word of the training text is counted over the whole corpus.
Texts are coded once, in chunks: a chunk's distinct words are shuffled, not its
tokens, and come back with their corpus counts.

*Events.*  As in the base score, a token is one of the V known words or the one
unknown word, so that both scores are probabilities over the same V + 1 events.

*Symbols.*  The ``LEXICON`` most frequent words have emissions of their own.
All other known words are tied: a class (count band, word ending) has an
emission for each state, and within its class a word has the share
``(c + 0.5) / sum of the class``.  Unknown words are one symbol, whose
probability is the share of words that occur once (Good-Turing).  Every word
keeps its exact count; tying only bounds the parameter table.

*Training.*  States start as clusters of documents (k-means of word-ending
profiles of at most ``SEED_DOCS`` documents), then Baum-Welch passes run over
all training tokens until the log10 probability per token gains less than
``GAIN``: scaled forward-backward in each task, expected counts summed per
symbol by Spark with map-side combining; the M-step sees (symbols x states)
numbers.  A document's messages run through it whole: it is cut into segments of
``SEGMENT`` tokens only to work on many at a time, each segment's transfer
matrix (the product of its steps) carries alpha forward and beta back across
the cuts, and transitions over a cut are counted.

*Scoring.*  The scaled forward recursion runs over each whole document; the sum
of the logs of its scale factors, plus the tied words' shares, is the exact
log10 probability of the text with its end token.  ``unigram_score`` is that of
the same symbols with one state: the difference is what the states add.

Defined results: null text is the empty text (one token, the end); null
``doc_id`` counts as not held out; repeated rows are counted and scored each;
without training text every word is unknown, and base and score are those of
one unknown symbol; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, slices, spread, to_batch

STATES = 8
LEXICON = 20_000
ENDINGS = 256
BANDS = (3, 31)  # upper counts of the first bands
CLASSES = (len(BANDS) + 1) * ENDINGS
UNKNOWN = LEXICON + CLASSES
SYMBOLS = UNKNOWN + 1
GAIN = 0.01
SEGMENT = 256
SEED_DOCS = 4_000
SMOOTH = 50.0
STAY = 0.9
WORD_CACHE = 100_000
CHUNK_BYTES = 16 << 20


class Words(dict):
    """Word bytes -> 64-bit hash whose low 8 bits are the word's ending; at most WORD_CACHE words of at most 64 bytes."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh32_intdigest, xxh64_intdigest

        h = xxh64_intdigest(word) & 0x7FFFFFFFFFFFFF00 | xxh32_intdigest(word.rstrip(b".,;:!?")[-3:]) & 0xFF
        if len(word) <= 64:
            if len(self) >= WORD_CACHE:
                self.clear()
            self[word] = h
        return h


END = Words()[b"\n"]  # no word holds a line feed


def token_hashes(text: str | None, cache: Words) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").lower().split()
    out = np.empty(len(words) + 1, np.int64)
    out[:-1] = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    out[-1] = END
    return out


def bands_of(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(BANDS), count, "left")


_CHUNK = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n", pa.list_(pa.int64())), ("toks", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])


def _chunks(docs: DataFrame) -> DataFrame:
    import zlib

    def run(batches):
        from pyspark import TaskContext

        cache = Words()  # ends with the task
        base, seq = TaskContext.get().partitionId() << 32, 0
        for s in slices(batches, ["doc_id", "text"], max_bytes=CHUNK_BYTES, max_rows=1 << 15):
            held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d in s["doc_id"]]
            toks = [token_hashes(t, cache) for t in s["text"]]
            n = [len(t) for t in toks]
            words, where = np.unique(np.concatenate(toks), return_inverse=True)
            counts = np.bincount(where[~np.repeat(held, n)], minlength=len(words))
            yield to_batch(_CHUNK, chunk=[base + seq], doc_id=[s["doc_id"]], held_out=[held], n=[n], toks=[where.astype("<u4").tobytes()], words=[words.astype("<i8").tobytes()], counts=[counts.astype("<i4").tobytes()])
            seq += 1

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "chunk long, doc_id array<long>, held_out array<boolean>, n array<long>, toks binary, words binary, counts binary")


def _occurrences(chunks: DataFrame) -> DataFrame:
    schema = pa.schema([("chunk", pa.int64()), ("pos", pa.int32()), ("w", pa.int64()), ("c", pa.int64())])

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                w = np.frombuffer(b.column(1)[r].as_py(), "<i8")
                c = np.frombuffer(b.column(2)[r].as_py(), "<i4")
                for at in range(0, len(w), 1 << 17):
                    part = slice(at, at + (1 << 17))
                    yield to_batch(schema, chunk=np.full(len(w[part]), b.column(0)[r].as_py()), pos=np.arange(at, at + len(w[part]), dtype=np.int32), w=w[part], c=c[part].astype(np.int64))

    return chunks.select("chunk", "words", "counts").mapInArrow(run, "chunk long, pos int, w long, c long")


_CODED = pa.schema([("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("tied", pa.list_(pa.float64())), ("syms", pa.binary())])


class Lexicon:
    """Corpus totals and the symbol of every word, given its corpus count."""

    def __init__(self, total: int, distinct: int, once: int, frequent: list[tuple[int, int]], class_mass: dict[int, float]):
        self.total, self.distinct, self.once = total, distinct, once
        pairs = sorted((w, i) for i, (w, _) in enumerate(frequent))
        self.words = np.array([w for w, _ in pairs], np.int64)
        self.ranks = np.array([i for _, i in pairs], np.int64)
        self.counts = np.array([c for _, c in frequent], np.float64)
        self.mass = np.zeros(CLASSES)
        for k, m in class_mass.items():
            self.mass[k] = m

    def code(self, words: np.ndarray, counts: np.ndarray):
        """``(symbol, log10 base, log10 tied share)`` of each word."""
        sym = np.where(counts > 0, LEXICON + bands_of(counts) * ENDINGS + (words & 0xFF), UNKNOWN)
        tied = np.zeros(len(words))
        inside = (counts > 0) & (self.mass[np.minimum(sym - LEXICON, CLASSES - 1)] > 0)
        tied[inside] = np.log10((counts[inside] + 0.5) / self.mass[sym[inside] - LEXICON])
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = (self.words[at] == words) & (counts > 0)
            sym[hit], tied[hit] = self.ranks[at[hit]], 0.0
        base = np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))
        return sym, base, tied

    def endings(self) -> np.ndarray:
        """The ending of every symbol (unknown: 0)."""
        out = np.zeros(SYMBOLS, np.int64)
        out[self.ranks] = self.words & 0xFF
        out[LEXICON:UNKNOWN] = np.arange(CLASSES) % ENDINGS
        return out

    def unigram(self) -> np.ndarray:
        """Smoothed probability of every symbol; sums to 1."""
        p = np.zeros(SYMBOLS)
        p[: len(self.counts)] = self.counts + 0.5
        p[LEXICON:UNKNOWN] = self.mass
        u = self.unknown_share()
        s = p.sum()
        p = p / s * (1 - u) if s else p
        p[UNKNOWN] = u
        return p

    def unknown_share(self) -> float:
        return 1.0 if not self.total else min(0.5, max(self.once, 0.5) / self.total)


def _coded(chunks: DataFrame, counts: DataFrame, lex: Lexicon) -> DataFrame:
    # a chunk is some tens of MB: two to a task, however many there are
    tasks = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chunks.count() // 2))
    schema = pa.schema([("chunk", pa.int64()), ("got", pa.binary())])

    def packed(chunk: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        c = np.concatenate(parts)
        return to_batch(schema, chunk=[chunk], got=[c.astype("<u4" if c.max() < 1 << 32 else "<i8").tobytes()])

    def pack(batches):
        """The counts of a chunk's words, in their order, as one string: as rows of a list they would be millions of objects of the JVM."""
        now, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            chunk, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for lo, hi in zip(edge, edge[1:]):
                if held and chunk[lo] != now:
                    yield packed(now, held)
                    held = []
                now = int(chunk[lo])
                held.append(c[lo:hi])
        if held:
            yield packed(now, held)

    # every word of a chunk has its total, so positions are without gaps
    per = counts.repartition(tasks, "chunk").sortWithinPartitions("chunk", "pos").select("chunk", "c").mapInArrow(pack, "chunk long, got binary")
    joined = chunks.select("chunk", "doc_id", "held_out", "n", "toks", "words").repartition(tasks, "chunk").join(per, "chunk")

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                words, raw = np.frombuffer(b.column(5)[r].as_py(), "<i8"), b.column(6)[r].as_py()
                c = np.frombuffer(raw, "<u4" if len(raw) == 4 * len(words) else "<i8").astype(np.int64)
                sym, base, tied = lex.code(words, c)
                toks = np.frombuffer(b.column(4)[r].as_py(), "<u4")
                n = b.column(3)[r].as_py()
                edge = np.concatenate([[0], np.cumsum(n)[:-1]])
                at = lambda x: np.add.reduceat(x[toks], edge)  # noqa: B023, E731
                yield to_batch(_CODED, doc_id=[b.column(1)[r].as_py()], held_out=[b.column(2)[r].as_py()], n=[n], known=[at((c > 0).astype(np.int64))], base=[at(base)], tied=[at(tied)], syms=[sym[toks].astype("<u2").tobytes()])

    return joined.mapInArrow(run, "doc_id array<long>, held_out array<boolean>, n array<long>, known array<long>, base array<double>, tied array<double>, syms binary")


class Model:
    """start (S), move (S, S), emit (symbols, S); columns of emit sum to 1."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Model:
        u = unigram[UNKNOWN]
        known = unigram.copy()
        known[UNKNOWN] = 0
        if known.sum():
            known /= known.sum()
        e = emit.copy()
        e[UNKNOWN] = 0
        e = e + SMOOTH * known[:, None]
        mass = e.sum(axis=0)
        e = e / np.where(mass > 0, mass, 1) * (1 - u)
        e[UNKNOWN] = u
        a = move + 1e-3 * (move.sum() / move.size + 1)
        s = start + 1e-3 * (start.sum() / start.size + 1)
        return cls(s / s.sum(), a / a.sum(axis=1, keepdims=True), e)


def _by_length(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of falling length, and how many sequences reach each step."""
    order = np.argsort(-n, kind="stable")
    reach = np.searchsorted(-n[order], -np.arange(int(n.max()) if len(n) else 0), "left")
    return order, reach


def log10_probability(model: Model, syms: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Scaled forward recursion over whole sequences (the tied shares not included)."""
    edge = np.concatenate([[0], np.cumsum(n)[:-1]])
    order, reach = _by_length(n)
    first, out = edge[order], np.zeros(len(n))
    a = None
    for t, k in enumerate(reach.tolist()):
        e = model.emit[syms[first[:k] + t]]
        a = model.start * e if t == 0 else (a[:k] @ model.move) * e
        c = a.sum(axis=1)
        a /= c[:, None]
        out[:k] += np.log10(c)
    back = np.empty(len(n))
    back[order] = out
    return back


def transfers(model: Model, syms: np.ndarray, n: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Scaled transfer matrix of each segment: the product of its steps, the first without a move where fresh."""
    S = len(model.start)
    move, emit = model.move.astype(np.float32), model.emit.astype(np.float32)
    edge = np.concatenate([[0], np.cumsum(n)[:-1]])
    out = np.empty((len(n), S, S), np.float32)
    order_all = np.argsort(-n, kind="stable")
    for lo in range(0, len(n), 512):
        some = order_all[lo : lo + 512]
        size, first = n[some], edge[some]
        reach = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        p = np.where(fresh[some, None, None], np.eye(S, dtype=np.float32), move) * emit[syms[first]][:, None, :]
        for t, k in enumerate(reach.tolist()):
            if t:
                live = (p[:k].reshape(-1, S) @ move).reshape(k, S, S) * emit[syms[first[:k] + t]][:, None, :]
                p[:k] = live
            if t % 4 == 3:
                p[:k] /= np.maximum(p[:k].sum(axis=(1, 2), keepdims=True), 1e-30)
        out[some] = p / np.maximum(p.sum(axis=(1, 2), keepdims=True), 1e-30)
    return out


def messages(model: Model, matrix: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the state distribution before it (``start`` where fresh) and the backward message after it.

    Segments of a document follow one another; all documents advance together, a segment at a time.
    """
    m, S = len(fresh), len(model.start)
    begin = np.flatnonzero(fresh)
    count = np.diff(np.append(begin, m))
    before, after = np.empty((m, S)), np.ones((m, S))
    before[begin] = model.start
    for j in range(1, int(count.max()) if len(count) else 0):
        at = begin[count > j] + j
        v = np.einsum("ks,kst->kt", before[at - 1], matrix[at - 1].astype(np.float64))
        before[at] = v / v.sum(axis=1, keepdims=True)
    for j in range(int(count.max()) - 2 if len(count) else -1, -1, -1):
        at = begin[count > j + 1] + j
        v = np.einsum("kst,kt->ks", matrix[at + 1].astype(np.float64), after[at + 1])
        after[at] = v / v.sum(axis=1, keepdims=True)
    return before, after


def expected_counts(model: Model, syms: np.ndarray, n: np.ndarray, fresh: np.ndarray):
    """Expected (start, move, emit) counts and the log10 probability of whole documents, given as segments."""
    S = len(model.start)
    start, move, emit, total = np.zeros(S), np.zeros((S, S)), np.zeros((S, SYMBOLS)), 0.0
    edge = np.concatenate([[0], np.cumsum(n)[:-1]])
    before, after = (x.astype(np.float32) for x in messages(model, transfers(model, syms, n, fresh), fresh))
    emission, transition = model.emit.astype(np.float32), model.move.astype(np.float32)
    order_all = np.argsort(-n, kind="stable")
    for lo in range(0, len(n), 1024):
        some = order_all[lo : lo + 1024]
        size, first = n[some], edge[some]
        reach = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        inner = ~fresh[some]
        entry = np.where(inner[:, None], before[some] @ transition, before[some])
        es, alphas, scales, symbols = [], [], [], []
        for t, k in enumerate(reach.tolist()):
            s = syms[first[:k] + t]
            e = emission[s]
            a = (entry[:k] if t == 0 else alphas[-1][:k] @ transition) * e
            c = np.maximum(a.sum(axis=1, keepdims=True), 1e-30)
            total += float(np.log10(c).sum(dtype=np.float64))
            alphas.append(a / c)
            es.append(e)
            scales.append(c)
            symbols.append(s)
        beta = np.empty((0, S), np.float32)
        gammas = [None] * len(es)
        for t in range(len(es) - 1, -1, -1):
            k = reach[t]
            if len(beta) < k:  # segments that end here: alpha and beta sum to 1 together
                ends = slice(len(beta), k)
                last = after[some][ends]
                beta = np.concatenate([beta, last / np.maximum((alphas[t][ends] * last).sum(axis=1, keepdims=True), 1e-30)])
            g = alphas[t] * beta
            gammas[t] = g / np.maximum(g.sum(axis=1, keepdims=True), 1e-30)
            x = es[t] * beta / scales[t]
            if t:
                move += (alphas[t - 1][:k].T @ x) * transition
                beta = x @ transition.T
            else:  # the move into a segment from the one before it
                move += (before[some][inner].T @ x[inner]) * transition
        start += gammas[0][fresh[some]].sum(axis=0)
        flat, g = np.concatenate(symbols), np.concatenate(gammas)
        for s in range(S):
            emit[s] += np.bincount(flat, g[:, s], SYMBOLS)
    return start, move, emit.T, total


def segments(syms: np.ndarray, n: np.ndarray, use: np.ndarray):
    """Training documents cut into segments: ``(symbols, lengths, begins a document)``."""
    keep = np.repeat(use, n)
    n = n[use]
    parts = -(-n // SEGMENT)
    size = np.full(int(parts.sum()), SEGMENT)
    last = np.cumsum(parts) - 1
    size[last] = n - (parts - 1) * SEGMENT
    fresh = np.zeros(len(size), bool)
    fresh[np.concatenate([[0], last[:-1] + 1])] = True
    return syms[keep], size, fresh


_COUNTS = "sym int, " + ", ".join(f"s{i} double" for i in range(STATES))


def _count_rows(start, move, emit, total: float = 0.0):
    """Rows of counts: symbols, then start at -1, moves from state i at -2 - i, and the log probability."""
    live = np.flatnonzero(emit.any(axis=1))
    sym = np.concatenate([live, [-1], -2 - np.arange(STATES + 1)]).astype(np.int32)
    val = np.concatenate([emit[live], start[None, :], move, np.full((1, STATES), total / STATES)])
    return pa.RecordBatch.from_arrays([pa.array(sym), *(pa.array(val[:, i]) for i in range(STATES))], names=["sym", *(f"s{i}" for i in range(STATES))])


def _arrays(b: pa.RecordBatch, r: int):
    n = b.column(0)[r].values.to_numpy()
    held = np.array(b.column(1)[r].as_py(), bool)
    return n, held, np.frombuffer(b.column(2)[r].as_py(), "<u2").astype(np.int64)


def _gather(coded: DataFrame, run) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Counts of all tasks, summed by Spark: at most (symbols + states) rows come back."""
    rows = coded.select("n", "held_out", "syms").mapInArrow(run, _COUNTS)
    got = rows.groupBy("sym").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(STATES))).toPandas()
    sym, val = got["sym"].to_numpy(), got.iloc[:, 1:].to_numpy(float)
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES))
    emit[sym[sym >= 0]] = val[sym >= 0]
    start += val[sym == -1].sum(axis=0)
    moves = (sym <= -2) & (sym > -2 - STATES)
    move[-2 - sym[moves]] = val[moves]
    return start, move, emit, float(val[sym == -2 - STATES].sum())


def _profile(endings: np.ndarray, syms: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Unit square-root histograms of word endings, a row a document."""
    doc = np.repeat(np.arange(len(n)), n)
    h = np.sqrt(np.bincount(doc * ENDINGS + endings[syms], minlength=len(n) * ENDINGS).reshape(len(n), ENDINGS))
    return h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-9)


def _seed_states(coded: DataFrame, endings: np.ndarray, docs: int) -> np.ndarray:
    """Cluster centres of at most SEED_DOCS training documents' profiles."""
    share = min(1.0, 1.5 * SEED_DOCS / max(docs, 1))
    schema = pa.schema([("h", pa.int64()), ("p", pa.binary())])

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            for r in range(b.num_rows):
                n, held, syms = _arrays(b, r)
                edge = np.concatenate([[0], np.cumsum(n)])
                pick = [(h, i) for i in np.flatnonzero(~held).tolist() if (h := xxh64_intdigest(syms[edge[i] : edge[i + 1]].tobytes()) >> 1) < share * 2**63]
                if pick:
                    prof = [_profile(endings, syms[edge[i] : edge[i + 1]], n[i : i + 1])[0].astype("<f4").tobytes() for _, i in pick]
                    yield to_batch(schema, h=[h for h, _ in pick], p=prof)

    got = coded.select("n", "held_out", "syms").mapInArrow(run, "h long, p binary").orderBy("h", "p").limit(SEED_DOCS).collect()
    x = np.array([np.frombuffer(bytes(r["p"]), "<f4") for r in got], np.float64).reshape(-1, ENDINGS)
    if not len(x):
        return np.eye(STATES, ENDINGS)
    centres = [x[0]]
    while len(centres) < STATES:  # farthest first among a thinned set, then k-means
        far = (x @ np.array(centres).T).max(axis=1)
        centres.append(x[np.argsort(far, kind="stable")[len(x) // 50]])
    c = np.array(centres)
    for _ in range(20):
        to = (x @ c.T).argmax(axis=1)
        for s in range(STATES):
            if (to == s).any():
                c[s] = x[to == s].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def train_and_score(docs: DataFrame, *, gain: float = GAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, unigram_score)`` of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "hmm")
    chunks = scratch.save(_chunks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), "chunks")
    occ = _occurrences(chunks)
    totals = scratch.save(occ.groupBy("w").agg(F.sum("c").alias("c")), "totals")
    seen = totals.where("c > 0")
    head = seen.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    frequent = [(r["w"], r["c"]) for r in seen.orderBy(F.desc("c"), "w").limit(LEXICON).collect()]
    least = frequent[-1] if len(frequent) == LEXICON else None
    tied = seen.where("false") if least is None else seen.where((F.col("c") < least[1]) | ((F.col("c") == least[1]) & (F.col("w") > least[0])))
    band = sum(((F.col("c") > b).cast("int") for b in BANDS), F.lit(0))
    mass = tied.groupBy((band * ENDINGS + F.col("w").bitwiseAND(0xFF)).alias("k")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect()
    lex = Lexicon(head["n"] or 0, head["v"], head["once"], frequent, {int(r["k"]): r["m"] for r in mass})
    coded = scratch.save(_coded(chunks, occ.select("chunk", "pos", "w").join(totals, "w").select("chunk", "pos", "c"), lex), "coded")
    scratch.drop(chunks, totals)
    unigram, endings = lex.unigram(), lex.endings()
    model = Model(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 1 / STATES), np.repeat(unigram[:, None], STATES, axis=1))
    if lex.total:
        n_docs = coded.agg(F.sum(F.size("n"))).first()[0]
        centres = _seed_states(coded, endings, n_docs)

        def hard(batches):
            start, emit = np.zeros(STATES), np.zeros((SYMBOLS, STATES))
            for b in batches:
                for r in range(b.num_rows):
                    n, held, syms = _arrays(b, r)
                    to = np.repeat((_profile(endings, syms, n) @ centres.T).argmax(axis=1), n)
                    use = ~np.repeat(held, n)
                    emit += np.bincount(syms[use] * STATES + to[use], minlength=SYMBOLS * STATES).reshape(SYMBOLS, STATES)
            yield _count_rows(start, np.zeros((STATES, STATES)), emit)

        _, _, emit, _ = _gather(coded, hard)
        size = emit.sum(axis=0) + 1
        move = STAY * np.eye(STATES) + (1 - STAY) * size / size.sum()
        model = Model.from_counts(size, move * size.sum(), emit, unigram)
        last = -np.inf
        while True:  # the likelihood of training text never falls

            def pass_(batches, model=model):
                start, move, emit, total = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES)), 0.0
                for b in batches:
                    for r in range(b.num_rows):
                        n, held, syms = _arrays(b, r)
                        if (~held).any():
                            *counts, more = expected_counts(model, *segments(syms, n, ~held))
                            total += more
                            for whole, part in zip((start, move, emit), counts):
                                whole += part
                yield _count_rows(start, move, emit, total)

            *counts, now = _gather(coded, pass_)
            model = Model.from_counts(*counts, unigram)
            now /= lex.total
            if now - last < gain:
                break
            last = now
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("unigram_score", pa.float64())])
    alone = np.log10(np.maximum(unigram, 1e-300))

    def score(batches):
        for b in batches:
            for r in range(b.num_rows):
                n, held, syms = _arrays(b, r)
                tied = b.column(6)[r].values.to_numpy()
                p = log10_probability(model, syms, n) + tied
                one = np.add.reduceat(alone[syms], np.concatenate([[0], np.cumsum(n)[:-1]])) + tied
                yield to_batch(schema, doc_id=b.column(3)[r].as_py(), held_out=held, n_tokens=n, n_known=b.column(4)[r].values, train_tokens=np.full(len(n), lex.total), base_score=b.column(5)[r].values, score=p, unigram_score=one)

    return coded.select("n", "held_out", "syms", "doc_id", "known", "base", "tied").mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, unigram_score double"
    )
