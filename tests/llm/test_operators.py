"""Training-data operators against brute force, on small and awkward tables."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import bpe, forest, hmm, minhash, mixing, nndescent, pfor, quality, queries, shards, warc

SF = "/root/testdata/sf0.001"
AWKWARD = [(1, "one two three"), (2, "one two three"), (3, None), (4, ""), (5, "   "), (6, "x " * 5000), (7, "ONE two Three"), (None, "no id"), (8, "<|endoftext|> a"), (8, "<|endoftext|> a"), (9, "\u00e9\u4e2d\U0001f600 \u0000z")]
DOCS = "doc_id long, text string, n long, size string, ids string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, 1, "clash", "clash") for i, t in AWKWARD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library(spark, awkward, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.BYTE_TOKENIZER)
    lib = Tokenizer.from_file(path)
    got = bpe.round_trip_digests(awkward, path).collect()
    want = []
    for i, t in AWKWARD:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert [tuple(r) for r in got] == want
    assert bpe.round_trip_digests(empty, path).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(awkward, path), path).collect()
    assert [r.text for r in back] == [t or "" for _, t in AWKWARD]


def test_token_files_equal_the_library(spark, awkward, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    lib = Tokenizer.from_file(path)
    got = sorted(pfor.file_digests(awkward, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9]
    texts, at = dict(AWKWARD), 0
    for r in got:
        ids = np.array(lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert pfor.file_digests(empty, path).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for values in (np.zeros(5, np.uint32), np.arange(1024, dtype=np.uint32), rng.integers(0, 2**32, 1000, dtype=np.uint32), np.array([7] * 99 + [2**32 - 1], np.uint32)):
        raw = pfor.pack_block(values)
        assert (pfor.unpack_block(memoryview(raw), 0) == values).all()
    f = pfor.TokenFile(pfor.pack_file(0, 0, [1, None], [np.arange(3000), np.arange(5)]))
    assert (f.read_range(1000, 2100) == np.arange(1000, 2100)).all() and [d for d, _, _ in f.documents()] == [1, None]


def _sets(rows, words):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    return out


def _components(ids, linked):
    root = {i: i for i in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_minhash_equals_brute_force(spark, awkward, empty):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    rows += [(10_000 + i, " ".join(base[:i] + [f"edit{i}"] + base[i + 1 :])) for i in range(20)] + [(10_100, " ".join(base))]
    sets = _sets(rows, 2)
    want = _components(list(sets), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert {i: r.component_id for i, r in got.items()} == want and {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    odd = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(awkward, words=2).collect()}
    assert {(1, 1), (2, 1), (7, 1), (3, 3), (4, 4), (5, 5), (None, None), (8, 8)} <= odd
    assert minhash.near_duplicates(empty).count() == 0
    kept = sorted((r.doc_id or 0) for r in minhash.deduplicate(awkward).collect())
    assert kept == [0, 1, 3, 4, 5, 6, 8, 9]


def _vectors():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    x[200:260] = x[0] + 0.05 * rng.standard_normal((60, 16))
    x[300:310] = x[1]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return x, rows + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (904, [None] * 16), (None, rows[0][1])]


def test_forest_equals_brute_force(spark):
    x, rows = _vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T >= 0.9
    want = _components(list(range(400)), lambda a, b: g[a, b])
    got = {r.vec_id: r for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() if r.vec_id is not None}
    assert all(got[i].n_links == g[i].sum() - 1 and got[i].component_id == want[i] for i in range(400))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))
    odd = [(1, [1e200, 0.0, 0.0]), (2, [2e200, 0.0, 0.0]), (3, [1e-200, 0.0, 0.0]), (4, [1.0, 0.0]), (5, [2.0, 0.0]), (6, [0.0, 1.0]), (7, [1.0]), (8, [3.0]), (8, [0.0, 3.0]), (9, None), (10, [3.0, 3.0]), (10, [-3.0, 3.0]), (11, [2.9, 3.0])]
    got = forest.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in odd], "vec_id long, embedding array<double>, rep string, links int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (8, 1, 6), (8, 1, 6), (9, 0, 9), (10, 0, 10), (10, 1, 10), (11, 1, 10)]
    assert forest.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_neighbour_recall(spark):
    x, rows = _vectors()
    got = nndescent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    hit = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        s[q] = -np.inf
        mine = [r for r in got if r.query_id == q]
        assert [r.rank for r in sorted(mine, key=lambda r: (-r.score, r.vec_id))] == list(range(1, 21))
        hit += len(set(np.lexsort((np.arange(400), -s))[:20]) & {r.vec_id for r in mine})
    assert hit >= 0.9 * 400
    assert nndescent.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_shards(spark, awkward, empty):
    got = shards.assign(awkward, 4).collect()
    assert len(got) == len(AWKWARD)
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.doc_id in (1, 2)}) == 1
    assert shards.assign(empty, 4).count() == 0
    done = shards.difference([shards.Partial([0, v], [None, i]) for i, v in enumerate((8, 7, 6, 5, 4))], 2)
    assert done.sums == [14, 16] and sorted(shards.members(done.bins[0]) + shards.members(done.bins[1])) == [0, 1, 2, 3, 4]


def test_shards_balance_bytes_and_keep_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(spark.createDataFrame([(-1, None, "x", "y", 0), (-2, "", "x", "y", 0), (-2, "", "x", "y", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = shards.assign(docs.withColumn("grp", F.lit(1)).withColumn("size", F.lit("x")), 10).collect()
    assert len(got) == docs.count()
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    where: dict = {}
    for r in got:
        where.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    load = [sum(r.size for r in got if r.shard == s) for s in range(10)]
    assert sum(load) == sum(r.size for r in got) and max(load) - min(load) <= 0.001 * sum(load) / 10
    for s in range(10):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_budgets_go_to_siblings_first():
    leaves = {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 100}
    got = mixing.budgets(leaves, {}, 100, 1)
    assert got == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    assert mixing.budgets({("a", "x"): 10, ("b", "z"): 100}, {}, 100, 1) == {("a", "x"): 10, ("b", "z"): 90}
    assert mixing.divide(10, [1, 1, 1], [100, 100, 100]) == [4, 3, 3]


def test_mixture_equals_a_plain_version(spark):
    """Nulls, repeated rows and ids, ties, and columns with clashing names, against a driver-side selection."""
    rng = np.random.default_rng(11)
    rows = [(int(i), " ".join(["w"] * int(rng.integers(1, 9))), rng.choice(["a", "b"]), rng.choice(["x", "y", None])) for i in range(600)]
    rows += [(None, "n n", "a", "x"), (None, "n n", "a", "x"), (7, "r r r", "b", "y"), (7, "r r r", "b", "y"), (8, None, "a", "x"), (9, "  ", "b", None)]
    rows = [(i, t, a, b, "c1", 5, "c2", "c3", 2.0, "c4", "c5") for i, t, a, b in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, top string, leaf string, full string, rest int, ranges string, last string, room double, range string, mix_tokens string")
    levels = {"top": F.col("top"), "leaf": F.col("leaf")}
    weights = {("a",): 3.0, ("a", "x"): 0.5, ("b", "y"): 0.0}
    got = mixing.mix(docs, levels, weights, budget=1_000, max_epochs=2)
    assert got.columns == [c for c in docs.columns if c != "mix_tokens"] + ["mix_top", "mix_leaf", "mix_tokens", "mix_epoch"]
    out = got.collect()
    assert {(r.full, r.rest, r.ranges, r["last"], r.room, r["range"]) for r in out} == {("c1", 5, "c2", "c3", 2.0, "c4")}
    size: dict = {}
    for r in rows:
        size.setdefault((r[2], r[3]), []).append(len((r[1] or "").split()))
    tokens = {k: sum(v) for k, v in size.items()}
    # by hand: b/y is closed; a has three quarters of the budget but no more than two epochs of its tokens
    cap_a, cap_b = 2 * sum(n for k, n in tokens.items() if k[0] == "a"), 2 * sum(n for k, n in tokens.items() if k[0] == "b" and k[1] != "y")
    assert cap_a >= 750 and cap_b >= 250
    want = mixing.budgets(tokens, weights, 1_000, 2)
    assert sum(n for k, n in want.items() if k[0] == "a") == 750 and want["b", "y"] == 0
    for leaf, n in want.items():
        mine = [r for r in out if (r.mix_top, r.mix_leaf) == leaf]
        taken = sum(r.mix_tokens for r in mine)
        assert n <= taken < n + 9 if n else not mine, leaf  # over by less than one document
        assert sum(r.mix_tokens for r in mine if r.mix_epoch == 0) <= tokens[leaf]
        whole = n // tokens[leaf]
        for e in range(whole):
            assert sum(r.mix_tokens for r in mine if r.mix_epoch == e) == tokens[leaf]
    again = mixing.mix(docs, levels, weights, budget=1_000, max_epochs=2).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixture_takes_prefixes(spark, empty):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") < 1000, "s").otherwise("t").alias("source"))
    got = mixing.mix(docs, {"source": F.col("source")}, {("s",): 3.0}, budget=8000, max_epochs=2)
    n = {r[0]: r[1] for r in got.groupBy("source").count().collect()}
    assert n == {"s": 1500, "t": 500} and got.where("source = 's' and mix_epoch = 0").count() == 1000
    assert mixing.mix(empty, {"size": F.col("size")}, {}, budget=10).count() == 0


def test_hmm_base_and_gain(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = hmm.train_and_score(docs).toPandas()
    assert len(got) == 200 and got[got.held_out].score.sum() > got[got.held_out].base_score.sum()
    odd = hmm.train_and_score(awkward).collect()
    assert len(odd) == len(AWKWARD) and all(np.isfinite(r.score) for r in odd)
    assert {r.n_tokens for r in odd if r.doc_id in (3, 4, 5)} == {1}
    assert hmm.train_and_score(empty).count() == 0


def test_forward_is_exact():
    rng = np.random.default_rng(2)
    emit = np.zeros((hmm.SYMBOLS, 2))
    emit[:3] = rng.dirichlet([1, 1, 1], 2).T
    m = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), emit)
    syms = np.array([0, 2, 1, 1, 0])
    total = 0.0
    for path in np.ndindex(*(2,) * 5):
        p = m.start[path[0]] * emit[syms[0], path[0]]
        for t in range(1, 5):
            p *= m.move[path[t - 1], path[t]] * emit[syms[t], path[t]]
        total += p
    assert hmm.log10_probability(m, syms, np.array([5]))[0] == pytest.approx(np.log10(total))


def test_whole_document_messages_equal_enumeration(monkeypatch):
    """Expected counts over all state paths, of documents cut into segments of two tokens."""
    monkeypatch.setattr(hmm, "SEGMENT", 2)
    rng = np.random.default_rng(4)
    emit = np.zeros((hmm.SYMBOLS, 3))
    emit[:4] = rng.dirichlet([1] * 4, 3).T
    m = hmm.Model(rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), emit)
    docs = [rng.integers(0, 4, n) for n in (1, 2, 5, 6)]
    start, move, out, log = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3)), 0.0
    for d in docs:
        paths = []
        for path in np.ndindex(*(3,) * len(d)):
            p = m.start[path[0]] * emit[d[0], path[0]]
            for t in range(1, len(d)):
                p *= m.move[path[t - 1], path[t]] * emit[d[t], path[t]]
            paths.append((p, path))
        total = sum(p for p, _ in paths)
        log += np.log10(total)
        for p, path in paths:
            start[path[0]] += p / total
            for t, s in enumerate(path):
                out[d[t], s] += p / total
                if t:
                    move[path[t - 1], s] += p / total
    n = np.array([len(d) for d in docs])
    got = hmm.expected_counts(m, *hmm.segments(np.concatenate(docs), n, np.ones(len(docs), bool)))
    for a, b in zip(got, (start, move, out, log)):
        assert np.allclose(a[:4] if np.ndim(a) == 2 and len(a) > 4 else a, b, rtol=1e-4, atol=1e-4)


def test_hmm_base_equals_a_plain_count(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + AWKWARD
    words = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    count: dict = {}
    for w, h in zip(words, held):
        for x in w if not h else ():
            count[x] = count.get(x, 0) + 1
    total = sum(count.values())
    want = sorted((str(i), h, len(w), sum(x in count for x in w), total, round(sum(np.log10((count.get(x, 0) + 0.5) / (total + 0.5 * (len(count) + 1))) for x in w), 6)) for (i, _), w, h in zip(rows, words, held))
    got = hmm.train_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_ordinal_fit_equals_an_independent_one():
    """Gradient by differences, and the optimum of a dense fit by another method."""
    rng = np.random.default_rng(6)
    x = (rng.random((300, 6)) < 0.4).astype(float)
    score = x @ np.array([2.0, -2.0, 1.0, 0.0, 0.0, 0.0])
    g = (score[:, None] + rng.logistic(size=(300, 1)) > np.array([[-0.5, 1.0]])).sum(axis=1)
    row, col = np.nonzero(x)
    f = quality.Likelihood(g, row, col, np.ones(len(row)), 6)
    w, raw = rng.standard_normal(6), np.array([-0.3, 0.2])
    _, by_w, by_raw = f(w, raw)
    for grad, at in ((by_w, w), (by_raw, raw)):
        for i in range(len(at)):
            at[i] += 1e-5
            up = f(w, raw)[0]
            at[i] -= 2e-5
            down = f(w, raw)[0]
            at[i] += 1e-5
            assert abs((up - down) / 2e-5 - grad[i]) < 1e-6
    rows = [(np.flatnonzero(r).astype(np.int32), np.ones(int(r.sum()), np.float32)) for r in x]
    got = quality.fit(g, rows + rows, penalty=1e-3, refit=1.0, steps=3000, min_documents=1)  # copies count once: the rows must differ
    once = {(int(k), tuple(np.flatnonzero(r))) for k, r in zip(g, x)}
    gu = np.array([k for k, _ in once])
    xu = np.array([[float(i in c) for i in range(6)] for _, c in once])

    def loss(p):
        cut = np.array([p[6], p[6] + np.exp(p[7])])
        c = np.concatenate([np.zeros((len(gu), 1)), 1 / (1 + np.exp(-(cut - (xu @ p[:6])[:, None]))), np.ones((len(gu), 1))], axis=1)
        return -np.log(c[np.arange(len(gu)), gu + 1] - c[np.arange(len(gu)), gu]).mean() + 1e-3 * np.abs(p[:6]).sum()

    mine = np.array([got.weights.get(i, 0.0) for i in range(6)] + [got.thresholds[0], np.log(got.thresholds[1] - got.thresholds[0])])
    best = loss(mine)
    for _ in range(2_000):  # no nearby point is better
        assert loss(mine + rng.standard_normal(8) * rng.choice([1e-3, 1e-2, 1e-1])) > best - 2e-6


def test_classifier_separates_grades(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.score_documents(docs, model).join(quality.rated(labels), "doc_id").toPandas()
    assert got[got.grade == 2].kept.mean() > 0.98 and got[got.grade == 0].kept.mean() < 0.05
    assert list(model.thresholds) == sorted(model.thresholds)


def test_classifier_on_documents_it_was_not_fitted_on(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = labels.where("doc_id % 3 <> 0")
    model = quality.train(docs, train.unionByName(train))  # repeated ratings count once
    assert list(model.thresholds) == sorted(model.thresholds)
    got = quality.score_documents(docs, model).join(quality.rated(labels.where("doc_id % 3 = 0")), "doc_id").toPandas()
    assert got[got.grade == 2].kept.mean() > 0.96 and got[got.grade == 0].kept.mean() < 0.05 and got[got.grade == 1].kept.mean() < 0.3
    odd = quality.score_documents(awkward, model).collect()
    assert len(odd) == len(AWKWARD) and {(r.expected_grade, r.tail_probability, r.kept) for r in odd if r.doc_id in (3, 4, 5)} == {(0.0, 0.0, False)}
    kept = {(r.doc_id, r.tail_probability) for r in odd if r.kept}
    assert sorted(map(str, quality.keep_documents(awkward, model).collect())) == sorted(str(r) for r in awkward.collect() if any(r.doc_id == i for i, _ in kept))
    assert quality.score_documents(empty, model).count() == 0 and quality.keep_documents(empty, model).count() == 0
    none = quality.train(docs, labels.where("false"))
    assert quality.score_documents(awkward, none).where("not kept").count() == 0


def test_revisits(spark):
    rows = [
        (1, "response", "http://WWW.a.org:80/x/?b=2&a=1#f", 10, {"ETag": 'W/"1"', "Server": "s"}), (2, "revisit", "https://a.org/x?a=1&b=2", 20, {"etag": '"1"', "Expires": "e", "Server": "t"}),
        (3, "revisit", "a.org/x?a=1&b=2", 30, {"etag": '"2"'}), (4, "revisit", "a.org/x?a=1&b=2", 5, {}), (5, "revisit", "a.org/x?a=1&b=2", 40, None), (6, "revisit", None, 1, {}), (7, "revisit", "a.org/x?a=1&b=2", None, {}),
    ]
    df = spark.createDataFrame(rows, "record_id long, record_type string, url string, s long, headers map<string,string>").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert {i: r.outcome for i, r in got.items()} == {1: "response", 2: "resolved", 3: "validator_mismatch", 4: "orphan", 5: "unverified", 6: "no_url", 7: "no_time"}
    assert got[5].refers_to is None and got[5].headers == {}
    twice = warc.resolve_revisits(df.unionByName(df).withColumn("near", F.lit("clash")).withColumn("slice", F.lit("clash"))).collect()
    assert sorted((r.record_id, r.outcome) for r in twice) == sorted(2 * [(i, r.outcome) for i, r in got.items()])
    tied = df.where("record_id in (1, 2)").withColumn("ts", F.timestamp_seconds(F.lit(10)))  # equal times: ordered by record id
    assert {r.record_id: r.refers_to for r in warc.resolve_revisits(tied).collect()} == {1: 1, 2: 1}
    assert got[2].headers == {"etag": '"1"', "expires": "e", "server": "s"} and got[2].refers_to == 1
    assert warc.resolve_revisits(df.where("false")).count() == 0


def test_revisit_query_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    got = queries.op1_revisits(spark, SF)
    cols = sorted(got.columns)
    r = c.execute(queries.oracle_sql()["op1_revisits"])
    at = [[d[0] for d in r.description].index(x) for x in cols]
    key = lambda row: tuple(map(str, row))
    assert sorted(map(key, got.select(*cols).collect())) == sorted(key([row[i] for i in at]) for row in r.fetchall())


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    assert len({r.doc_id for r in out}) == len(out) and 0 < len(out) < docs.count()


def test_files_hold_every_byte_value(spark, tmp_path):
    """The text writer copies bytes as they are, whatever they are, and adds one line feed."""
    rng = np.random.default_rng(2)
    raw = [bytes(range(256)) + rng.bytes(5_000) + b"\r\n\n", b"\xff\xfe\x00", b"\r"]
    files = spark.createDataFrame([(bytearray(r + b"\n"),) for r in raw], "file binary")
    pfor.as_text(files).write.option("maxRecordsPerFile", 1).text(str(tmp_path / "f"))
    back = spark.read.format("binaryFile").load(str(tmp_path / "f")).select("content").collect()
    assert sorted(bytes(r.content) for r in back) == sorted(r + b"\n" for r in raw)


def test_minhash_blocks_join_what_is_linked(spark, monkeypatch):
    """Spanning links of the blocks against brute force on whole sets, whatever the block size."""
    rng = np.random.default_rng(3)
    base = [rng.choice(1 << 40, 100, replace=False) for _ in range(4)]
    sets = []
    for i in range(80):
        own = base[i % 4].copy()
        own[: rng.integers(0, 25)] = rng.choice(1 << 40, 1) + np.arange(1)
        sets.append(np.unique(own))
    sigs = [minhash.signature(s.astype(np.uint64)) for s in sets]
    classes = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "cls long, sig binary")
    keys = minhash._emit_keys(classes)
    elements = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in enumerate(sets)], "cls long, elements array<long>")
    size = elements.select("cls", F.size("elements").cast("long").alias("size"))
    rows = keys.join(size, "cls")
    n = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("volume"))
    rest = rows.join(n, "key").join(classes, "cls").withColumn("comp", keys.cls)
    link = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
    want = _components(list(range(80)), link)
    for block, volume in ((5, 1 << 21), (1_024, 1_500), (1_024, 1 << 21)):
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "BLOCK_ELEMENTS", volume)
        got = {tuple(r) for r in minhash._compare_rest(rest, elements, 80).collect()}
        assert got and all(link(a, b) for a, b in got)
        assert _components(list(range(80)), lambda a, b: (a, b) in got) == want


def test_neighbours_of_repeated_rows_lengths_and_ties(spark):
    """Few rows, so every answer is complete: against brute force over rows."""
    rows = [(i, [float(i % 4), 1.0]) for i in range(15)] + [(20, [1.0, 1.0]), (20, [1.0, 1.0]), (20, [0.0, 2.0]), (40, [1.0]), (41, [5.0]), (42, [1e300]), (60, None), (None, [1.0, 1.0]), (80, [0.0, 0.0])]
    got = nndescent.nearest(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, node string")).collect()
    want = []
    good = [(i, v) for i, v in rows if i is not None and v and any(v)]
    for at, (q, v) in enumerate(good):
        if q % 20 == 0:
            near = sorted((-float(np.dot(v, w)), i) for j, (i, w) in enumerate(good) if j != at and len(w) == len(v))[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_neighbour_graph_converges(spark, monkeypatch):
    """A poor start needs more rounds than four; the graph's own lists must still be near the truth."""
    monkeypatch.setattr(nndescent, "TREES", 2)
    monkeypatch.setattr(nndescent, "LEAF", 8)
    x = np.random.default_rng(8).standard_normal((2_000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, i, bytearray(v.astype("<f8").tobytes())) for i, v in enumerate(x)], "node long, vec_id long, vec binary")
    index = nndescent.build(rows, 48, nndescent.Scratch(spark, "test"))
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    near = np.argsort(-s, axis=1)[:, :10]
    hit = sum(len(set(near[r.id].tolist()) & set(r.around)) for r in index.graph.collect())
    assert hit >= 0.97 * near.size, hit / near.size


def test_forest_finds_all_links_of_a_wide_group(spark):
    """A third of the vectors at cosine 0.80 to 0.97 from one centre."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((9_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = x[1:3_000] - np.outer(x[1:3_000] @ x[0], x[0])
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.80, 0.97, (2_999, 1))
    x[1:3_000] = c * x[0] + np.sqrt(1 - c * c) * side
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in forest.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert sum(want) and all(got[i] == n for i, n in enumerate(want)), sum(got.values()) / sum(want)


def test_workers_drop_the_word_cache_after_encoding(spark):
    """The stages after the encoding run in the same workers, whose memory the cache would keep."""
    pfor.file_digests(spark.read.parquet(f"{SF}/documents.parquet"), queries.tokenizer_path(queries.WORD_TOKENIZER)).count()

    def held(batches):
        import pandas as pd

        for _ in batches:
            yield pd.DataFrame({"pid": [os.getpid()], "n": [len(pfor._LOADED)]})

    seen = {r.pid: r.n for r in spark.range(0, 40, 1, 40).mapInPandas(held, "pid long, n long").collect()}
    assert 0 in seen.values(), seen


def test_texts_are_cut_in_small_slices():
    import pyarrow as pa

    from quillstone.llm.common import slices

    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(["x" * (1 << 20)] * 8)], names=["doc_id", "text"])
    assert [len(s["text"]) for s in slices([batch], ["doc_id", "text"], bpe.SLICE_BYTES)] == [1] * 8


def test_counts_of_a_chunk_are_packed_outside_the_jvm(spark):
    lex = hmm.Lexicon(5, 2, 0, [(1 << 8, 3), (2 << 8, 2 << 40)], {})
    u4, i8 = (lambda *x: np.array(x, "<u4").tobytes()), (lambda *x: np.array(x, "<i8").tobytes())
    rows = [(7, [1], [False], [3], u4(0, 1, 0), i8(1 << 8, 2 << 8), None), (9, [2], [True], [1], u4(0), i8(1 << 8), None)]
    chunks = spark.createDataFrame(rows, "chunk long, doc_id array<long>, held_out array<boolean>, n array<long>, toks binary, words binary, counts binary")
    counts = spark.createDataFrame([(7, 1, 2 << 40), (9, 0, 3), (7, 0, 3)], "chunk long, pos int, c long")
    coded = hmm._coded(chunks, counts, lex)
    assert "collect_list" not in coded._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id[0]: r for r in coded.collect()}
    want = [np.log10((c + 0.5) / (5 + 0.5 * 3)) for c in (3, 2 << 40, 3)]
    assert abs(got[1].base[0] - sum(want)) < 1e-9 and got[1].known == [3] and abs(got[2].base[0] - want[0]) < 1e-9


def test_samples_of_trees_are_thinned_before_the_driver(spark):
    from quillstone.llm.common import may_be_least

    h = F.xxhash64("id")
    ids = spark.range(200_000).select("id", h.alias("h"))
    few = ids.where(may_be_least(F.col("h"), 200_000, 1_000))
    assert 1_000 <= few.count() <= 2_000
    assert few.orderBy("h").limit(1_000).collect() == ids.orderBy("h").limit(1_000).collect()
    assert ids.where(may_be_least(F.col("h"), 1_200, 1_000)).count() == 200_000


def _grouped(n, dim, wide):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((n, dim))
    x[:wide] = x[0] + 0.25 * rng.standard_normal((wide, dim))
    return x


def _shuffle_bytes(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(os.path.join(d, f)) for top in dirs for d, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_"))


def test_forest_leaves_little_on_disk(spark, monkeypatch):
    """The places of trees that are done must not stay, whether or not the driver collects garbage."""
    monkeypatch.setattr(forest, "TURN_BYTES", 1, raising=False)
    x = _grouped(9_000, 64, 500)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4).localCheckpoint()
    before, most, save = _shuffle_bytes(spark), [0], forest.Scratch.save

    def saved(self, df, tag, **how):
        out = save(self, df, tag, **how)
        if tag == "found":
            most[0] = max(most[0], _shuffle_bytes(spark) - before)
        return out

    monkeypatch.setattr(forest.Scratch, "save", saved)
    forest.near_duplicates(rows).count()
    assert most[0] < 2 * x.nbytes, most[0] / x.nbytes


def test_forest_in_parts_equals_brute_force(spark, monkeypatch):
    """Turns that hold a part of a tree's blocks, and leaves that are cut into blocks."""
    for name, value in (("LEAF", 500), ("BLOCK", 256), ("PLACES", 1.5), ("TURN_BYTES", 1)):
        monkeypatch.setattr(forest, name, value)
    monkeypatch.setattr(forest, "BLOCK_BYTES", 8 * 32 * 256)
    monkeypatch.setattr(forest.grow, "__kwdefaults__", forest.grow.__kwdefaults__ | {"leaf": 500})
    x = _grouped(2_000, 32, 600)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1_000:1_500] = x[1_000:1_500].astype(np.float32)  # some rows travel in single precision, some do not
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in forest.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert sum(want) and [got[i] for i in range(2_000)] == want.tolist()
    assert forest.turns_of([1.0, 1.5, 7.0, 2.0], 3.0) == [(0, 2, 0, 1), (2, 3, 0, 3), (2, 3, 1, 3), (2, 3, 2, 3), (3, 4, 0, 1)]
    assert forest.turns_of([7.0], 3.0) == [(0, 1, 0, 3), (0, 1, 1, 3), (0, 1, 2, 3)] and forest.turns_of([], 3.0) == []


def test_placing_is_the_same_in_any_batch():
    rng = np.random.default_rng(4)
    x = forest.unit(rng.standard_normal((4_000, 48)))
    trees = forest.grow(x.astype(np.float32), 4_000, 0.9, leaf=100)
    q = forest.rounded(x)
    row, leaf = trees.place(q, 0, len(trees))
    for r in (0, 7, 3_999):
        assert trees.place(q[r : r + 1], 0, len(trees))[1].tolist() == leaf[row == r].tolist()
    assert len(trees.base) == len(trees) + 1 and leaf.max() < trees.base[-1]


def test_word_cache_equals_the_library_on_every_plain_character():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    lib, mine = Tokenizer.from_file(path), pfor.WordTokenizer(path)
    texts = [f"{c} a{c}b{c}{c} 1{c}2 {c}'s it'{c} X{c}" for c in map(chr, range(0x300))] + ["w" * 3_000 + " end", "äÖß Straße naïve Été "]
    for t, raw in zip(texts, mine.encode_many(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, ascii(t)
    assert not any(len(w) > pfor.CACHED_LENGTH for w in mine.cache)


def test_words_go_to_the_model_once_and_ids_stay_in_the_worker(spark, awkward, monkeypatch):
    """The library's search for words is only for texts outside the plain range."""
    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    mine = pfor.WordTokenizer(path)

    class Library:
        def encode(self, text, **_):
            raise AssertionError(text)

    mine.lib = Library()
    if hasattr(mine.cache, "lib"):
        mine.cache.lib = mine.lib
    assert [len(x) > 0 for x in mine.encode_many(["plain words, 12 of them", None, "été"])] == [True, False, True]
    monkeypatch.setattr(pfor, "CACHE_PIECES", 2)
    assert mine.encode("one two three four") == b"".join(map(mine.encode, ("one", "two", "three", "four"))) and len(mine.cache) <= 2
    folder, rows = pfor.token_files(awkward, path)
    want = sorted((r.part, r.seq, r.file_start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in rows.collect())
    assert sorted((r.part, r.seq, r.file_start, r.n_tokens, r.ids_crc32) for r in pfor.read_digests(spark, folder).collect()) == want


def test_kept_documents_pass_in_small_batches_and_memory_goes_back(monkeypatch):
    import pyarrow as pa

    class Docs:
        columns, schema = ["doc_id", "text"], None

        def mapInArrow(self, run, _):
            return run

    calls = []
    monkeypatch.setattr(quality, "trim", lambda: calls.append(1), raising=False)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5_000)), pa.array(["a b c"] * 5_000)], names=["doc_id", "text"])
    out = list(quality.keep_documents(Docs(), quality.OrdinalModel())([batch]))
    assert sum(b.num_rows for b in out) == 5_000 and max(b.num_rows for b in out) <= 1_024 and calls == [1]
