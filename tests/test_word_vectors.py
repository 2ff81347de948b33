"""Word vectors from co-occurrence: weights against plain Python, neighbours of planted words."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from relevo.operators import vectors as vx


def weights(texts, window, top, smooth=.75):
    n = Counter()
    for t in dict.fromkeys(texts):
        w = t.split()
        for i in range(len(w)):
            for j in range(max(0, i - window), min(len(w), i + window + 1)):
                if i != j:
                    n[w[i], w[j]] += 1
    of = Counter()
    for (a, _), k in n.items():
        of[a] += k
    ctx = sorted(sorted(of, key=lambda w: (-of[w], w))[:top])
    flat = sum(of[c] ** smooth for c in ctx)
    out = {}
    for (a, c), k in n.items():
        if c in ctx:
            v = math.log(k / of[a] * flat / of[c] ** smooth)
            if v > 0:
                out[a, ctx.index(c)] = v
    return out


def test_context_weights(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefghij") for _ in range(r.choice([0, 1, 2, 7, 20]))) for _ in range(30)]
    texts += texts[:5] + [" a  b\tc "]
    rows, n = vx.context_weights(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"), window=3, max_contexts=6)
    got = {(x.word, c): v for x in rows.collect() for c, v in zip(x.cols, x.vals)}
    want = weights(texts, 3, 6)
    assert n == 6 and set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_words_of_like_contexts_are_neighbours(spark):
    r = random.Random(2)
    groups = [["red", "green", "blue"], ["drill", "hammer", "saw"], ["monday", "friday", "sunday"]]
    around = [["paint", "colour", "wall", "bright"], ["tool", "wood", "steel", "nail"], ["week", "early", "night", "open"]]
    texts = []
    for _ in range(400):
        g = r.randrange(3)
        texts.append(" ".join([r.choice(around[g]), r.choice(groups[g]), r.choice(around[g]), "the", r.choice(around[g]), r.choice(groups[g])]))
    wv = vx.fit_word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"), size=6)
    assert len(wv.first().vector) == 6
    words = wv.where(wv.word.isin(*[w for g in groups for w in g]))
    q = words.selectExpr("word AS query_id", "vector AS qvec")
    near = vx.nearest(q, words.withColumnRenamed("word", "word_id"), 3).collect()
    home = {w: i for i, g in enumerate(groups) for w in g}
    assert len(near) == 27 and all(home[x.query_id] == home[x.word_id] for x in near)
    pairs = spark.createDataFrame([("red", "blue"), ("red", "saw"), ("red", "nowhere")], "a string, b string")
    cos = {(x.a, x.b): x.cosine for x in vx.word_cosine(pairs, wv).collect()}
    assert cos["red", "blue"] > .8 > cos["red", "saw"] and cos["red", "nowhere"] is None


def test_pair_vectors_dense_and_joined_agree(spark, monkeypatch):
    """Few vectors are held by the tasks, many are joined; words without a vector, repeated ids, null texts and unknown products included."""
    from relevo.operators import vectors as vx
    r = np.random.default_rng(4)
    vec = [(i, [float(x) for x in r.normal(size=4)]) for i in range(0, 40) if i % 5] + [(1, [1.0, 0.0, 2.0, 0.0]), (2, [0.0] * 4), (40, None)]
    wv = spark.createDataFrame(vec, "word_id long, vector array<double>")
    pairs = spark.createDataFrame([(1, 1, "a b c a"), (2, 1, "d e"), (3, 2, "a f"), (4, 7, "a b"), (5, 2, ""), (6, 1, None), (7, 3, "g h i j k l")], "pair_id long, product_uid long, q string")
    prods = spark.createDataFrame([(1, "b c d m n o p"), (2, ""), (2, "q r s t"), (3, None), (3, "g u v w x y z")], "product_uid long, title string")
    plan = []
    real = vx._dense_sides
    monkeypatch.setattr(vx, "_dense_sides", lambda *a: (plan.append("dense"), real(*a))[1])

    def run():
        return sorted(tuple(round(float(x), 9) for x in row) for row in vx.pair_vector_features(pairs, prods, wv, 41, "title", "t").collect())
    one = run()
    monkeypatch.setattr(vx, "MAX_VECTORS", 1)
    assert one == run() and plan == ["dense"] and len(one) == 8 - 1
    assert any(x[1] > 0 for x in one)


def test_nearest_brings_k_rows_per_query_and_task(spark, monkeypatch):
    """Exact over many small steps, with ties of equal vectors told by key; a task brings k rows per query, however many batches it reads."""
    r = np.random.default_rng(5)
    vecs = r.normal(size=(900, 6))
    vecs[100:160] = vecs[100]
    vecs[7] = 0.0
    names = [f"w{i:04d}" for i in r.permutation(900)]
    v = spark.createDataFrame([(n, [float(y) for y in x]) for n, x in zip(names, vecs)], "word_id string, vector array<double>").repartition(2)
    q = spark.createDataFrame([(n, [float(y) for y in x]) for n, x in zip(names[90:190], vecs[90:190])], "query_id string, qvec array<double>")
    monkeypatch.setattr(vx, "FIRST_ROWS", 16)
    monkeypatch.setattr(vx, "MAX_EXACT", 50)
    brought = []
    real = vx.top_n_per_group
    monkeypatch.setattr(vx, "top_n_per_group", lambda s, *a, **b: brought.append(s.count()) or real(s, *a, **b))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {}
        for x in vx.nearest(q, v, 4, cells=2000).collect():
            got.setdefault(x.query_id, []).append((x["rank"], x.word_id, x.cosine))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-300)
    for i in range(90, 190):
        want = sorted(((-round(float(c), 9), n) for c, n in zip(unit @ unit[i], names)))[:4]
        assert [(n, c) for _, n, c in sorted(got[names[i]])] == [(n, pytest.approx(-c, abs=2e-9)) for c, n in want]
    assert brought == [100 * 4 * 2]


def test_more_vectors_than_a_task_holds_make_no_row_per_word(spark, monkeypatch):
    """100,000 vectors of 64 numbers and more are held by the tasks; beyond what they hold a pair still is one row, as is a field."""
    seen = []
    known = spark.createDataFrame([(0, [0.5] * 128)], "word_id long, vector array<double>")
    monkeypatch.setattr("relevo.operators.topn.fits", lambda df, n: seen.append(n) or True)
    assert vx._held(known) and seen[0] * 128 >= 6 * 102_564 * 64
    monkeypatch.undo()
    monkeypatch.setattr(vx, "MAX_VECTORS", 1)
    monkeypatch.setattr(vx, "CHUNK_ROWS", 2)
    known = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(7)], "word_id long, vector array<double>")
    assert not vx._held(known)
    qw = spark.createDataFrame([(1, 1, [0, 1, 2]), (2, 1, [3, 3, 9]), (3, 2, []), (4, 5, [6]), (5, 1, None)], "pair_id long, product_uid long, ids array<long>")
    fw = spark.createDataFrame([(1, [0, 0, 5, 8]), (2, []), (3, None), (4, [1])], "product_uid long, ids array<long>")
    plans = [[sorted(map(str, side.collect())) for side in plan(qw.coalesce(1), fw.coalesce(1), known)] for plan in (vx._dense_sides, vx._chunked_sides)]
    assert plans[0] == plans[1] and [len(side) for side in plans[1]] == [5, 4]


def test_only_pairs_with_contexts_are_counted(spark):
    """A batch gives a row per word and context that it meets, however many other neighbours the word has."""
    import pyarrow as pa
    r = random.Random(4)
    texts = [[r.choice("abcdefghij") for _ in range(r.choice([0, 1, 2, 9, 40]))] for _ in range(25)] + [None]
    batch = pa.record_batch([pa.array(texts, pa.list_(pa.string()))], names=["w"])
    near, total = Counter(), Counter()
    for t in texts:
        for i, a in enumerate(t or []):
            for j, b in enumerate(t):
                if 0 < abs(i - j) <= 3:
                    near[a, b] += 1
                    total[a] += 1
    got = {x["word"]: x["n"] for b in vx._neighbours(3)([batch]) for x in b.to_pylist()}
    assert got == total
    for places in (500_000, 7):
        vx.MAX_PLACES, old = places, vx.MAX_PLACES
        counts = Counter()
        for b in vx._context_counts(3, type("Known", (), {"value": [("b", 0), ("z", 1), ("g", 2)]}))([batch]):
            for x in b.to_pylist():
                counts[x["word"], "bzg"[x["col"]]] += x["n"]
        vx.MAX_PLACES = old
        assert counts == Counter({k: n for k, n in near.items() if k[1] in "bg"})
