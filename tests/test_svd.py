"""Truncated SVD and latent cosine against numpy on a small matrix."""

import random

import numpy as np

from relevo.operators import svd, tfidf


def test_svd_matches_numpy(spark):
    r = random.Random(3)
    vocab_words = [f"term{j}" for j in range(12)]
    texts = [" ".join(r.choice(vocab_words) for _ in range(r.randint(3, 15))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    vocab = tfidf.fit_vocab(docs, "text", min_df=1)
    idf = {x["term"]: x["idf"] for x in vocab.idf.collect()}
    terms = sorted(idf)
    X = np.array([[t.split().count(w) * idf[w] for w in terms] for t in texts])
    X = X / np.linalg.norm(X, axis=1, keepdims=True)
    basis = tfidf.fit_svd(docs, "doc", "text", vocab, k=3)
    assert np.allclose(basis.s, np.linalg.svd(X, compute_uv=False)[:3], rtol=1e-9)
    x = tfidf.project(docs, "doc", "text", vocab, basis)
    # cosine in the latent basis is invariant to component sign flips: compare with numpy's projection
    _, _, vt = np.linalg.svd(X)
    P = X @ vt[:3].T
    pairs = spark.createDataFrame([(0, 1), (2, 3), (4, 99)], "doc long, other long")
    cos = {r["doc"]: r["c"] for r in tfidf.latent_cosine(pairs, x, x.withColumnRenamed("doc", "other"), "doc", "other", "c").collect()}
    unit = P / np.linalg.norm(P, axis=1, keepdims=True)
    assert abs(cos[0] - unit[0] @ unit[1]) < 1e-9 and abs(cos[2] - unit[2] @ unit[3]) < 1e-9 and cos[4] == 0
    rows = tfidf.sparse_rows(docs, "doc", "text", vocab)
    ratio = svd.explained_variance_ratio(rows, svd.project(rows, "doc", basis), len(texts))
    assert abs(ratio - P.var(axis=0).sum() / X.var(axis=0).sum()) < 1e-9


def sparse(spark, X):
    rows = [(i, [int(j) for j in np.flatnonzero(x)], [float(v) for v in x[np.flatnonzero(x)]]) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "k long, cols array<int>, vals array<double>")


def test_many_partitions_and_low_rank(spark, monkeypatch):
    """Pieces are combined in a tree; a rank below the wanted one gives fewer components."""
    monkeypatch.setattr(svd, "FAN", 2)
    monkeypatch.setattr(svd, "SLICE", 7)
    monkeypatch.setattr(svd, "BLOCK_ROWS", 5)
    r = np.random.default_rng(1)
    X = (r.random((90, 25)) < .2) * r.random((90, 25))
    got = svd.fit(sparse(spark, X).repartition(9), 25, 6)
    _, s, vt = np.linalg.svd(X)
    assert np.allclose(got.s, s[:6], rtol=1e-6) and np.allclose(np.abs(np.sum(got.v * vt[:6].T, axis=0)), 1, atol=1e-4)
    low = np.outer(r.random(40), r.random(25)) + np.outer(r.random(40), r.random(25))
    got = svd.fit(sparse(spark, low).repartition(3), 25, 6)
    assert len(got.s) == 2 and np.allclose(got.s, np.linalg.svd(low, compute_uv=False)[:2])
    assert svd.fit(sparse(spark, low).limit(0), 25, 3).s.shape == (0,)


def test_passes_run_in_no_more_tasks_than_cores(spark, monkeypatch):
    """Every task of a pass sends a matrix of columns x components, so their number must not grow with the rows."""
    from relevo.operators import svd as sv
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 8))
    rows = spark.createDataFrame([(i, list(range(8)), [float(v) for v in x[i]]) for i in range(60)], "doc long, cols array<int>, vals array<double>").repartition(9)
    seen, real = [], sv._pass
    monkeypatch.setattr(sv, "_pass", lambda rows, *a, **k: (seen.append(rows.rdd.getNumPartitions()), real(rows, *a, **k))[1])
    got = sv.fit(rows, 8, 3)
    assert max(seen) <= spark.sparkContext.defaultParallelism
    assert np.allclose(got.s, np.linalg.svd(x)[1][:3])
