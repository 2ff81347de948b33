"""Spelling correction and BM25 against brute-force Python statements."""

import math
from collections import Counter

from pyspark.sql import functions as F

from relevo.operators import bm25, spell
from relevo.operators.topn import top_n_per_group

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def edits1(word):
    splits = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return set([L + R[1:] for L, R in splits if R] + [L + R[1] + R[0] + R[2:] for L, R in splits if len(R) > 1]
               + [L + c + R[1:] for L, R in splits if R for c in LETTERS] + [L + c + R for L, R in splits for c in LETTERS])


def py_correct(word, words):
    known = lambda ws: {w for w in ws if w in words}
    c = known([word]) or known(edits1(word)) or known(e2 for e1 in edits1(word) for e2 in edits1(e1)) or {word}
    return sorted(c, key=lambda w: (-words.get(w, 0), w))[0]


def test_spelling(spark):
    words = Counter("toilet toilet mower heater water air conditioner lawn toiled2 hammer ham".split())
    vocab = spark.createDataFrame(list(words.items()), "word string, cnt long")
    typos = ["toiled", "mowe", "heatwr", "conditionar", "water", "hamer", "zzzzzz", "conditonr", "xam"]
    got = {r["word"]: r["corrected"] for r in spell.correct_words(
        spark.createDataFrame([(t,) for t in typos], "word string"), vocab).collect()}
    assert got == {t: py_correct(t, words) for t in typos}


def test_edit_tests_against_enumeration(spark):
    """All pairs of short strings, with a character that is no letter: the tests equal enumerated neighbourhoods."""
    from itertools import product
    short = ["".join(t) for n in range(5) for t in product("ab1", repeat=n)]
    extra = ["".join(t) for t in product("abc1", repeat=3)] + ["abcd12", "ab12cd", "12abcd", "a1b2c3", "abdc12", "xbcd12", "2abcd1", "bacd21", "abc12", "abcde12"]
    words = sorted(set(short + extra))
    near = {w: edits1(w) for w in words}
    far = {w: set().union(*map(edits1, near[w])) for w in words}
    pairs = [(w, c) for w in words for c in words if abs(len(w) - len(c)) <= 2]
    df = spark.createDataFrame(pairs, "w string, c string").select("w", "c", spell.is_edit1(F.col("w"), F.col("c")).alias("one"), spell.is_edit2(F.col("w"), F.col("c")).alias("two"))
    for r in df.collect():
        one = r.c in near[r.w]
        assert r.one == (one and r.c != r.w), r
        if not one and r.c != r.w:
            assert r.two == (r.c in far[r.w]), r


def test_spelling_of_many_words(spark, monkeypatch):
    import random
    r = random.Random(3)
    letters = "abcde1"
    vocab = Counter("".join(r.choice(letters) for _ in range(r.choice([1, 2, 3, 5, 8, 13, 20]))) for _ in range(150))
    for w in list(vocab)[:40]:
        vocab[w] += r.randrange(3)

    def typo(w):
        for _ in range(r.choice([1, 2, 2, 3])):
            w = r.choice(sorted(edits1(w)))
        return w
    words = sorted({typo(w) for w in vocab for _ in range(3)} | set(list(vocab)[:10]) | {"", "zzzzzzzzzz"})
    table = spark.createDataFrame(list(vocab.items()), "word string, cnt long")
    asked = spark.createDataFrame([(w,) for w in words] + [(None,)], "word string")
    want = {w: py_correct(w, vocab) for w in words}
    assert {x["word"]: x["corrected"] for x in spell.correct_words(asked, table).collect()} == want
    monkeypatch.setattr(spell, "PREFIX", 5)
    index = spell.open_index(spark, spell.build_index(table).path)
    monkeypatch.setattr(spell, "BROADCAST_KEYS", 0)
    assert {x["word"]: x["corrected"] for x in spell.correct_words(asked, index).collect()} == want


def py_bm25_scores(corpus, query, k1=1.5, b=0.75, eps=0.25):
    docs = [d.split(" ") for d in corpus]
    n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
    nd = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in nd.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (eps * mean if v < 0 else v) for w, v in idf.items()}
    out = []
    for d in docs:
        c = Counter(d)
        out.append(sum(idf.get(q, 0) * c[q] * (k1 + 1) / (c[q] + k1 * (1 - b + b * len(d) / avgdl)) for q in query.split(" ")))
    return out


def test_bm25_okapi(spark):
    corpus = ["the red drill", "red red hammer", "a drill bit set", "the saw", "drill"]
    docs = spark.createDataFrame(list(enumerate(corpus)), "product_uid long, text string")
    idx = bm25.build_okapi(docs)
    q = spark.createDataFrame([(1, "red drill drill"), (2, "saw missing")], "query_id long, text string")
    got = {(r["query_id"], r["product_uid"]): r["score"] for r in bm25.score(idx, q).collect()}
    for qid, text in [(1, "red drill drill"), (2, "saw missing")]:
        exp = py_bm25_scores(corpus, text)
        for uid, s in enumerate(exp):
            if s != 0:
                assert abs(got[(qid, uid)] - s) < 1e-9


def zipf_corpus(seed, n_docs=400, vocab=300):
    import random
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)]
    weight = [1 / (i + 1) for i in range(vocab)]
    return [" ".join(r.choices(words, weight, k=r.choice([3, 8, 30, 120]))) for _ in range(n_docs)]


def test_pruned_top_n_equals_full_scoring(spark, monkeypatch):
    corpus = zipf_corpus(1)
    corpus += corpus[:40]  # ties
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(corpus)], "product_uid long, text string").repartition(3)
    queries = [" ".join(c.split()[:k]) for c, k in zip(corpus[::37], [1, 2, 5, 12, 40, 100, 3, 7, 9, 20, 30, 60])] + ["w0 w0 w1", "nothing here", "w299 w298", ""]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    for n, block, asked in [(1, 4096, 512), (10, 64, 3), (500, 16, 512)]:
        monkeypatch.setattr(bm25, "BLOCK_DOCS", block)
        monkeypatch.setattr(bm25, "QUERY_BLOCK", asked)
        idx = bm25.build_okapi(docs)
        got = sorted((r.query_id, r["rank"], r.product_uid, r.score) for r in bm25.top_n(idx, q, n=n).collect())
        want = []
        for qid, text in enumerate(queries):
            scores = py_bm25_scores(corpus, text)
            hits = sorted((-round(x, 6), i * 3) for i, x in enumerate(scores) if x > 0)[:n]
            want += [(qid, k + 1, uid, -x) for k, (x, uid) in enumerate(hits)]
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(abs(g[3] - w[3]) < 1e-5 for g, w in zip(got, want))


def test_frequent_words_are_not_scored_everywhere(spark):
    idx = bm25.build_okapi(spark.createDataFrame([(i, t) for i, t in enumerate(zipf_corpus(3, 2000))], "product_uid long, text string").coalesce(1))
    q = spark.createDataFrame([(1, "w0 w1 w2 w3 w4 w150 w200 w250"), (2, "w0 w1 w100 w299")], "query_id long, text string")
    for r in bm25.top_n(idx, q, n=5, count=True).collect():
        assert 0 < r.read < r.held / 2


def test_negative_weights_are_scored_everywhere(spark):
    # every word is in more than half of the documents, so the mean idf and all weights are negative
    corpus = ["a b c", "a b c d", "a b d c", "b a c d", "a c d", "b c d a a"]
    idx = bm25.build_okapi(spark.createDataFrame(list(enumerate(corpus)), "product_uid long, text string"))
    assert not idx.idf.where("idf < 0").isEmpty()
    got = [(r["rank"], r.product_uid, r.score) for r in bm25.top_n(idx, spark.createDataFrame([(1, "a b d")], "query_id long, text string"), n=4).orderBy("rank").collect()]
    want = sorted((-round(x, 6), i) for i, x in enumerate(py_bm25_scores(corpus, "a b d")))[:4]
    assert [(k + 1, i, -x) for k, (x, i) in enumerate(want)] == got


def test_best_of_block_against_whole_sums():
    import numpy as np
    r = np.random.default_rng(5)
    for case in range(200):
        size, words, n = 64, int(r.integers(1, 9)), int(r.integers(1, 12))
        slots = [np.flatnonzero(r.random(size) < p) for p in r.random(words)]
        slots = [s if len(s) else np.array([3]) for s in slots]
        parts = [np.round(r.random(len(s)), 1) for s in slots]
        w = np.round(r.random(words) * 3, 1) + (-1.0 if case % 10 == 0 else 0.1)
        whole, has = np.zeros(size), np.zeros(size, dtype=bool)
        for s, p, x in zip(slots, parts, w):
            whole[s] += x * p
            has[s] = True
        found, score, read = bm25.best_of_block(w, w * np.array([p.max() for p in parts]), slots, lambda t, at: parts[t] if at is None else parts[t][at], size, n)
        assert read <= sum(map(len, slots)) and np.allclose(score, whole[found])
        order = sorted(np.flatnonzero(has), key=lambda i: (-round(whole[i], 6), i))[:n]
        mine = sorted(found, key=lambda i: (-round(whole[i], 6), i))[:n]
        assert order == mine


def test_blocks_bound_their_postings(spark):
    docs = spark.createDataFrame(list(enumerate(zipf_corpus(2, 100))), "product_uid long, text string")
    idx = bm25.build_okapi(docs)
    rows = idx.postings.collect()
    assert sum(r.n for r in rows) == sum(len(set(t.split(" "))) for t in zipf_corpus(2, 100))
    for r in rows:
        assert r.n == len(r.docs) <= bm25.BLOCK_DOCS and [d.slot for d in r.docs] == sorted({d.slot for d in r.docs})
        assert r.max_tf == max(d.tf for d in r.docs) and r.min_dl == min(d.dl for d in r.docs)


def test_salted_topn_equals_plain(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"),
                                     ((F.col("id") * 7919) % 1000).alias("v"))
    a = top_n_per_group(df, "g", [F.desc("v"), F.asc("k")], 7, salt_cols=["k"], salt=16)
    b = top_n_per_group(df, "g", [F.desc("v"), F.asc("k")], 7, salt=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_nearest_buckets_match_single_broadcast(spark):
    from relevo.operators import vectors as vx
    vecs = spark.range(0, 300).select(F.col("id").alias("word_id"),
                                      F.array(F.sin(F.col("id")), F.cos(F.col("id") * 3), F.lit(0.5)).alias("vector"))
    qs = vecs.where("word_id < 25").select(F.col("word_id").alias("query_id"), F.col("vector").alias("qvec"))
    one = vx.nearest(qs, vecs, 5, max_broadcast=1000)
    many = vx.nearest(qs, vecs, 5, max_broadcast=4)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_zero_score_padding(spark):
    corpus = ["red drill", "blue saw", "red hammer", "green", "drill bit", "tape", "glue", "nails"]
    docs = spark.createDataFrame([(i * 10, t) for i, t in enumerate(corpus)], "product_uid long, text string")
    idx = bm25.build_okapi(docs)
    q = spark.createDataFrame([(1, "red"), (2, "zzz"), (3, "drill red saw")], "query_id long, text string")
    n = 4
    top = bm25.top_n(idx, q, n=n)
    got = bm25.pad_zero_scores(top, q, docs.select("product_uid"), n)
    res = {}
    for r in got.collect():
        res.setdefault(r["query_id"], []).append((r["rank"], r["product_uid"]))
    ids = sorted(i * 10 for i in range(len(corpus)))
    for qid, text in [(1, "red"), (2, "zzz"), (3, "drill red saw")]:
        scores = dict(zip(ids, py_bm25_scores(corpus, text)))
        hits = sorted((u for u, s in scores.items() if s > 0), key=lambda u: (-round(scores[u], 6), u))[:n]
        pad = [u for u in ids if u not in hits][: n - len(hits)]
        assert [u for _, u in sorted(res[qid])] == hits + pad


def test_nearest_holds_few_cosines_at_a_time(spark):
    from relevo.operators import vectors as vx
    vecs = spark.range(0, 300).select(F.concat(F.lit("w"), F.col("id")).alias("word_id"), F.array(F.col("id") % 5 + 1.0, F.col("id") % 3 + 1.0).alias("vector"))  # many ties
    qs = vecs.where("word_id < 'w2'").select(F.col("word_id").alias("query_id"), F.col("vector").alias("qvec"))
    import numpy as np
    rows = [(r[0], np.array(r[1]) / np.linalg.norm(r[1])) for r in vecs.collect()]
    expected = set()
    for q, u in [r for r in rows if r[0] < "w2"]:
        best = sorted((-round(float(u @ v), 9), w) for w, v in rows)[:7]
        expected |= {(q, w, i) for i, (_, w) in enumerate(best, 1)}
    for cells in (1, 500, 10_000_000):
        got = vx.nearest(qs, vecs, 7, cells=cells).select("query_id", "word_id", "rank").collect()
        assert set(map(tuple, got)) == expected and len(got) == len(expected)


def test_padding_reads_the_search_once(spark):
    top = spark.createDataFrame([(1, 7, 2.0, 1)], "query_id long, product_uid long, score double, rank int").where(F.expr("product_uid > 0"))
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, text string")
    out = bm25.pad_zero_scores(top, q, spark.createDataFrame([(i,) for i in range(9)], "product_uid long"), 2)
    assert sorted(map(tuple, out.select("query_id", "product_uid", "rank").collect())) == [(1, 0, 2), (1, 7, 1), (2, 0, 1), (2, 1, 2)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("product_uid#") and "padded-top" in "".join(out.inputFiles())


def test_postings_move_once_as_block_rows(spark, monkeypatch):
    corpus = zipf_corpus(6, 200) + ["", "  a  a "]
    docs = spark.createDataFrame(list(enumerate(corpus)) + [(900, None), (None, "a b a")], "product_uid long, text string").repartition(2)
    monkeypatch.setattr(bm25, "BLOCK_DOCS", 64)
    for words in (2_000_000, 300):
        monkeypatch.setattr(bm25, "BLOCK_WORDS", words)
        rows = bm25.posting_rows(docs, "product_uid", "text", 4, 1)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 2 and "Aggregate" not in plan  # one of them is the repartition above
        got = rows.collect()
        want = {(i, w): t.split(" ").count(w) for i, t in [*enumerate(corpus), (None, "a b a")] for w in t.split(" ")} | {(900, None): 1}
        assert {(d.product_uid, r.term): d.tf for r in got for d in r.docs} == want and sum(r.n for r in got) == len(want)
        size = {}
        for r in got:
            known = [d.dl for d in r.docs if d.dl is not None]
            assert len(r.docs) == r.n <= 64 and r.max_tf == max(d.tf for d in r.docs) and r.min_dl == (min(known) if known else None)
            for d in r.docs:
                size.setdefault(r.block, {})[d.slot] = d.dl or 0
        assert all(sum(x.values()) < words + max(x.values()) for x in size.values())
