"""Pairwise features against plain-Python statements of the source functions."""

import math

from pyspark.sql import functions as F

from relevo.operators import features as ft


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def jd(a, b):
    u = a | b
    return (len(u) - len(a & b)) / len(u)


def py_feats(q, title, desc, attr, brand):
    qs, ts = q.strip().split(" "), title.strip().split(" ")
    out = {
        "cosine_search_term_Title": (len(set(q.split()) & set(title.split())) / math.sqrt(len(set(q.split())) * len(set(title.split())))
                                     if q.split() and title.split() else 0.0),
        "search_term_contains_brand": sum(1 for i in q.split(" ") for j in brand.split(" ") if i == j),
        "min_edit_title_with_search_term": min(lev(i, j) for i in q.split(" ") for j in title.split(" ")),
        "min_jcc_title_with_search_term": min(jd(set(i), set(j)) for i in qs for j in ts if set(i) | set(j)),
        "sum_edit_product_title_with_search_term": lev(q, title),
        "sum_jaccard_product_title_with_search_term": jd(set(qs), set(ts)),
    }
    m = 0.0
    for i in qs:
        if i == "":
            continue
        mn = 99999
        for j in desc.strip().split(" "):
            if j != "":
                mn = min(mn, jd(set(i), set(j)))
        m += mn
    out["mean_jcc_product_desc_with_search_term"] = m / len(qs)
    return out


ROWS = [
    (1, "angle bracket 12 in", "simpson angle bracket", "steel angle bracket for 12 in joints", "size 12", "simpson"),
    (2, "drill", "cordless drill kit", "drill drill drill", "noattribute", "NoBrand"),
    (3, "water heater 50 gal", "gas water heater", "", "gal 50", "rheem water"),
]


def test_similarity_and_mean_jaccard(spark):
    pairs = spark.createDataFrame([(r[0], r[0], r[1]) for r in ROWS], "pair_id bigint, product_uid bigint, q string")
    prods = spark.createDataFrame([(r[0], r[2], r[3], r[4], r[5]) for r in ROWS],
                                  "product_uid bigint, title string, description string, attributes string, brand string")
    j = ft.prepare_queries(pairs).join(ft.prepare_products(prods), "product_uid")
    sim = {r["pair_id"]: r.asDict() for r in ft.similarity_features(j).collect()}
    mj = {r["pair_id"]: r[1] for r in ft.mean_char_jaccard(pairs, prods, "description", "m").collect()}
    for r in ROWS:
        exp = py_feats(r[1], r[2], r[3], r[4], r[5])
        for k, v in exp.items():
            if k == "mean_jcc_product_desc_with_search_term":
                assert abs(mj[r[0]] - v) < 1e-9, (r[0], k)
            else:
                assert abs(sim[r[0]][k] - v) < 1e-9, (r[0], k, sim[r[0]][k], v)


def test_basic_counts(spark):
    pairs = spark.createDataFrame([(1, 1, "a b a 12")], "pair_id bigint, product_uid bigint, q string")
    prods = spark.createDataFrame([(1, "a c 12", "x 12 y 3", "12", "NoBrand")],
                                  "product_uid bigint, title string, description string, attributes string, brand string")
    j = ft.prepare_queries(pairs).join(ft.prepare_products(prods), "product_uid")
    r = ft.basic_features(j).collect()[0]
    assert r["numbers_in_title"] == 1 and r["numbers_in_desc"] == 1
    assert r["title_common_word_count"] == 3 * 3          # distinct unigrams 3 x 3
    assert r["title_common_word_count_bigram"] == 3 * 2   # distinct bigrams (a b),(b a),(a 12) x 2
    assert r["have_brand_or_not"] == 0 and r["last_word_in_title"] == 1


def test_mean_jaccard_keeps_a_pair_in_one_row(spark):
    pairs = spark.createDataFrame([(1, 1, "ab £c"), (2, 2, "ab"), (3, 3, ""), (4, 4, None), (5, 9, "ab  cd"), (6, 1, "ab dé")], "pair_id bigint, product_uid bigint, q string")
    prods = spark.createDataFrame([(1, "ba £d"), (2, ""), (3, "x"), (4, "x")], "product_uid bigint, description string")
    m = ft.mean_char_jaccard(pairs, prods, "description", "m")
    got = {r["pair_id"]: r["m"] for r in m.collect()}
    assert abs(got[1] - (0 + 2 / 3) / 2) < 1e-12                   # {£, c} against {£, d}
    assert got[2] == 99999 and got[3] == 0 and got[4] is None
    assert abs(got[5] - 2 * 99999 / 3) < 1e-6                       # no such product; the empty word counts
    assert abs(got[6] - (0 + 2 / 3) / 2) < 1e-12
    twice = ft.mean_char_jaccard(pairs.where("pair_id = 6").union(pairs.where("pair_id = 6")), prods.where("product_uid = 1").union(prods.where("product_uid = 1")), "description", "m")
    assert [round(r["m"], 9) for r in twice.collect()] == [round(4 / 3, 9)] * 2     # rows that come twice add up, as before
    assert "Generate" not in m._jdf.queryExecution().executedPlan().toString()   # no row per word


def test_nothing_but_the_words_is_computed_per_word(spark):
    from relevo.operators import bm25
    from relevo.plans import featurize as fz
    cols = [str(c) for c in ft.similarity_columns() if "min_" in str(c)]
    cols += [str(c) for c in fz._bm25_columns({f: bm25.Bm25Params(None, 1, 1.0) for f in fz.BM25_FIELDS})]
    assert len(cols) == 7 and not any("split(" in c or "regexp_replace(" in c or "array_distinct(" in c for c in cols)


def test_character_sets_of_texts(spark):
    rows = [(1, "  abc  cba a1 été té Ab "), (2, ""), (3, None), (4, "   "), (5, "ab"), (6, "x y x")]
    df = spark.createDataFrame(rows, "k long, t string").coalesce(1)

    def of(distinct):
        out = {}
        for r in ft.char_sets(df, "t", "s", distinct).collect():
            out[r.k] = r.s_m and [(r.s_cs[i] if m is None else "".join(c for j, c in enumerate(ft._MASKED) if m >> j & 1)) for i, m in enumerate(r.s_m)]
        return out
    every = of(False)
    assert every[1] == ["abc", "abc", "a1", "té", "té", "Ab"] and every[2] == [] and every[4] == [] and every[3] is None and every[6] == ["x", "y", "x"]
    once = of(True)
    assert sorted(once[1]) == sorted(["abc", "a1", "té", "Ab"]) and once[5] == ["ab"] and sorted(once[6]) == ["x", "y"] and once[3] is None


def test_character_sets_and_word_counts_are_not_taken_word_by_word(spark):
    pairs = spark.createDataFrame([(1, 1, "ab cd ab"), (2, 1, None), (3, 9, "ab")], "pair_id long, product_uid long, q string")
    prods = spark.createDataFrame([(1, "ab abab", "cd ce")], "product_uid long, title string, description string")
    out = ft.mean_char_jaccard(pairs, prods, "description", "m")
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.pair_id: r.m for r in out.collect() if r.pair_id != 2} == {1: 2 / 3, 3: ft.BIG}
    words = pairs.where("pair_id = 1").join(prods, "product_uid").select("pair_id", F.expr("array(struct('ab' as term), struct('x' as term))").alias("qw"), "title")
    assert [list(r.tf_title) for r in ft.with_word_counts(words, "qw", ["title"]).collect()] == [[3, 0]]
