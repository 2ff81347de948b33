"""Language ID and toxicity: brute-force phrase counts, held-out accuracy, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relevo.llm import op1_language_id as op1
from relevo.llm import op4_toxicity as op4
from tests.conftest import SF_SMALL

SYLLABLES = {"aa": "ka lo mi ru te", "bb": "scht ein ung ver hei", "cc": "ción que llo ñar ado"}


def prose(lang, r, n):
    return " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(d, t, lang, 0.5, "z") for d, t, lang in rows], "doc_id long, text string, lang string, score double, rn string")


def phrases(text, sample):
    n = at = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at = max(at + 1, end - 1)
        n += 1
    return n


def test_phrases_equal_greedy_parse():
    r = random.Random(1)
    texts = {lang: prose(lang, r, 60) for lang in SYLLABLES}
    model = op1.Identifier(texts)
    some = [prose(lang, r, 30) for lang in SYLLABLES] + ["", "a", " x", "Ka LO-MI 12 qqq ßß", "zzz"]
    code, first = op1.to_symbols(some, model.table)
    got = model.phrases(code, first)
    samples = [bytes(op1.to_symbols([texts[lang]], model.table)[0]) for lang in model.langs]
    for i in range(len(some)):
        own = bytes(code[first[i]:first[i + 1]])
        # a letter of no sample is in no substring, so it is a phrase by itself here too
        want = [phrases(own, s) for s in samples]
        assert got[i].tolist() == want, (some[i], want)


def test_long_texts_restart_at_segments():
    model = op1.Identifier({"aa": "ka lo mi", "bb": "ein ung"})
    text = "ka lo mi " * 5000
    code, first = op1.to_symbols([text], model.table)
    got = model.phrases(code, first)[0]
    s = bytes(op1.to_symbols(["ka lo mi"], model.table)[0])
    assert got[model.langs.index("aa")] == sum(phrases(bytes(code[i:i + op1.SEGMENT]), s) for i in range(0, len(code), op1.SEGMENT))
    assert model([text])[0] == ["aa"]


def test_accuracy_and_edges(spark):
    r = random.Random(2)
    rows = [(i, prose(lang, r, 40), lang) for i, lang in enumerate(list(SYLLABLES) * 40)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 % -- \n", "cc"), (903, "QUE LLO", None), (None, "ver hei ung", "cc"), (904, prose("aa", r, 40_000), None)]
    df = docs(spark, rows)
    texts = op1.sample(df)
    assert set(texts) == set(SYLLABLES) and all(len(t) < op1.SAMPLE_CHARS + op1.MAX_CHARS for t in texts.values())
    got = {x.doc_id: x for x in op1.identify(df, texts).collect()}
    assert all(got[d].lang_pred == lang for d, _, lang in rows[:120])
    assert [got[d].lang_pred for d in (900, 901, 902, 903, None, 904)] == ["und", "und", "und", "cc", "bb", "aa"]
    assert all(0 <= x.score <= 1 for x in got.values()) and got[900].score == 0


def test_training_rows_are_not_held_out(spark):
    rows = [(i, f"only{i} text", "aa") for i in range(200)]
    df = docs(spark, rows)
    held = {x.doc_id for x in df.where(op1.held_out(F.col("doc_id"))).collect()}
    words = set(" ".join(op1.sample(df).values()).split())
    assert held and not any(f"only{i}" in words for i in held) and all(f"only{i}" in words for i in range(200) if i not in held)


def test_no_labels_and_no_rows(spark):
    df = docs(spark, [(1, "text", None)])
    assert [x.lang_pred for x in op1.identify(df, op1.sample(df)).collect()] == ["und"]
    none = docs(spark, [])
    assert op1.identify(none, op1.sample(none)).collect() == []


def test_stage_keeps_columns(spark):
    r = random.Random(3)
    df = docs(spark, [(i, prose(lang, r, 30), lang) for i, lang in enumerate(list(SYLLABLES) * 10)] + [(77, "?!", "aa"), (78, prose("bb", r, 30), None)])
    out = op1.language_stage(spark, df, "")
    assert out.columns == df.columns
    got = {x.doc_id: x for x in out.collect()}
    assert 77 not in got and len(got) == 31 and got[78].lang == "bb" and got[78].score == 0.5


def test_held_out_accuracy_on_the_fixture(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = op1.op1_language_id(spark, SF_SMALL).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(x.lang == x.lang_pred for x in got) >= 0.97 * len(got)


# ------------------------------------------------------------------- toxicity


def toxic_rows(n=400, seed=4):
    r = random.Random(seed)
    vocab, bad = [f"w{i}" for i in range(500)], ["vile", "rotten", "nasty"]
    rows, labels = [], []
    for d in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        t = d % 4 == 0
        for _ in range(r.randint(1, 6) if t else 0):
            w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", "!", ","]))
        rows.append((d, " ".join(w)))
        labels.append((d, 1, int(t)))
    return rows, labels


def frames(spark, rows, labels):
    return (spark.createDataFrame([(d, t, 9, 1.0) for d, t in rows], "doc_id long, text string, toxic int, severity double"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_is_learned(spark):
    rows, labels = toxic_rows()
    train, test = labels[:300], labels[300:]
    df, lab = frames(spark, rows + [(1000, None), (1001, ""), (1002, "w1 " * 50_000 + "vile nasty rotten"), (None, "vile")], train + [(None, 1, 1), (3, None, None)])
    model = op4.fit(df, lab)
    got = {x.doc_id: x for x in op4.severity(df, model).collect()}
    assert len(got) == 404
    for d, _, t in test:
        assert got[d].toxic == bool(t)
    assert got[1002].p_toxic > 0.5 and got[1000].p_toxic < 0.5 and got[1000].severity == got[1001].severity
    assert (np.diff(model[2]) > 0).all()
    by = lambda k: op4.severity(spark.createDataFrame([(1, "w1 w2 " + "vile nasty " * k)], "doc_id long, text string"), model).first().severity
    assert by(0) < by(1) < by(4)


def test_cumulative_fit_recovers_thresholds():
    r = np.random.default_rng(0)
    n = 4000
    x = r.normal(size=n)
    y = 2.0 * x + r.logistic(size=n)
    grade = np.searchsorted([-1.0, 0.5, 2.0], y)
    w, t = op4.fit_cumulative(np.arange(n), np.zeros(n, dtype=int), x, grade, 1, 4, steps=800, ridge=0)
    assert abs(w[0] - 2) < 0.15 and np.allclose(t, [-1, 0.5, 2], atol=0.15)


@pytest.mark.parametrize("value", [0, 1])
def test_one_class_only(spark, value):
    rows, labels = toxic_rows(20)
    df, lab = frames(spark, rows, [(d, q, value) for d, q, _ in labels])
    assert op4.fit(df, lab) is None
    assert {x.severity for x in op4.severity(df, None).collect()} == {0.0}


def test_empty_tables(spark):
    df, lab = frames(spark, [], [])
    assert op4.fit(df, lab) is None and op4.severity(df, None).collect() == []
