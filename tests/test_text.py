"""Text functions against plain-Python statements of the source semantics (hand cases)."""

import re

import regex
from pyspark.sql import functions as F

from relevo.functions import text as tx
from relevo.functions.stopwords import ENGLISH_STOP_WORDS

CASES = ["2x4 in. board 10 ft ft 5lbs", "cabin. 3GALLON gal oz a_b ½in x²", "", "   leading  and   repeated blanks ",
         "Café déjà-vu 12in x 3 ft", "5 sq ft", "5 inserts", "0 . 5", "120 v pump", "anglesMake jointsStronger, USA madeIn2015",
         "lawn mowe in 3 gal", "ÉLAN_über"]


def py_units(text):
    text = " " + text + " "
    for pat, rep in tx.UNIT_RULES:
        text = re.sub(pat, rep, text)
    return text


def py_clean(sent, search=False):
    sent = sent.replace("in.", " inch ")
    words = [w.lower() for w in regex.split(r"\W+", sent)]
    res = re.sub("[A-Za-z]+", lambda m: " " + m[0] + " ", " ".join(words))
    res = py_units(res)
    if search:
        res = res.replace(" in ", " inch ")
    return " ".join(res.split())


def py_measures(s):
    for kind, pat, rep in tx.MEASURE_RULES:
        if kind == "lit":
            s = s.replace(pat, rep)
        else:
            s = re.sub(pat, rep.replace("$", "\\"), s)
    return s


def run(spark, col):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_clean_text(spark):
    assert run(spark, tx.clean_text("t")) == [py_clean(c) for c in CASES]


def test_clean_search(spark):
    assert run(spark, tx.clean_search("t")) == [py_clean(c, True) for c in CASES]


def test_strip_stopwords(spark):
    def py(s):
        return " ".join(w for w in s.replace("_", " _ ").split() if w not in set(ENGLISH_STOP_WORDS))
    assert run(spark, tx.strip_stopwords(tx.clean_text("t"))) == [py(py_clean(c)) for c in CASES]


def test_notebook_cleaning(spark):
    def py(s):
        return py_measures(re.sub("[^A-Za-z0-9]+", " ", s).lower())
    assert run(spark, tx.standardize_measures(tx.remove_special_char("t"))) == [py(c) for c in CASES]


def test_glued_words(spark):
    def py(s):
        return " ".join(re.findall(r"[A-Z]?[^A-Z\s]+|[A-Z]+", s))
    assert run(spark, tx.split_glued_words("t")) == [py(c) for c in CASES]


def test_first_n_words(spark):
    def py(s, n):
        return "error101" if n > len(s.split()) else " ".join(s.split()[:n])
    for n in (1, 2, 4):
        assert run(spark, tx.first_n_words("t", n)) == [py(c, n) for c in CASES]


def test_substring_count(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("the other them", "the"), ("abc", ""), ("", "x")], "d string, w string")
    got = [r[0] for r in df.select(tx.substring_count("d", "w")).collect()]
    assert got == [2, 3, 4, 0]


def test_bigrams_and_digits(spark):
    df = spark.createDataFrame([("12 a 12 b 7x 3",), ("",), ("a",)], "t string")
    r = df.select(F.array_sort(F.array_distinct(tx.digit_tokens("t"))).alias("d"),
                  F.size(F.array_distinct(tx.bigrams(tx.split_blank("t")))).alias("n2")).collect()
    assert r[0]["d"] == ["12", "3"] and r[0]["n2"] == 5
    assert r[1]["d"] == [] and r[1]["n2"] == 0
    assert r[2]["n2"] == 0


def test_cleaning_tests_ascii_before_unicode(spark):
    texts = ["aÄ_1 ٣x--ñ‿b\u200dc", " gal gals  galon lb. 3 ft fts", "in. sq", "", None, "日本 ①", "a gal gal gal b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(F.regexp_replace("t", tx.NON_WORD, " ").alias("a"), F.regexp_replace("t", r"(?U)\W+", " ").alias("b")).collect():
        assert r["a"] == r["b"]
    old = F.concat(F.lit(" "), F.col("t"), F.lit(" "))
    for pat, rep in tx.UNIT_RULES:
        old = F.regexp_replace(old, pat, rep)
    for r in df.select(tx.standardize_units("t").alias("a"), old.alias("b")).collect():
        assert r["a"] == r["b"]
    assert "a-zA-Z0-9" in tx.NON_WORD
