"""Assembly hand cases (FIXTURES §3): brand imputation, relevance buckets, ordered concatenation."""

from pyspark.sql import functions as F

from relevo.operators import assemble as asm


def py_impute(title, brand, known):
    if brand is not None:
        return brand
    words = title.split()

    def first_n(n):
        return "error101" if n > len(words) else " ".join(words[:n])
    for n in (4, 3, 2):
        if first_n(n) in known:
            return first_n(n)
    return first_n(1)


def test_brand_imputation(spark):
    rows = [(1, "Acme Tools cordless drill", "Acme Tools"), (2, "Acme Tools hammer set", None),
            (3, "Big Red Box Co crate", "Big Red Box Co"), (4, "Big Red Box Co bin", None),
            (5, "tiny", None), (6, "", None), (7, "Unknown maker widget x", None), (8, "Acme", None)]
    df = spark.createDataFrame(rows, "product_uid long, product_title string, brand string")
    known = {b for _, _, b in rows if b is not None}
    got = {r["product_uid"]: r["brand"] for r in asm.impute_brand(df).collect()}
    assert got == {u: py_impute(t, b, known) for u, t, b in rows}


def test_relevance_class_ties(spark):
    valid = [3.00, 2.33, 2.67, 2.00, 1.67, 1.33, 1.00]
    scores = [1.0, 2.5, 2.165, 1.835, 2.999, 0.2, 3.9, 1.5]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = [r[0] for r in df.select(asm.relevance_class(F.col("s"))).collect()]
    assert got == [min(valid, key=lambda v: abs(v - s)) for s in scores]


def test_ordered_concat_independent_of_partitions(spark):
    rows = [(1, p, f"n{p}", f"v{p}") for p in range(40)] + [(2, 2, "b", None), (2, 1, "a", "x")]
    df = spark.createDataFrame(rows, "product_uid long, pos int, name string, value string")
    expect = {1: " ".join(f"n{p} v{p}" for p in range(40)), 2: "a x b "}
    for parts in (1, 7):
        got = {r[0]: r[1] for r in asm.attribute_text(df.repartition(parts), fill_null=True).collect()}
        assert got == expect
