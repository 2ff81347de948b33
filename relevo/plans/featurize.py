"""Feature table for model training and scoring (notebook cleaning, 39 + 2 features).

Inputs are the assembled pairs and products, cleaned with the notebook rules
(ASCII, measurement units). Text is cleaned once per distinct product; the
product side is restricted to products that occur in a pair (semi join).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.functions import text as tx
from relevo.operators import assemble as asm
from relevo.operators import bm25
from relevo.operators import features as ft
from relevo.operators import svd, tfidf
from relevo.operators.topn import fits
from relevo.sources import fixtures as fx
from relevo.session import materialize


def _nb(c):
    return tx.standardize_measures(tx.remove_special_char(c))


def notebook_inputs(spark: SparkSession, sf_dir: str, persist: bool = True):
    """(pairs(pair_id, product_uid, q, relevance, is_train), products(product_uid, title, description, attributes, brand)).

    Both are written once to the checkpoint folder: every feature group reads the
    cleaned text instead of re-running the cleaning rules.
    """
    p = fx.pairs(spark, sf_dir)
    pairs = p.select(F.col("id").alias("pair_id"), "product_uid", _nb("search_term").alias("q"),
                     "relevance", "is_train")
    a = fx.attributes(spark, sf_dir).na.drop("any", subset=["product_uid", "name", "value"])
    summ = asm.attribute_text(a, fill_null=False).withColumnRenamed("combined_attr", "attribute_summary")
    br = asm.brand_rows(a)
    prods = (fx.products(spark, sf_dir).join(p.select("product_uid"), "product_uid", "left_semi")
             .join(summ, "product_uid", "left").join(br, "product_uid", "left")
             .na.fill({"attribute_summary": "NoAttribute", "brand": "NoBrand"}))
    products = prods.select("product_uid", _nb("product_title").alias("title"),
                            _nb("product_description").alias("description"),
                            _nb("attribute_summary").alias("attributes"), "brand")
    if persist:
        pairs, products = materialize(pairs, "nb-pairs"), materialize(products, "nb-products")
    return pairs, products


def joined(pairs: DataFrame, products: DataFrame) -> DataFrame:
    return ft.prepare_queries(pairs).join(ft.prepare_products(products), "product_uid")


def _bm25_params(pairs: DataFrame, products: DataFrame) -> dict:
    """R1 for every field, on the training rows: a product's text counts once per training pair, and is tokenized once."""
    n = pairs.where("is_train").groupBy("product_uid").agg(F.count(F.lit(1)).alias("n_pairs"))
    return bm25.fit_params_many(products.join(n, "product_uid"), BM25_FIELDS, weight="n_pairs")


def bm25_features(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """Per-field parameters fitted on the training rows (one document per train pair); one join with the products."""
    params = _bm25_params(pairs, products)
    side = products.select("product_uid", *BM25_FIELDS, *[F.size(tx.split_ws(f)).alias(f"{f}_len") for f in BM25_FIELDS])
    j = _with_word_idf(pairs, {f: (p.idf, p.n_docs) for f, p in params.items()}).join(side, "product_uid")
    j = ft.with_word_counts(j.select("pair_id", "qw", *BM25_FIELDS, *[f"{f}_len" for f in BM25_FIELDS]), "qw", list(BM25_FIELDS))
    return j.select("pair_id", *_bm25_columns(params))


def _bm25_columns(params: dict) -> list:
    idf = lambda f: F.transform("qw", lambda x: F.struct(x["term"].alias("term"), x[f"idf_{f}"].alias("idf")))
    return [bm25.bm25_expr(idf(f), f, f"{f}_len", params[f].avgdl, tf=F.col(f"tf_{f}")).alias(name) for f, name in BM25_FIELDS.items()]


#: Fields of a product and their BM25 features.
BM25_FIELDS = {"title": "bm25_ST", "description": "bm25_SD", "brand": "bm25_SB"}


def title_desc(products: DataFrame) -> DataFrame:
    """(product_uid, td): title + '. ' + description."""
    return products.select("product_uid", F.concat("title", F.lit(". "), "description").alias("td"))


def title_desc_vocab(pairs: DataFrame, products: DataFrame) -> tfidf.TfidfVocab:
    """V1 fitted on the distinct ``title + '. ' + description`` texts of all pairs' products."""
    used = products.join(pairs.select("product_uid"), "product_uid", "left_semi")
    return tfidf.fit_vocab(title_desc(used), "td")


def pair_cosine(pairs: DataFrame, texts: DataFrame, text: str, vocab: tfidf.TfidfVocab, q: DataFrame, name: str) -> DataFrame:
    """(pair_id, name): V5 of the weights ``q`` of searches (pair_id, product_uid, term, weight) and of a text of their products (0: absent).

    Texts are weighted once per product; both sides meet in one equi-join on (product_uid, term)."""
    pw = tfidf.weights(texts, "product_uid", text, vocab).withColumnRenamed("weight", "pw")
    cos = q.join(pw, ["product_uid", "term"]).groupBy("pair_id").agg(F.sum(F.col("weight") * F.col("pw")).alias(name))
    return pairs.select("pair_id").join(cos, "pair_id", "left").na.fill(0.0, subset=[name])


def search_weights(pairs: DataFrame, vocab: tfidf.TfidfVocab) -> DataFrame:
    return tfidf.weights(pairs, "pair_id", "q", vocab).join(pairs.select("pair_id", "product_uid"), "pair_id")


def tfidf_features(pairs: DataFrame, products: DataFrame, vocab: tfidf.TfidfVocab | None = None) -> DataFrame:
    """F33-F41 against the title, idf from the V1 vocabulary (``ln(N+1)`` when missing)."""
    vocab = vocab or title_desc_vocab(pairs, products)
    qw = bm25.query_word_idf(pairs, "pair_id", "q", vocab.idf, vocab.n_docs)
    j = pairs.join(products.select("product_uid", "title"), "product_uid")
    return ft.tf_idf_stats(j, qw, "title")


def latent_cosine_features(pairs: DataFrame, products: DataFrame, vocab: tfidf.TfidfVocab) -> DataFrame:
    """F28/F29 in the TF-IDF space of the shared vocabulary: search vs title+description and
    search vs description (cosine of L2-normalised TF-IDF rows)."""
    used = products.join(pairs.select("product_uid"), "product_uid", "left_semi")
    q = search_weights(pairs, vocab)
    c1 = pair_cosine(pairs, title_desc(used), "td", vocab, q, "cosine_similarity_tfidf_search_title_des")
    c2 = pair_cosine(pairs, used, "description", vocab, q, "cosine_similarity_tfidf_search_des")
    return c1.join(c2, "pair_id")


def latent_features(pairs: DataFrame, products: DataFrame, vocab: tfidf.TfidfVocab, basis) -> DataFrame:
    """F28/F29 and F42 as cosines in a latent basis: search vs title+description, description and title."""
    used = products.join(pairs.select("product_uid"), "product_uid", "left_semi")
    a = tfidf.project(pairs, "pair_id", "q", vocab, basis)
    out = pairs.select("pair_id")
    for texts, text, name in ((title_desc(used), "td", "cosine_similarity_tfidf_search_title_des"), (used, "description", "cosine_similarity_tfidf_search_des"),
                              (used, "title", "cosine_similarity_tfidf_search_title")):
        b = tfidf.project(texts.select("product_uid", text), "product_uid", text, vocab, basis)
        out = out.join(tfidf.latent_cosine(pairs, a, b, "pair_id", "product_uid", name), "pair_id")
    return out


def notebook_products(spark: SparkSession, sf_dir: str, restrict_to: DataFrame | None = None) -> DataFrame:
    """Cleaned products (notebook rules), optionally only those whose uid occurs in ``restrict_to``."""
    a = fx.attributes(spark, sf_dir).na.drop("any", subset=["product_uid", "name", "value"])
    summ = asm.attribute_text(a, fill_null=False).withColumnRenamed("combined_attr", "attribute_summary")
    br = asm.brand_rows(a)
    p = fx.products(spark, sf_dir)
    if restrict_to is not None:
        p = p.join(restrict_to.select("product_uid"), "product_uid", "left_semi")
    p = (p.join(summ, "product_uid", "left").join(br, "product_uid", "left")
          .na.fill({"attribute_summary": "NoAttribute", "brand": "NoBrand"}))
    return p.select("product_uid", _nb("product_title").alias("title"), _nb("product_description").alias("description"),
                    _nb("attribute_summary").alias("attributes"), "brand")


class FeatureParams:
    """Everything fitted on training data that the features need: BM25 parameters per field
    (R1, fitted on training rows), the TF-IDF vocabulary (V1) and, if wanted, a latent basis (V3)."""

    def __init__(self, bm25_params: dict, vocab: tfidf.TfidfVocab, basis=None):
        self.bm25_params = bm25_params
        self.vocab = vocab
        self.basis = basis


def save_feature_params(spark: SparkSession, fp: FeatureParams, path: str) -> None:
    """Idf tables, vocabulary, scalars and the latent basis under ``path``."""
    tables = {**{f"bm25-{f}": (p.idf, p.n_docs, p.avgdl) for f, p in fp.bm25_params.items()}, "vocab": (fp.vocab.idf, fp.vocab.n_docs, 0.0)}
    for name, (idf, _, _) in tables.items():
        idf.write.mode("overwrite").parquet(f"{path}/{name}")
    if fp.basis is not None:
        rows = [(i, [float(x) for x in v]) for i, v in enumerate(fp.basis.v)]  # one per word of the vocabulary
        spark.createDataFrame(rows, "col int, v array<double>").write.mode("overwrite").parquet(f"{path}/basis")
        spark.createDataFrame([([float(x) for x in fp.basis.s],)], "s array<double>").write.mode("overwrite").parquet(f"{path}/basis-values")
    # written last: a folder without it holds no whole set of parameters
    meta = [(name, int(n), float(avgdl), fp.basis is not None) for name, (_, n, avgdl) in tables.items()]
    spark.createDataFrame(meta, "name string, n_docs long, avgdl double, latent boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_feature_params(spark: SparkSession, path: str) -> FeatureParams:
    """Parameters written by ``save_feature_params``."""
    import numpy as np

    meta = {r["name"]: r for r in spark.read.parquet(f"{path}/meta").collect()}
    idf = {name: spark.read.parquet(f"{path}/{name}") for name in meta}
    params = {n.removeprefix("bm25-"): bm25.Bm25Params(idf[n], r["n_docs"], r["avgdl"]) for n, r in meta.items() if n != "vocab"}
    basis = None
    if meta["vocab"]["latent"]:
        v = spark.read.parquet(f"{path}/basis").orderBy("col").collect()
        basis = svd.Svd(np.array([r["v"] for r in v]), np.array(spark.read.parquet(f"{path}/basis-values").first()["s"]))
    return FeatureParams(params, tfidf.TfidfVocab(idf["vocab"], meta["vocab"]["n_docs"]), basis)


def fit_feature_params(pairs: DataFrame, products: DataFrame, latent: int | None = None) -> FeatureParams:
    """``latent``: components of a basis in which F28 and F29 are taken; None: in the TF-IDF space itself."""
    vocab = title_desc_vocab(pairs, products)
    basis = latent_basis(products, vocab, latent)[0] if latent else None
    return FeatureParams(_bm25_params(pairs, products), vocab, basis)


def _with_word_idf(pairs: DataFrame, tables: dict) -> DataFrame:
    """``pairs`` with ``qw``, the search words and their idf in each of ``tables`` (name: (idf, n_docs)).

    The words are exploded once and met by all idf tables; only the short pair side takes part."""
    words = pairs.select("pair_id", F.posexplode(tx.split_ws("q")).alias("pos", "term"))
    for f, (idf, n) in tables.items():
        side = idf.select("term", F.col("idf").alias(f"idf_{f}"))
        words = (words.join(F.broadcast(side) if fits(idf, 2_000_000) else side.hint("merge"), "term", "left")
                 .withColumn(f"idf_{f}", F.coalesce(f"idf_{f}", F.lit(math.log(n + 1)))))
    qw = words.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term", *[f"idf_{f}" for f in tables]))).alias("qw"))
    empty = F.array().cast("array<struct<pos:int,term:string," + ",".join(f"idf_{f}:double" for f in tables) + ">>")
    return pairs.join(qw, "pair_id", "left").withColumn("qw", F.coalesce("qw", empty))


def compute_features(pairs: DataFrame, prods: DataFrame, fp: FeatureParams, keep=("relevance", "is_train")) -> DataFrame:
    """All 41 features for ``pairs(pair_id, product_uid, q, ...)`` with fitted parameters ``fp``.

    One join on ``product_uid`` and one select give all but the mean-Jaccard and latent columns; a product's texts
    are never shuffled by pair."""
    keep = [c for c in keep if c in pairs.columns]
    tables = {**{f: (p.idf, p.n_docs) for f, p in fp.bm25_params.items()}, "vocab": (fp.vocab.idf, fp.vocab.n_docs)}
    j = joined(_with_word_idf(pairs, tables), prods)
    words = F.transform("qw", lambda x: F.struct(x["term"].alias("term"), x["idf_vocab"].alias("idf")))
    latent = latent_features(pairs, prods, fp.vocab, fp.basis) if fp.basis is not None else latent_cosine_features(pairs, prods, fp.vocab)
    own = [*ft.basic_columns(), *ft.similarity_columns()]
    j = j.select("pair_id", *keep, *own, "qw", *BM25_FIELDS, *[f"{f}_len" for f in BM25_FIELDS])
    names = [c for c in j.columns if c not in ("qw", *BM25_FIELDS, *[f"{f}_len" for f in BM25_FIELDS])]
    j = ft.with_word_counts(j, "qw", list(BM25_FIELDS))
    out = j.select(*names, *_bm25_columns(fp.bm25_params), *ft.tf_idf_columns(words, tf=F.col("tf_title")))
    for part in (ft.mean_char_jaccard(pairs, prods, "title", "mean_jcc_product_title_with_search_term"),
                 ft.mean_char_jaccard(pairs, prods, "description", "mean_jcc_product_desc_with_search_term"),
                 ft.mean_char_jaccard(pairs, prods, "attributes", "mean_jcc_attr_with_search_term"),
                 latent):
        out = out.join(part, "pair_id", "left")
    return out.select("pair_id", *keep, *[F.col(c).cast("double").alias(c) for c in ft.FEATURE_ORDER])


def feature_table(spark: SparkSession, sf_dir: str, persist: bool = True, latent: int | None = None) -> DataFrame:
    """All 41 features per labelled pair plus ``relevance`` and ``is_train``, written once to the
    checkpoint folder so model fitting reads a compact table instead of re-running text work."""
    pairs, prods = notebook_inputs(spark, sf_dir, persist=persist)
    out = compute_features(pairs, prods, fit_feature_params(pairs, prods, latent))
    return materialize(out, "features") if persist else out


#: Latent columns per text in approach 2.
LATENT = 20
_A2_TEXTS = ("search", "title", "desc")
#: The 95 columns of approach 2: the 41 of approach 1 without the idf statistics that it lacks, then the latent ones.
FEATURES_A2 = ([c for c in ft.FEATURE_ORDER if c not in ("max_tfidf_ST", "min_tfidf_ST", "sum_tfidf_ST", "max_idf_ST", "min_idf_ST", "sum_idf_ST")]
               + [f"svd_{t}_{i}" for t in _A2_TEXTS for i in range(LATENT)])


def latent_basis(products: DataFrame, vocab: tfidf.TfidfVocab, k: int):
    """(basis, docs(doc, td)): SVD of the distinct title+description texts, one row per text (told by a hash)."""
    docs = title_desc(products).withColumn("h", F.sha2("td", 256))
    first = docs.groupBy("h").agg(F.min("product_uid").alias("product_uid")).select("product_uid")
    docs = materialize(docs.join(first, "product_uid", "left_semi").select(F.col("product_uid").alias("doc"), "td"), "latent-docs")
    return tfidf.fit_svd(docs, "doc", "td", vocab, k), docs


def _latent_columns(df: DataFrame, key: str, text: str, vocab: tfidf.TfidfVocab, basis, name: str) -> DataFrame:
    x = tfidf.project(df.select(key, text), key, text, vocab, basis)
    return x.select(key, *[F.get("x", F.lit(i)).alias(f"svd_{name}_{i}") for i in range(LATENT)])


def feature_table_a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95-column vector per labelled pair, with ``relevance`` and ``is_train``; texts without known terms have zeros."""
    pairs, prods = notebook_inputs(spark, sf_dir)
    fp = fit_feature_params(pairs, prods)
    base = compute_features(pairs, prods, fp)
    basis, _ = latent_basis(prods, fp.vocab, LATENT)
    out = base.join(pairs.select("pair_id", "product_uid"), "pair_id")
    out = out.join(_latent_columns(pairs, "pair_id", "q", fp.vocab, basis, "search"), "pair_id", "left")
    out = out.join(_latent_columns(prods, "product_uid", "title", fp.vocab, basis, "title"), "product_uid", "left")
    out = out.join(_latent_columns(prods, "product_uid", "description", fp.vocab, basis, "desc"), "product_uid", "left")
    latent = [c for c in FEATURES_A2 if c.startswith("svd_")]
    return materialize(out.select("pair_id", "relevance", "is_train", *FEATURES_A2).na.fill(0.0, subset=latent), "features-a2")


def app_inputs(spark: SparkSession, sf_dir: str, persist: bool = True):
    """Pairs and products cleaned with the app rules (T1/T2, stop words T4, bullets T5,
    empty-field sentinels P9), on the part catalog: each misspelled part-name query is paired
    with every part of that name. Attributes fall back to the description (P8)."""
    from relevo.functions import text as tx
    q = fx.part_queries(spark, sf_dir)
    p = fx.part_products(spark, sf_dir)
    pairs = (q.join(p.select("product_uid", F.col("product_title").alias("truth")), "truth")
              .select(F.concat_ws("#", "query_id", F.col("product_uid").cast("string")).alias("pair_id"),
                      "product_uid", tx.strip_stopwords(tx.clean_search("text")).alias("q0")))
    pairs = pairs.select("pair_id", "product_uid",
                         F.when(F.col("q0") == "", F.lit("missing_search")).otherwise(F.col("q0")).alias("q"))
    b = tx.strip_stopwords(tx.clean_text("brand"))
    prods = p.select(
        "product_uid",
        tx.strip_stopwords(tx.clean_text("product_title")).alias("title"),
        tx.remove_bullets(tx.strip_stopwords(tx.clean_text("product_description"))).alias("description"),
        tx.remove_bullets(tx.strip_stopwords(tx.clean_text("product_description"))).alias("attributes"),
        F.when(b == "", F.lit("missing_brand")).otherwise(b).alias("brand"))
    if persist:
        pairs, prods = materialize(pairs, "app-pairs"), materialize(prods, "app-products")
    return pairs, prods
