"""Search over whole tables of queries (R6, R10) and the flagship BM25 report.

The source system answers one query at a time: clean, correct spelling, BM25
top 100, fetch products, featurize, score, top 10. Here every step is a
DataFrame job over a table ``queries(query_id, text)``, so a batch of a million
queries is one plan: one broadcast or shuffled join of query words against the
postings, one aggregation per (query, product), and one top-n window.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.functions import text as tx
from relevo.operators import assemble as asm
from relevo.operators import bm25, spell
from relevo.operators import features as ft
from relevo.operators import models as mx
from relevo.operators.topn import top_n_per_group
from relevo.plans import featurize as fz
from relevo.session import checkpoint_dir, materialize
from relevo.sources import fixtures as fx
from relevo.sources import tables as T


#: Where a session keeps the indexes that it has built, by application, folder of tables and what they hold.
_indexes: dict[tuple[str, str, str], str] = {}


def _index(spark: SparkSession, sf_dir: str, name: str, docs, path: str | None = None) -> bm25.Bm25Index:
    """The index ``name`` of a folder of tables: built once per session (or under ``path``), then opened from its files."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if path is None and at in _indexes:
        return bm25.open_okapi(spark, _indexes[at])
    idx = bm25.build_okapi(docs(), path=path)
    _indexes[at] = idx.path
    return idx


def document_index(spark: SparkSession, sf_dir: str, path: str | None = None) -> bm25.Bm25Index:
    """BM25Okapi index over the cleaned text of every document; written under ``path`` if that is given."""
    def docs():
        d = T.documents(spark, sf_dir, ("doc_id", "text"))
        return d.select(F.col("doc_id").alias("product_uid"), tx.clean_text("text").alias("text"))
    return _index(spark, sf_dir, "documents", docs, path)


def catalog_index(spark: SparkSession, sf_dir: str, cat: DataFrame) -> bm25.Bm25Index:
    """BM25Okapi index over the texts of the catalog."""
    return _index(spark, sf_dir, "catalog", lambda: cat.select("product_uid", "text"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembled catalog; brands and their imputation reach its ``text``."""
    p = materialize(fx.pairs(spark, sf_dir), "pairs")
    return asm.assemble_catalog(p.where("is_train"), p.where("NOT is_train"),
                                fx.attributes(spark, sf_dir), fx.products(spark, sf_dir))


def vocabulary_index(spark: SparkSession, sf_dir: str, cat: DataFrame) -> spell.SpellIndex:
    """The deletion index of the catalog's titles and brands: built once per session, then opened from its files."""
    at = (spark.sparkContext.applicationId, sf_dir, "vocabulary")
    if at in _indexes:
        return spell.open_index(spark, _indexes[at])
    idx = spell.build_index(spell.word_counts(spell.corpus_lines(cat), with_freq=False))
    _indexes[at] = idx.path
    return idx


def corrected_queries(spark: SparkSession, sf_dir: str, cat: DataFrame) -> DataFrame:
    """(query_id, text): benchmark queries, cleaned and corrected against the catalog's titles and brands."""
    q = fx.queries(spark, sf_dir).select("query_id", tx.clean_search("text").alias("text"))
    return materialize(spell.correct_text(q, "query_id", "text", vocabulary_index(spark, sf_dir, cat), out="text"), "corrected-queries")


def candidates(cat: DataFrame, idx: bm25.Bm25Index, queries: DataFrame, n: int = 100) -> DataFrame:
    """R6 + J6: the n best catalog texts per query, and every product that has such a text
    (query_id, rank, product_uid); a product's rank is the best of its text."""
    top = materialize(bm25.top_n(idx, queries, n=n), "candidates-top")
    texts = cat.select("product_uid", "text")
    hit = top.join(texts, "product_uid").select("query_id", "rank", F.xxhash64("text").alias("h"), "text")
    hit = hit.groupBy("query_id", "h", "text").agg(F.min("rank").alias("rank"))
    same = texts.select("product_uid", F.xxhash64("text").alias("h"), F.col("text").alias("_t"))
    # text membership: hashes first, then the texts themselves
    return hit.join(same, "h").where(F.col("text") == F.col("_t")).select("query_id", "rank", "product_uid")


def bm25_topn(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """Flagship: the n best documents for every benchmark search phrase."""
    idx = document_index(spark, sf_dir)
    q = fx.queries(spark, sf_dir).select("query_id", tx.clean_search("text").alias("text"))
    top = bm25.top_n(idx, q, n=n)
    return top.select(F.col("query_id").cast("bigint"), F.col("product_uid").cast("bigint"),
                      F.col("rank").cast("bigint"), F.col("score").cast("double"))


#: Where a session keeps the blend of a folder of tables.
_blends: dict[tuple[str, str], str] = {}


def fitted_blend(spark: SparkSession, sf_dir: str, gbt_iter: int = 999):
    """(blend, feature parameters, feature table) of the labelled pairs: fitted once per session and
    folder of tables, saved, and loaded from the files by whoever asks again."""
    at = (spark.sparkContext.applicationId, f"{sf_dir}|{gbt_iter}")
    if at not in _blends:
        path = f"{checkpoint_dir(spark).rstrip('/')}/blend-{uuid.uuid4().hex[:12]}"
        pairs, prods = fz.notebook_inputs(spark, sf_dir)
        fp = fz.fit_feature_params(pairs, prods)
        fz.save_feature_params(spark, fp, f"{path}/parameters")
        fz.compute_features(pairs, prods, fp).write.mode("overwrite").parquet(f"{path}/features")
        ftab = spark.read.parquet(f"{path}/features")
        mx.save_blend(spark, mx.fit_blend(ftab.where("is_train").drop("is_train"), ft.FEATURE_ORDER, gbt_iter=gbt_iter), path)
        _blends[at] = path
    path = _blends[at]
    return mx.load_blend(spark, path), fz.load_feature_params(spark, f"{path}/parameters"), spark.read.parquet(f"{path}/features")


def search_top10(spark: SparkSession, sf_dir: str, n: int = 100, k: int = 10, gbt_iter: int = 999) -> DataFrame:
    """R6 + R9 + R10 for the whole table of benchmark queries.

    clean -> spelling correction against the catalog vocabulary -> BM25 top ``n`` of the catalog
    -> features (parameters fitted on labelled pairs) -> two-level blend -> top ``k``.
    """
    # 1. model and feature parameters from the labelled pairs
    blend, fp, _ = fitted_blend(spark, sf_dir, gbt_iter)

    # 2. corrected queries and their candidate products
    cat = materialize(catalog(spark, sf_dir), "catalog")
    q = corrected_queries(spark, sf_dir, cat)
    cand = candidates(cat, catalog_index(spark, sf_dir, cat), q, n).join(q, "query_id").select(
        F.concat_ws(":", "query_id", "product_uid").alias("pair_id"), "query_id", "product_uid",
        tx.standardize_measures(tx.remove_special_char("text")).alias("q"))
    cand = materialize(cand, "candidates")

    # 3. features of the candidate pairs, blend prediction, top k per query
    cprods = materialize(fz.notebook_products(spark, sf_dir, restrict_to=cand), "candidate-products")
    feats = materialize(fz.compute_features(cand.select("pair_id", "product_uid", "q"), cprods, fp, keep=()),
                        "candidate-features")
    pred = mx.predict_blend(blend, feats, ft.FEATURE_ORDER, label=None)
    scored = (pred.select("pair_id", F.round("prediction", 6).alias("relevance"))
                  .join(cand.select("pair_id", "query_id", "product_uid"), "pair_id")
                  .join(cat.select("product_uid", "product_title"), "product_uid"))
    top = top_n_per_group(scored, "query_id", [F.desc("relevance"), F.asc("product_uid")], k, salt_cols=["product_uid"])
    return top.select("query_id", "rank", "product_uid", "product_title", "relevance")
