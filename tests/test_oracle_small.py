"""Registered queries against their DuckDB oracle on the smallest fixture."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from relevo.sources.tables import TABLES, table_path
from tests.conftest import SF_SMALL

FAST = ["bm25_topn", "clean_text", "clean_search", "clean_measures", "camel_split", "strip_stopwords",
        "assemble_catalog", "attr_concat", "brand_impute", "dedupe_first", "assemble_pairs", "bucket_relevance",
        "describe_numeric", "distinct_dups", "histogram_len", "set_overlap", "feat_basic", "feat_similarity",
        "feat_mean_jaccard", "bm25_pair_score", "tfidf_minmax", "tfidf_cosine", "word_freq", "spell_correct",
        "spell_text", "emb_max_cosine", "emb_centroid", "emb_neighbors", "standard_scale", "stratified_split",
        "corr_rank", "error_box", "app_features", "feat_ngram_overlap", "tfidf_cosine_title", "attr_null_rows",
        "shared_pairs", "catalog_preview", "csv_roundtrip", "corpus_roundtrip", "json_records", "stream_bm25_topn",
        "pair_features", "null_profile", "value_counts", "class_hist", "clip_predictions", "attr_concat_rows",
        "clean_units", "tfidf_weights", "corr_matrix", "bm25_topn_padded", "value_counts_more", "histogram_uid",
        "w2v_pair_features", "rmse_fixed", "csv_utf8_roundtrip", "table_shapes", "word_pair_counts", "corr_features"]


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{round(v, 6):.6f}"
    return "NULL" if v is None else str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    a = _rows(df.columns, [tuple(r) for r in df.collect()])
    b = _rows([d[0] for d in res.description], res.fetchall())
    assert a == b


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["query_id", "product_uid", "rank", "score"]
