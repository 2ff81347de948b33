"""Registry of every implemented operator as a runnable query over the driver tables.

Each entry is ``(spark, sf_dir) -> DataFrame`` and reads whole tables. Computed
columns carry the same aliases as the DuckDB statements in ``relevo.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.functions import text as tx
from relevo.plans import search
from relevo.operators import bm25
from relevo.session import materialize
from relevo.sources import tables as T

QUERIES: dict = {}


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- retrieval ---

@register("bm25_topn")
def q_bm25_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_topn(spark, sf_dir, n=10)


# ------------------------------------------------------------ text cleaning ---

@register("clean_text")
def q_clean_text(spark, sf_dir):
    d = T.documents(spark, sf_dir, ("doc_id", "text"))
    return d.select("doc_id", tx.clean_text("text").alias("cleaned"))


@register("clean_search")
def q_clean_search(spark, sf_dir):
    b = T.benchmark(spark, sf_dir)
    return b.select("item_id", tx.clean_search("text").alias("cleaned"))


@register("clean_units")
def q_clean_units(spark, sf_dir):
    d = T.documents(spark, sf_dir, ("doc_id", "text"))
    return d.select("doc_id", tx.standardize_units(F.lower("text")).alias("units"))


@register("strip_stopwords")
def q_strip_stopwords(spark, sf_dir):
    d = T.documents(spark, sf_dir, ("doc_id", "text"))
    return d.select("doc_id", tx.strip_stopwords(tx.clean_text("text")).alias("stripped"))


@register("clean_measures")
def q_clean_measures(spark, sf_dir):
    d = T.documents(spark, sf_dir, ("doc_id", "text"))
    return d.select("doc_id", tx.standardize_measures(tx.remove_special_char("text")).alias("measured"))


@register("camel_split")
def q_camel_split(spark, sf_dir):
    d = T.documents(spark, sf_dir, ("doc_id", "text"))
    return d.select("doc_id", tx.split_glued_words("text").alias("split_text"))


# ------------------------------------------------------------------ assembly ---

from relevo.operators import assemble as asm  # noqa: E402
from relevo.operators import profile as prof  # noqa: E402
from relevo.sources import fixtures as fx  # noqa: E402


def _catalog(spark, sf_dir):
    return search.catalog(spark, sf_dir)


@register("assemble_catalog")
def q_assemble_catalog(spark, sf_dir):
    return _catalog(spark, sf_dir)


@register("attr_concat")
def q_attr_concat(spark, sf_dir):
    return asm.attribute_text(fx.attributes(spark, sf_dir), fill_null=True)


@register("attr_concat_rows")
def q_attr_concat_rows(spark, sf_dir):
    return asm.attribute_text_rows(fx.attributes(spark, sf_dir))


@register("brand_impute")
def q_brand_impute(spark, sf_dir):
    """P10 over every product: brand rows joined, missing brands imputed from titles."""
    a = fx.attributes(spark, sf_dir)
    prods = fx.products(spark, sf_dir).select("product_uid", "product_title")
    cat = prods.join(asm.brand_rows(a), "product_uid", "left")
    return asm.impute_brand(cat).select("product_uid", "brand")


@register("dedupe_first")
def q_dedupe_first(spark, sf_dir):
    """U1 + W1: train rows then test rows, first row kept per product."""
    p = fx.pairs(spark, sf_dir)
    both = (p.where("is_train").select("id", "product_uid", "search_term", F.lit(0).alias("src"))
            .unionByName(p.where("NOT is_train").select("id", "product_uid", "search_term", F.lit(1).alias("src"))))
    return asm.first_row_per_key(both, "product_uid", ["src", "id"]).drop("src")


@register("assemble_pairs")
def q_assemble_pairs(spark, sf_dir):
    return asm.assemble_pairs(fx.pairs(spark, sf_dir).drop("is_train"), fx.attributes(spark, sf_dir),
                              fx.products(spark, sf_dir))


@register("bucket_relevance")
def q_bucket_relevance(spark, sf_dir):
    """P11 on relevance shifted by a third of the gap to make ties and rounding matter."""
    p = fx.pairs(spark, sf_dir)
    s = (F.col("relevance") + (F.col("id") % 7 - 3) * F.lit(0.11)).alias("score")
    x = p.select("id", s)
    return x.select("id", F.round("score", 6).alias("score"), asm.relevance_class(F.col("score")).alias("relevance_class"))


@register("clip_predictions")
def q_clip_predictions(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    raw = F.col("relevance") * 1.4 - 0.9
    return p.select("id", F.round(asm.clip(raw), 6).alias("relevance"))


# ----------------------------------------------------------------- profiling ---

@register("null_profile")
def q_null_profile(spark, sf_dir):
    a = fx.attributes(spark, sf_dir)
    c = _catalog(spark, sf_dir)
    return prof.null_profile(a, "attributes").unionByName(prof.null_profile(c, "catalog"))


@register("describe_numeric")
def q_describe_numeric(spark, sf_dir):
    d = T.documents(spark, sf_dir, ("doc_id", "n_chars"))
    return prof.describe(d, ["n_chars", "doc_id"])


@register("distinct_dups")
def q_distinct_dups(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    return prof.distinct_and_duplicates(p, [["product_uid"], ["search_term"], ["product_title"],
                                            ["search_term", "product_uid"]])


@register("value_counts")
def q_value_counts(spark, sf_dir):
    a = fx.attributes(spark, sf_dir).where(F.col("value").isNotNull())
    return prof.value_counts(a, "value")


@register("value_counts_more")
def q_value_counts_more(spark, sf_dir):
    """Pairs per product, pairs per search term, attribute rows per product."""
    p, a = fx.pairs(spark, sf_dir), fx.attributes(spark, sf_dir)
    def counts(df, key, name):
        return df.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("cnt")).select(
            F.lit(name).alias("key_name"), F.col(key).cast("string").alias("key"), "cnt")
    return (counts(p, "product_uid", "pairs_per_product").unionByName(counts(p, "search_term", "pairs_per_search"))
            .unionByName(counts(a, "product_uid", "attributes_per_product")))


@register("histogram_uid")
def q_histogram_uid(spark, sf_dir):
    """10 equal-width bins of the product ids of all pairs."""
    return prof.equal_width_histogram(fx.pairs(spark, sf_dir), "product_uid", 10)


@register("histogram_len")
def q_histogram_len(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    return prof.equal_width_histogram(p, F.length("search_term"), 10)


@register("class_hist")
def q_class_hist(spark, sf_dir):
    return prof.value_counts(fx.pairs(spark, sf_dir), "relevance")


@register("set_overlap")
def q_set_overlap(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    tr, te = p.where("is_train"), p.where("NOT is_train")
    a = fx.attributes(spark, sf_dir)
    return (prof.set_overlap(tr, te, ["product_uid"], "product_uid")
            .unionByName(prof.set_overlap(tr, te, ["search_term"], "search_term"))
            .unionByName(prof.set_overlap(tr, te, ["search_term", "product_uid"], "pair"))
            .unionByName(prof.set_overlap(a.where(F.col("name") == "MFG Brand Name"),
                                          fx.products(spark, sf_dir), ["product_uid"], "brand_vs_desc"))
            .unionByName(prof.set_overlap(a, fx.products(spark, sf_dir), ["product_uid"], "attr_vs_desc")))


# ------------------------------------------------------------ pair features ---

from relevo.operators import features as ft  # noqa: E402
from relevo.operators import svd  # noqa: E402
from relevo.operators import tfidf as tfx  # noqa: E402
from relevo.plans import featurize as fz  # noqa: E402


def _rounded(df: DataFrame, key: str = "pair_id") -> DataFrame:
    return df.select(key, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in df.columns if c != key])


@register("feat_basic")
def q_feat_basic(spark, sf_dir):
    pairs, prods = fz.notebook_inputs(spark, sf_dir)
    return _rounded(ft.basic_features(fz.joined(pairs, prods)))


@register("feat_similarity")
def q_feat_similarity(spark, sf_dir):
    pairs, prods = fz.notebook_inputs(spark, sf_dir)
    return _rounded(ft.similarity_features(fz.joined(pairs, prods)))


@register("feat_mean_jaccard")
def q_feat_mean_jaccard(spark, sf_dir):
    pairs, prods = fz.notebook_inputs(spark, sf_dir)
    out = ft.mean_char_jaccard(pairs, prods, "title", "mean_jcc_product_title_with_search_term")
    out = out.join(ft.mean_char_jaccard(pairs, prods, "description", "mean_jcc_product_desc_with_search_term"), "pair_id")
    out = out.join(ft.mean_char_jaccard(pairs, prods, "attributes", "mean_jcc_attr_with_search_term"), "pair_id")
    return _rounded(out)


@register("bm25_pair_score")
def q_bm25_pair_score(spark, sf_dir):
    pairs, prods = fz.notebook_inputs(spark, sf_dir)
    return _rounded(fz.bm25_features(pairs, prods))


@register("tfidf_minmax")
def q_tfidf_minmax(spark, sf_dir):
    pairs, prods = fz.notebook_inputs(spark, sf_dir)
    return _rounded(fz.tfidf_features(pairs, prods))


@register("tfidf_weights")
def q_tfidf_weights(spark, sf_dir):
    """V1: the fitted vocabulary with document frequency and idf."""
    pairs, prods = fz.notebook_inputs(spark, sf_dir)
    v = fz.title_desc_vocab(pairs, prods)
    return v.idf.select("term", F.col("df").cast("bigint"), F.round("idf", 6).alias("idf"),
                        F.col("term_index").cast("bigint"))


@register("tfidf_cosine")
def q_tfidf_cosine(spark, sf_dir):
    """V2 + V5: cosine of the search term's and the title+description's TF-IDF vectors."""
    pairs, prods = fz.notebook_inputs(spark, sf_dir)
    v = fz.title_desc_vocab(pairs, prods)
    return _rounded(fz.pair_cosine(pairs, fz.title_desc(prods), "td", v, fz.search_weights(pairs, v), "cosine_tfidf"))


# ------------------------------------------------------------------ spelling ---

from relevo.operators import spell  # noqa: E402


def part_vocab(spark, sf_dir):
    """R8 + G10: vocabulary of the part catalog (cleaned title + brand, stop words removed)."""
    return spell.word_counts(spell.corpus_lines(fx.part_products(spark, sf_dir)))


@register("word_freq")
def q_word_freq(spark, sf_dir):
    v = part_vocab(spark, sf_dir)
    return v.select("word", F.col("cnt").cast("bigint"), F.round("freq", 6).alias("freq"))


def _part_query_words(spark, sf_dir):
    q = fx.part_queries(spark, sf_dir)
    return q.select(F.explode(tx.split_ws(F.lower(tx.clean_search("text")))).alias("word"))


@register("spell_correct")
def q_spell_correct(spark, sf_dir):
    vocab = spell.word_counts(spell.corpus_lines(fx.part_products(spark, sf_dir)), with_freq=False)
    out = spell.correct_words(_part_query_words(spark, sf_dir), vocab)
    return out.select("word", "corrected", F.col("level").cast("int"))


@register("spell_text")
def q_spell_text(spark, sf_dir):
    q = fx.part_queries(spark, sf_dir).select("query_id", tx.clean_search("text").alias("text"))
    vocab = spell.word_counts(spell.corpus_lines(fx.part_products(spark, sf_dir)), with_freq=False)
    return spell.correct_text(q, "query_id", "text", vocab)


# ---------------------------------------------------------------- embeddings ---

from relevo.operators import vectors as vx  # noqa: E402


@register("emb_max_cosine")
def q_emb_max_cosine(spark, sf_dir):
    p = vx.sentence_pairs(fx.word_vectors(spark, sf_dir))
    out = vx.max_cosine_per_word(p)
    return out.select(F.col("pair_id").cast("bigint"), F.round("max_cosine_sim_per_word", 6).alias("max_cosine_sim_per_word"))


@register("emb_centroid")
def q_emb_centroid(spark, sf_dir):
    p = vx.sentence_pairs(fx.word_vectors(spark, sf_dir))
    out = vx.centroid_features(p)
    return out.select(F.col("pair_id").cast("bigint"), F.round("w2v_n_similarity", 6).alias("w2v_n_similarity"),
                      F.round("w2v_centroid_rmse", 6).alias("w2v_centroid_rmse"))


@register("w2v_pair_features")
def q_w2v_pair_features(spark, sf_dir):
    """Search words against title and description words, each word with a vector of ``embeddings``."""
    pairs, prods = fz.notebook_inputs(spark, sf_dir)
    wv = fx.word_vectors(spark, sf_dir).select("word_id", "vector")
    n = (wv.agg(F.max("word_id")).first()[0] or 0) + 1
    out = vx.pair_vector_features(pairs, prods, wv, n, "title", "title")
    return _rounded(out.join(vx.pair_vector_features(pairs, prods, wv, n, "description", "desc"), "pair_id"))


@register("emb_neighbors")
def q_emb_neighbors(spark, sf_dir):
    """O3: the 10 vectors nearest to each label centroid."""
    wv = fx.word_vectors(spark, sf_dir)
    c = vx.centroid(wv, "sentence_id", "vector", "qvec").withColumnRenamed("sentence_id", "query_id")
    top = vx.nearest(c, wv, 10)
    return top.select(F.col("query_id").cast("bigint"), F.col("word_id").cast("bigint"),
                      F.col("rank").cast("bigint"), F.round("cosine", 6).alias("cosine"))


# -------------------------------------------------------------------- models ---

from relevo.operators import models as mx  # noqa: E402

BASIC = ft.FEATURE_ORDER[:14]


@register("pair_features")
def q_pair_features(spark, sf_dir):
    """All 41 features per labelled pair (values rounded to 6 places for comparison)."""
    t = fz.feature_table(spark, sf_dir)
    return t.select("pair_id", "relevance", "is_train", *[F.round(c, 6).alias(c) for c in ft.FEATURE_ORDER])


@register("standard_scale")
def q_standard_scale(spark, sf_dir):
    pairs, prods = fz.notebook_inputs(spark, sf_dir)
    fb = ft.basic_features(fz.joined(pairs, prods))
    s = mx.standard_scale(fb, BASIC)
    return s.select("pair_id", *[F.round(c, 6).alias(c) for c in BASIC])


@register("stratified_split")
def q_stratified_split(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).select("id", "relevance")
    p = p.withColumn("relevance_class", asm.relevance_class(F.col("relevance")))
    s = mx.split(p, "id", 0.8, seed=122, by="relevance_class")
    return s.groupBy("relevance_class", "split").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@register("corr_matrix")
def q_corr_matrix(spark, sf_dir):
    pairs, prods = fz.notebook_inputs(spark, sf_dir)
    fb = ft.basic_features(fz.joined(pairs, prods)).join(pairs.select("pair_id", "relevance"), "pair_id")
    return prof.correlation_long(fb, ["relevance", "search_term_length", "numbers_in_title",
                                      "title_common_word_count", "desc_common_word_count", "last_word_in_title"])


@register("corr_rank")
def q_corr_rank(spark, sf_dir):
    pairs, prods = fz.notebook_inputs(spark, sf_dir)
    fb = ft.basic_features(fz.joined(pairs, prods)).join(pairs.select("pair_id", "relevance"), "pair_id")
    cols = ["search_term_length", "last_word_in_title", "last_word_in_desc", "numbers_in_title",
            "title_common_word_count", "desc_common_word_count", "title_common_word_count_bigram"]
    return prof.rank_by_abs_correlation(fb, cols, "relevance")


@register("corr_features")
def q_corr_features(spark, sf_dir):
    """G8 over the whole feature table: all pairs of the 41 features and the relevance."""
    t = fz.feature_table(spark, sf_dir)
    return prof.correlation_from_products(t.select(*[F.round(c, 6).alias(c) for c in ft.FEATURE_ORDER], "relevance"), [*ft.FEATURE_ORDER, "relevance"])


@register("corr_features_rank")
def q_corr_features_rank(spark, sf_dir):
    """G9 over the whole feature table: features by the size of their correlation with the relevance."""
    c = q_corr_features(spark, sf_dir).where("col_b = 'relevance'")
    return c.select(F.col("col_a").alias("feature"), "corr").orderBy(F.desc(F.abs("corr")), "feature")


@register("table_shapes")
def q_table_shapes(spark, sf_dir):
    """Rows and columns of the pairs, products, attribute rows and the catalog."""
    parts = {"pairs": fx.pairs(spark, sf_dir), "products": fx.products(spark, sf_dir), "attributes": fx.attributes(spark, sf_dir), "catalog": _catalog(spark, sf_dir)}
    out = [prof.shape(df, name) for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@register("error_box")
def q_error_box(spark, sf_dir):
    """G13 + P15 on a fixed predictor: the mean training relevance applied to the holdout."""
    p = fx.pairs(spark, sf_dir)
    mean = p.where("is_train").agg(F.avg("relevance")).first()[0]
    diff = p.where("NOT is_train").select((F.col("relevance") - F.lit(mean)).alias("diff"))
    return prof.box_stats(diff, "diff")


def _features_split(spark, sf_dir, approach: int = 1):
    ftab = fz.feature_table(spark, sf_dir) if approach == 1 else fz.feature_table_a2(spark, sf_dir)
    return ftab.where("is_train").drop("is_train"), ftab.where("NOT is_train").drop("is_train")


@register("fit_linear")
def q_fit_linear(spark, sf_dir):
    """M3 + M7-M9: coefficients of ridge / lasso / elastic net on scaled features."""
    tr, _ = _features_split(spark, sf_dir)
    s = mx.assemble(mx.standard_scale(tr, ft.FEATURE_ORDER), ft.FEATURE_ORDER)
    out = None
    for name in ("ridge", "lasso", "elastic_net"):
        m = mx.base_learners()[name](s).fit(s)
        t = mx.importance_table(m, ft.FEATURE_ORDER, name)
        out = t if out is None else out.unionByName(t)
    return out


@register("fit_trees")
def q_fit_trees(spark, sf_dir):
    """Tree ensembles and their feature importances."""
    tr, _ = _features_split(spark, sf_dir)
    f = mx.assemble(tr, ft.FEATURE_ORDER)
    out = None
    for name in ("boosting", "forest", "tree"):
        m = mx.fit_learner(mx.base_learners()[name](f), f)
        t = mx.importance_table(m, ft.FEATURE_ORDER, name)
        out = t if out is None else out.unionByName(t)
    return out


@register("blend_predict")
def q_blend_predict(spark, sf_dir):
    """M16 + M19: two-level blend fitted on the training pairs, clipped predictions for the holdout, written
    as CSV and read back."""
    blend, _, ftab = search.fitted_blend(spark, sf_dir)
    p = mx.predict_blend(blend, ftab.where("NOT is_train").drop("is_train"), ft.FEATURE_ORDER)
    path = _scratch(spark, "predictions-csv")
    sio.write_csv(p, path)
    return sio.read_csv(spark, path, ", ".join(f"{c} {t}" for c, t in p.dtypes), multi_line=False)


@register("rmse_table")
def q_rmse_table(spark, sf_dir):
    """Train and holdout RMSE of every base model and of the blend."""
    blend, _, ftab = search.fitted_blend(spark, sf_dir)
    p = mx.predict_blend(blend, ftab, ft.FEATURE_ORDER).join(ftab.select("pair_id", "is_train"), "pair_id")
    names = blend["names"] + ["blend"]
    err = [F.sqrt(F.avg(F.when(on, F.pow(F.col("relevance") - F.col("prediction" if n == "blend" else n), 2)))).alias(f"{n}__{side}")
           for n in names for side, on in (("train", F.col("is_train")), ("test", ~F.col("is_train")))]
    wide = p.agg(*err)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.round(f"{n}__train", 6).alias("rmse_train"), F.round(f"{n}__test", 6).alias("rmse_test")) for n in names]))
    return wide.select(rows.alias("r")).select("r.*")


@register("rmse_fixed")
def q_rmse_fixed(spark, sf_dir):
    """G14 + M20 on fixed predictors (training mean overall and per split): train and test RMSE."""
    p = fx.pairs(spark, sf_dir)
    mean = p.where("is_train").agg(F.avg("relevance")).first()[0] or 0.0
    wide = p.select("is_train", "relevance", F.lit(mean).alias("train_mean"), F.lit(2.0).alias("constant_two"),
                    mx.clip(F.length("search_term") / 40.0).alias("search_length"))
    names = ["train_mean", "constant_two", "search_length"]
    err = wide.groupBy("is_train").agg(*[mx.rmse_expr("relevance", n).alias(n) for n in names])
    return err.unpivot(["is_train"], names, "model", "rmse").select("model", "is_train", F.round("rmse", 6).alias("rmse"))


@register("error_analysis")
def q_error_analysis(spark, sf_dir):
    """Holdout predictions joined to their labels, error = relevance - prediction, box statistics."""
    blend, _, ftab = search.fitted_blend(spark, sf_dir)
    te = ftab.where("NOT is_train").drop("is_train")
    p = mx.predict_blend(blend, te.drop("relevance"), ft.FEATURE_ORDER, label=None)
    lab = fx.pairs(spark, sf_dir).select(F.col("id").alias("pair_id"), "relevance")
    j = p.join(lab, "pair_id", "left")
    # P5: drop the -1 sentinel; a NULL relevance passes, as NaN != -1 does in the source
    j = j.where((F.col("relevance") != -1) | F.col("relevance").isNull())
    d = j.select((F.col("relevance") - F.col("prediction")).alias("diff"))
    return prof.box_stats(d, "diff")


@register("cv_report")
def q_cv_report(spark, sf_dir):
    tr, _ = _features_split(spark, sf_dir)
    return mx.cv_ridge(mx.standard_scale(tr, ft.FEATURE_ORDER), ft.FEATURE_ORDER)


# ------------------------------------------------------------ end-to-end search ---

@register("search_candidates")
def q_search_candidates(spark, sf_dir):
    """Cleaned + corrected query -> BM25 top 100 of the catalog -> every product with such a text."""
    cat = materialize(search.catalog(spark, sf_dir), "catalog")
    q = search.corrected_queries(spark, sf_dir, cat)
    top = search.candidates(cat, search.catalog_index(spark, sf_dir, cat), q, n=100)
    return (top.join(q.withColumnRenamed("text", "search_term"), "query_id").join(cat, "product_uid")
               .select("query_id", "rank", "product_uid", "product_title", "search_term", "brand"))


@register("search_top10")
def q_search_top10(spark, sf_dir):
    return search.search_top10(spark, sf_dir)


# ----------------------------------------------------------------- streaming ---

@register("stream_bm25_topn")
def q_stream_bm25_topn(spark, sf_dir):
    """The flagship search as a stream: benchmark query rows arrive as files and are scored per micro-batch."""
    from relevo.streaming import search_stream
    idx = search.document_index(spark, sf_dir)
    return search_stream.run_once(spark, idx, sf_dir, n=10, glob="benchmark.parquet")


# ------------------------------------------------------------- sources/sinks ---

import uuid as _uuid  # noqa: E402

from relevo.session import checkpoint_dir as _ckpt  # noqa: E402
from relevo.sources import io as sio  # noqa: E402


def _scratch(spark, name):
    return f"{_ckpt(spark).rstrip('/')}/{name}-{_uuid.uuid4().hex[:10]}"


@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    """S5 then S1: products written as ISO-8859-1 CSV and read back with a declared schema."""
    path = _scratch(spark, "products-csv")
    sio.write_csv(fx.products(spark, sf_dir), path, encoding="ISO-8859-1")
    return sio.read_csv(spark, path, "product_uid BIGINT, product_title STRING, product_description STRING",
                        encoding="ISO-8859-1")


@register("csv_utf8_roundtrip")
def q_csv_utf8_roundtrip(spark, sf_dir):
    """S5 then S2: labelled pairs written as UTF-8 CSV and read back with a declared schema."""
    path = _scratch(spark, "pairs-csv")
    cols = ["id", "product_uid", "product_title", "search_term", "relevance"]
    sio.write_csv(fx.pairs(spark, sf_dir).select(*cols), path)
    return sio.read_csv(spark, path, "id BIGINT, product_uid BIGINT, product_title STRING, search_term STRING, relevance DOUBLE")


@register("corpus_roundtrip")
def q_corpus_roundtrip(spark, sf_dir):
    """R8 -> S4 -> S3 -> G10: the spelling corpus written as text, read back and counted."""
    path = _scratch(spark, "corpus-txt")
    sio.write_text(spell.corpus_lines(fx.part_products(spark, sf_dir)), "line", path)
    v = spell.word_counts(sio.read_text(spark, path))
    return v.select("word", F.col("cnt").cast("bigint"), F.round("freq", 6).alias("freq"))


@register("json_records")
def q_json_records(spark, sf_dir):
    """The flagship result rows as JSON records."""
    top = search.bm25_topn(spark, sf_dir, n=10).select("query_id", "product_uid", "rank")
    return sio.json_records(top)


@register("svd_cosine")
def q_svd_cosine(spark, sf_dir, k: int = 500):
    """V3 + V4 + V5 + V6 (F28, F29, F42 latent forms): truncated SVD (500 components) of the distinct title+description
    TF-IDF rows; cosine of search vs title+description, description and title in that basis, with the explained
    variance ratio of the fit on every row."""
    pairs, prods = fz.notebook_inputs(spark, sf_dir)
    v = fz.title_desc_vocab(pairs, prods)
    basis, docs = fz.latent_basis(prods, v, k)
    rows = materialize(tfx.sparse_rows(docs, "doc", "td", v), "svd-rows")
    evr = svd.explained_variance_ratio(rows, svd.project(rows, "doc", basis), docs.count())
    return _rounded(fz.latent_features(pairs, prods, v, basis)).withColumn("explained_variance_ratio", F.lit(round(evr, 6)))


@register("pair_features_latent")
def q_pair_features_latent(spark, sf_dir, k: int = 500):
    """All 41 features with F28 and F29 in the latent basis of 500 components."""
    t = fz.feature_table(spark, sf_dir, latent=k)
    return t.select("pair_id", "relevance", "is_train", *[F.round(c, 6).alias(c) for c in ft.FEATURE_ORDER])


@register("pair_features_a2")
def q_pair_features_a2(spark, sf_dir):
    """V9: the 95-column vector of approach 2: 35 features and 20 latent columns each of search, title and description."""
    return fz.feature_table_a2(spark, sf_dir)


def _pair_texts(pairs, prods):
    return (prods.select(F.col("description").alias("text")).unionByName(pairs.select(F.col("q").alias("text")))
            .unionByName(prods.select(F.col("title").alias("text"))))


@register("w2v_neighbors")
def q_w2v_neighbors(spark, sf_dir):
    """V7 + V8 + O3: word vectors of the distinct descriptions, searches and titles of the labelled pairs
    (100 dims, window 5, min count 1); the 10 nearest words to each search word."""
    pairs, prods = fz.notebook_inputs(spark, sf_dir)
    wv = materialize(vx.fit_word_vectors(_pair_texts(pairs, prods)), "word-vectors")
    qwords = (pairs.select(F.explode(tx.split_ws("q")).alias("word")).distinct()
              .join(wv, "word").select(F.col("word").alias("query_id"), F.col("vector").alias("qvec")))
    top = vx.nearest(qwords, wv.withColumnRenamed("word", "word_id"), k=11)
    return (top.where(F.col("word_id") != F.col("query_id"))
               .select(F.col("query_id").alias("word"), F.col("word_id").alias("neighbor"),
                       F.round("cosine", 6).alias("cosine")))


@register("word_pair_counts")
def q_word_pair_counts(spark, sf_dir):
    """V7's first half, with values that SQL can state: the weights of the 200 most frequent words as contexts of each other
    (window 5, distinct texts)."""
    pairs, prods = fz.notebook_inputs(spark, sf_dir)
    rows, _ = vx.context_weights(_pair_texts(pairs, prods), max_contexts=200)
    return rows.select("word", F.size("cols").cast("bigint").alias("n_contexts"), F.round(F.aggregate("vals", F.lit(0.0), lambda s, x: s + x), 6).alias("weight"))


@register("app_features")
def q_app_features(spark, sf_dir):
    """F1-F21, F23-F25 with the app cleaning pipeline (P8, P9, T1, T2, T4, T5) on the part catalog."""
    pairs, prods = fz.app_inputs(spark, sf_dir)
    j = fz.joined(pairs, prods)
    out = ft.basic_features(j).join(ft.similarity_features(j), "pair_id")
    return _rounded(out)


@register("fit_trees_a2")
def q_fit_trees_a2(spark, sf_dir):
    """M5, M6 (approach 2), M11, M20 on the 95-column vector: train and holdout RMSE and fit seconds of each model."""
    import time
    tr, te = _features_split(spark, sf_dir, 2)
    ftr, fte = mx.assemble(tr, fz.FEATURES_A2).persist(), mx.assemble(te, fz.FEATURES_A2).persist()
    rows = []
    for name, est in mx.extra_learners().items():
        began = time.time()
        m = mx.fit_learner(est, ftr)
        took = time.time() - began
        err = [m.transform(f).agg(mx.rmse_expr().alias("e")).first()["e"] for f in (ftr, fte)]
        rows.append((name, round(took, 1), round(err[0], 6), round(err[1], 6) if err[1] is not None else None))
    ftr.unpersist()
    fte.unpersist()
    return spark.createDataFrame(rows, "model string, fit_seconds double, rmse_train double, rmse_test double")


@register("stack_oof")
def q_stack_oof(spark, sf_dir):
    """M17 + M19: out-of-fold stacking fitted on the training pairs' 95-column vector, clipped holdout predictions."""
    tr, te = _features_split(spark, sf_dir, 2)
    bases, final, _ = mx.stack_oof(tr, fz.FEATURES_A2)
    return mx.predict_stack(bases, final, te, fz.FEATURES_A2)


@register("random_search")
def q_random_search(spark, sf_dir):
    """M14 + M15: seeded random searches of ridge, lasso and elastic net, CV report with rank and gap flag."""
    tr, _ = _features_split(spark, sf_dir)
    scaled = materialize(mx.standard_scale(tr, ft.FEATURE_ORDER), "search-input")
    out = [mx.random_search(scaled, ft.FEATURE_ORDER, kind) for kind in ("ridge", "lasso", "elastic_net")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("meta_search")
def q_meta_search(spark, sf_dir):
    """Random search of the blend's meta ridge on the scaled base predictions of the training pairs."""
    blend, _, ftab = search.fitted_blend(spark, sf_dir)
    base = mx.predict_blend(blend, ftab.where("is_train").drop("is_train"), ft.FEATURE_ORDER).drop("prediction")
    return mx.random_search(materialize(mx.standard_scale(base, blend["names"]), "search-input"), blend["names"], "meta")


@register("gbt_grid")
def q_gbt_grid(spark, sf_dir):
    """The source's staged grids of boosting, k-fold CV with early stopping."""
    tr, _ = _features_split(spark, sf_dir)
    return mx.grid_search_boosting(tr, ft.FEATURE_ORDER)


@register("search_series")
def q_search_series(spark, sf_dir):
    """Draws of the random search with a small train/test gap, as a series over the strength."""
    tr, _ = _features_split(spark, sf_dir)
    scaled = materialize(mx.standard_scale(tr, ft.FEATURE_ORDER), "search-input")
    return mx.search_series(mx.random_search(scaled, ft.FEATURE_ORDER, "elastic_net"), "alpha")


@register("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    """A fitted model written with the MLlib writer to the checkpoint folder, loaded back, used to predict."""
    from pyspark.ml.regression import LinearRegressionModel
    tr, te = _features_split(spark, sf_dir)
    s_tr = mx.standard_scale(tr, ft.FEATURE_ORDER)
    f_tr = mx.assemble(s_tr, ft.FEATURE_ORDER)
    m = mx.base_learners()["lasso"](f_tr).fit(f_tr)
    path = _scratch(spark, "model-lasso")
    sio.save_model(m, path)
    loaded = LinearRegressionModel.load(path)
    s_te = mx.standard_scale(te, ft.FEATURE_ORDER, fit_on=tr)
    p = loaded.transform(mx.assemble(s_te, ft.FEATURE_ORDER))
    return p.select("pair_id", F.round(mx.clip(F.col("prediction")), 6).alias("prediction"))


@register("shared_pairs")
def q_shared_pairs(spark, sf_dir):
    """Labelled and unlabelled pairs joined on (product_title, search_term); the source finds none."""
    p = fx.pairs(spark, sf_dir)
    tr = p.where("is_train").select("product_title", "search_term", F.col("id").alias("id_x"), "relevance")
    te = p.where("NOT is_train").select("product_title", "search_term", F.col("id").alias("id_y"))
    return tr.join(te, ["product_title", "search_term"], "inner")


@register("attr_null_rows")
def q_attr_null_rows(spark, sf_dir):
    """Attribute rows by NULL pattern (uid present / value missing, name missing, all present)."""
    a = fx.attributes(spark, sf_dir)
    return a.agg(
        F.sum((F.col("product_uid").isNotNull() & F.col("value").isNull()).cast("long")).alias("uid_no_value"),
        F.sum((F.col("product_uid").isNull() & F.col("name").isNull()).cast("long")).alias("no_uid_no_name"),
        F.sum((F.col("product_uid").isNotNull() & F.col("name").isNotNull() & F.col("value").isNotNull())
              .cast("long")).alias("complete"))


@register("catalog_preview")
def q_catalog_preview(spark, sf_dir):
    """The first five catalog rows (by product id)."""
    return _catalog(spark, sf_dir).orderBy("product_uid").limit(5).select("product_uid", "product_title", "brand")


@register("feat_ngram_overlap")
def q_feat_ngram_overlap(spark, sf_dir):
    """Exact n-gram overlap (threshold 0): |distinct n-grams of the search ∩ of the field|, n = 1, 2."""
    pairs, prods = fz.notebook_inputs(spark, sf_dir)
    j = pairs.join(prods, "product_uid")
    q1, t1, d1 = tx.split_blank("q"), tx.split_blank("title"), tx.split_blank("description")
    return j.select(
        "pair_id",
        F.size(F.array_intersect(q1, t1)).cast("bigint").alias("title_unigram_overlap"),
        F.size(F.array_intersect(q1, d1)).cast("bigint").alias("desc_unigram_overlap"),
        F.size(F.array_intersect(tx.bigrams(q1), tx.bigrams(t1))).cast("bigint").alias("title_bigram_overlap"),
        F.size(F.array_intersect(tx.bigrams(q1), tx.bigrams(d1))).cast("bigint").alias("desc_bigram_overlap"))


@register("tfidf_cosine_title")
def q_tfidf_cosine_title(spark, sf_dir):
    """TF-IDF cosine of the search term and the title (shared vocabulary)."""
    pairs, prods = fz.notebook_inputs(spark, sf_dir)
    v = fz.title_desc_vocab(pairs, prods)
    return _rounded(fz.pair_cosine(pairs, prods, "title", v, fz.search_weights(pairs, v), "cosine_similarity_tfidf_search_title"))


@register("gbt_early_stop")
def q_gbt_early_stop(spark, sf_dir):
    """Boosting with early stopping on a hash-selected validation fifth of the training pairs."""
    from pyspark.ml.regression import GBTRegressor
    tr, te = _features_split(spark, sf_dir)
    f = mx.assemble(tr, ft.FEATURE_ORDER).withColumn("is_val", mx.hash_fraction(F.col("pair_id"), 11) < 0.2)
    m = GBTRegressor(labelCol="relevance", featuresCol="features", maxIter=200, stepSize=0.05, maxDepth=6,
                     validationIndicatorCol="is_val", validationTol=0.001, seed=122).fit(f)
    p = m.transform(mx.assemble(te, ft.FEATURE_ORDER))
    return p.agg(mx.rmse_expr().alias("rmse_test")).select(
        F.lit(m.getNumTrees).alias("n_trees"), F.round("rmse_test", 6).alias("rmse_test"))


@register("bm25_topn_padded")
def q_bm25_topn_padded(spark, sf_dir):
    """O2: the flagship top 10, completed with zero-score documents for queries with fewer hits."""
    idx = search.document_index(spark, sf_dir)
    q = fx.queries(spark, sf_dir).select("query_id", tx.clean_search("text").alias("text"))
    top = bm25.top_n(idx, q, n=10)
    docs = T.documents(spark, sf_dir, ("doc_id",)).select(F.col("doc_id").alias("product_uid"))
    out = bm25.pad_zero_scores(top, q, docs, 10)
    return out.select(F.col("query_id").cast("bigint"), F.col("product_uid").cast("bigint"),
                      F.col("rank").cast("bigint"), F.col("score").cast("double"))
