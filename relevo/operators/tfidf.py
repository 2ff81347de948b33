"""TF-IDF vocabulary, weights and cosine (V1, V2, V5) as long tables.

A document-term matrix is a table ``(doc_key, term, weight)``; products and
queries are weighted independently and meet in one equi-join on the term, so
no dense or sparse matrix is ever collected.

V1 follows the source's vectorizer settings: lower case, tokens of two or more
word characters, stop words removed, document frequency >= ``min_df``, the
``max_features`` most frequent terms (ties by term), fitted on distinct texts,
``idf = ln((1 + n) / (1 + df)) + 1``. V2: raw counts x idf, L2-normalised rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevo.functions import text as tx
from relevo.functions.stopwords import ENGLISH_STOP_WORDS
from relevo.operators import svd
from relevo.operators.vectors import cosine as vec_cosine
from relevo.session import materialize


@dataclass
class TfidfVocab:
    idf: DataFrame   # term, df, idf, term_index
    n_docs: int


def _tokens(text, stop_words):
    # `isin` over many literals becomes a hash set lookup (InSet) per token
    return F.filter(tx.word_tokens_min2(text), lambda t: ~t.isin(*stop_words))


def fit_vocab(texts: DataFrame, text: str = "text", min_df: int = 2, max_features: int = 10000,
              stop_words=ENGLISH_STOP_WORDS) -> TfidfVocab:
    # equal texts are told by a hash, so texts aren't shuffled; the first row of each stays
    toks = texts.select(F.sha2(F.col(text), 256).alias("h"), _tokens(F.col(text), stop_words).alias("toks")).withColumn("row", F.monotonically_increasing_id())
    toks = materialize(toks, "tfidf-tokens")
    first = toks.groupBy("h").agg(F.min("row").alias("row"))
    n_docs = first.count()
    toks = toks.join(first.select("row"), "row", "left_semi").select("toks")
    tot = toks.select(F.explode("toks").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf_total"))
    dfs = (toks.select(F.explode(F.array_distinct("toks")).alias("term"))
               .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    cand = dfs.where(F.col("df") >= min_df).join(tot, "term")
    # global top-k of a vocabulary: TakeOrderedAndProject keeps at most max_features rows per task
    kept = cand.orderBy(F.desc("tf_total"), F.asc("term")).limit(max_features)
    idf = kept.select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    idf = idf.withColumn("term_index", F.row_number().over(Window.orderBy("term")) - 1)
    return TfidfVocab(materialize(idf, "tfidf-vocab"), n_docs)


def weights(df: DataFrame, key: str, text: str, vocab: TfidfVocab,
            stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """V2: (key, term, weight) with raw count x idf, rows L2-normalised; out-of-vocabulary terms dropped."""
    occ = df.select(key, F.explode(_tokens(F.col(text), stop_words)).alias("term"))
    idf = F.broadcast(vocab.idf.select("term", "idf", "term_index"))   # at most max_features rows
    w = (occ.join(idf, "term").groupBy(key, "term", "idf", "term_index").agg(F.count(F.lit(1)).alias("cnt"))
            .select(key, "term", "term_index", (F.col("cnt") * F.col("idf")).alias("w")))
    # a text's terms are at most the vocabulary
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", "term_index", (F.col("w") / norm).alias("weight"))


def sparse_rows(df: DataFrame, key: str, text: str, vocab: TfidfVocab, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """(key, cols, vals): the weights of each text by column number of the vocabulary."""
    w = weights(df, key, text, vocab, stop_words).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term_index", "weight"))).alias("w"))
    return w.select(key, F.transform("w", lambda x: x["term_index"]).alias("cols"), F.transform("w", lambda x: x["weight"]).alias("vals"))


def cosine(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """V5: cosine of two L2-normalised weight tables sharing ``key`` (0 when a side is empty)."""
    dot = (a.alias("a").join(b.alias("b"), [key, "term"])
             .groupBy(key).agg(F.sum(F.col("a.weight") * F.col("b.weight")).alias("cos")))
    return dot


# ---------------------------------------------------------------------------------
# V3 / V4 / V6: truncated SVD of the TF-IDF matrix and latent projection
# ---------------------------------------------------------------------------------

def fit_svd(docs: DataFrame, key: str, text: str, vocab: TfidfVocab, k: int) -> svd.Svd:
    """V3: uncentred truncated SVD of the L2-normalised TF-IDF rows of ``docs``; ``key`` is unique."""
    rows = materialize(sparse_rows(docs, key, text, vocab), "svd-rows")
    return svd.fit(rows, vocab.idf.count(), k)


def project(df: DataFrame, key: str, text: str, vocab: TfidfVocab, basis: svd.Svd) -> DataFrame:
    """V4: (key, x): latent coordinates of every text that has known terms."""
    return svd.project(sparse_rows(df, key, text, vocab), key, basis)


def latent_cosine(pairs: DataFrame, a: DataFrame, b: DataFrame, key_a: str, key_b: str, out: str) -> DataFrame:
    """V5: (key_a, out): cosine of the latent rows of each pair (key_a, key_b); 0 where a side has none."""
    j = pairs.select(key_a, key_b).join(a.select(key_a, F.col("x").alias("_a")), key_a, "left").join(b.select(key_b, F.col("x").alias("_b")), key_b, "left")
    return j.select(key_a, F.coalesce(vec_cosine(F.col("_a"), F.col("_b")), F.lit(0.0)).alias(out))
