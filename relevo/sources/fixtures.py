"""Map the driver tables onto the relevance data model.

The source system reads product, attribute, train and test tables; the driver
tables carry the same shapes under other names. These derivations are pure
projections and joins (no sampling), so every fixture grows with its table.

products     documents:  product_uid, product_title (the text's first line, complete), product_description
attributes   documents:  name/value rows per product in position order; some products have none, some two brands
pairs        labels, documents and conversations: searches are the opening messages of conversations,
             each asked for several products, and some products met by two searches
queries      benchmark:  whole texts, whose passages occur inside documents
part_*       part:       short ASCII catalog and misspelled queries
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.sources import tables as T

BRAND_NAME = "MFG Brand Name"


def _first_line(c: str):
    return F.split(F.col(c), "\n")[0]


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.documents(spark, sf_dir, ("doc_id", "text"))
    return d.select(F.col("doc_id").alias("product_uid"),
                    _first_line("text").alias("product_title"),
                    F.col("text").alias("product_description"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute rows (product_uid, pos, name, value).

    Some products have no rows at all, some no brand row, some two, and some values
    are NULL, so the fills, drops and imputations of the assembly step have work to do.
    """
    d = T.documents(spark, sf_dir, ("doc_id", "lang", "source", "n_chars")).where(F.col("doc_id") % 13 != 0)
    lang = d.select(F.col("doc_id").alias("product_uid"), F.lit(1).alias("pos"),
                    F.lit("Language").alias("name"),
                    F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("string"))
                     .otherwise(F.col("lang")).alias("value"))
    size = d.select(F.col("doc_id").alias("product_uid"), F.lit(2).alias("pos"),
                    F.lit("Size").alias("name"), F.col("n_chars").cast("string").alias("value"))
    brand = (d.where(F.col("doc_id") % 7 != 0)
              .select(F.col("doc_id").alias("product_uid"), F.lit(3).alias("pos"),
                      F.lit(BRAND_NAME).alias("name"), F.col("source").alias("value")))
    second = (d.where(F.col("doc_id") % 17 == 0)
               .select(F.col("doc_id").alias("product_uid"), F.lit(4).alias("pos"),
                       F.lit(BRAND_NAME).alias("name"), F.concat(F.col("source"), F.lit(" "), F.col("lang")).alias("value")))
    return lang.unionByName(size).unionByName(brand).unionByName(second)


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(search_id, search_term): the opening message of every conversation, whole."""
    return T.conversations(spark, sf_dir).where("turn = 0").select(F.col("conv_id").alias("search_id"), F.col("text").alias("search_term"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled pairs: id, product_uid, product_title, search_term, relevance, is_train.

    A labelled product meets search ``doc_id mod n``, and every third one search ``7 doc_id + 3 mod n`` too.
    """
    s = searches(spark, sf_dir)
    n = (s.agg(F.max("search_id")).first()[0] or 0) + 1
    met = F.array(F.struct(F.lit(0).alias("k"), (F.col("doc_id") % n).alias("search_id")),
                  F.struct(F.lit(1).alias("k"), ((F.col("doc_id") * 7 + 3) % n).alias("search_id")))
    l = (T.labels(spark, sf_dir).select("doc_id", "quality", "toxic", F.explode(met).alias("m"))
          .where((F.col("m.k") == 0) | (F.col("doc_id") % 3 == 0))
          .select("*", (F.col("doc_id") * 2 + F.col("m.k")).alias("id"), F.col("m.search_id").alias("search_id")))
    d = T.documents(spark, sf_dir, ("doc_id", "text")).select("doc_id", _first_line("text").alias("product_title"))
    return (l.join(s, "search_id").join(d, "doc_id")
             .select("id", F.col("doc_id").alias("product_uid"), "product_title", "search_term",
                     (F.lit(1.0) + F.col("quality") + (F.lit(1) - F.col("toxic"))).cast("double")
                      .alias("relevance"),
                     (F.col("id") % 5 != 0).alias("is_train")))


def train(spark, sf_dir):
    return pairs(spark, sf_dir).where("is_train").drop("is_train")


def test(spark, sf_dir):
    return pairs(spark, sf_dir).where("NOT is_train").drop("is_train", "relevance")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = T.benchmark(spark, sf_dir)
    return b.select(F.col("item_id").alias("query_id"), "text")


def part_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.part(spark, sf_dir)
    return p.select(F.col("p_partkey").alias("product_uid"),
                    F.col("p_name").alias("product_title"),
                    F.col("p_brand").alias("brand"),
                    F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("product_description"))


# --- fixed values: the four typo rules applied to every distinct part name -----
TYPO_RULES = ("drop2", "swap23", "double_last", "q_first")
# --------------------------------------------------------------------------------


def part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct part name under four typo rules (query_id, rule, truth, text)."""
    n = T.part(spark, sf_dir, ("p_name",)).select(F.col("p_name").alias("truth")).distinct()
    s = F.col("truth")
    typos = F.array(
        F.struct(F.lit("drop2").alias("rule"), F.concat(F.substring(s, 1, 1), F.expr("substring(truth, 3)")).alias("text")),
        F.struct(F.lit("swap23").alias("rule"), F.concat(F.substring(s, 1, 1), F.substring(s, 3, 1), F.substring(s, 2, 1), F.expr("substring(truth, 4)")).alias("text")),
        F.struct(F.lit("double_last").alias("rule"), F.concat(s, F.expr("substring(truth, -1, 1)")).alias("text")),
        F.struct(F.lit("q_first").alias("rule"), F.concat(F.lit("q"), F.expr("substring(truth, 2)")).alias("text")),
    )
    out = n.select("truth", F.explode(typos).alias("t")).select("truth", "t.rule", "t.text")
    return out.withColumn("query_id", F.concat_ws("|", "rule", "truth"))


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.embeddings(spark, sf_dir)
    return e.select(F.col("vec_id").alias("word_id"),
                    F.col("embedding").cast("array<double>").alias("vector"),
                    F.col("label").alias("sentence_id"))
