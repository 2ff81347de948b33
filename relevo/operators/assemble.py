"""Catalog and pair assembly (R7 and the modelling-table build).

All steps are joins and aggregations keyed by ``product_uid``:

* G1  ordered attribute text per product: ``collect_list(struct(pos, text))``, sorted
      by ``pos``, so the result never depends on partition order;
* J1-J3 left joins of descriptions, attribute text and brand rows;
* U1 + W1 train and test rows unioned, first row kept per product (train first);
* P10 brand imputation from the longest known brand among the title's first 4/3/2 words;
* P7/P8 fills with constants or from another column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevo.functions import text as tx
from relevo.operators.topn import fits
from relevo.session import materialize

BRAND_NAME = "MFG Brand Name"
BROADCAST_BRANDS = 1_000_000


def ordered_concat(rows: DataFrame, key: str, pos: str, value: Column, out: str,
                   sep: str = " ") -> DataFrame:
    """G1: one string per key, the values joined by ``sep`` in ``pos`` order."""
    agg = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), value.alias("v"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(agg, lambda x: x["v"]), sep).alias(out))


def attribute_text(attributes: DataFrame, fill_null: bool = True) -> DataFrame:
    """G1 over attribute rows: ``name + ' ' + value`` joined per product.

    ``fill_null=True`` treats NULL name/value as '' (catalog build); otherwise rows
    with any NULL are dropped first (modelling build, P2).
    """
    a = attributes.where(F.col("product_uid").isNotNull())
    if fill_null:
        nv = F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("value", F.lit("")))
    else:
        a = a.na.drop("any", subset=["product_uid", "name", "value"])
        nv = F.concat(F.col("name"), F.lit(" "), F.col("value"))
    return ordered_concat(a, "product_uid", "pos", nv, "combined_attr")


def attribute_text_rows(attributes: DataFrame) -> DataFrame:
    """The product's attribute text repeated on each of its attribute rows."""
    nv = F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("value", F.lit("")))
    w = (Window.partitionBy("product_uid").orderBy("pos")
         .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return attributes.select("product_uid", "pos", F.array_join(F.collect_list(nv).over(w), " ")
                             .alias("combined_attr"))


def brand_rows(attributes: DataFrame, dedupe: bool = True) -> DataFrame:
    """J3 input: ``(product_uid, brand)`` from the brand attribute rows.

    The source joins brand rows without deduplication; ``dedupe=True`` keeps the
    first brand row per product so a product never multiplies its pairs.
    """
    b = attributes.where(F.col("name") == BRAND_NAME).where(F.col("product_uid").isNotNull())
    if not dedupe:
        return b.select("product_uid", F.col("value").alias("brand"))
    return b.groupBy("product_uid").agg(F.min(F.struct("pos", "value"))["value"].alias("brand"))


def first_row_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keep the first row of each key under an explicit total (ascending) order.

    ``min(struct(order..., row...))`` is an aggregate, so it is pre-aggregated on the
    map side: a key holding a third of all rows costs one row per partition in the
    shuffle, where a ``row_number`` window would sort all of them in one task.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    best = df.groupBy(key).agg(F.min(F.struct(*[F.col(c) for c in order + rest])).alias("_b"))
    return best.select(key, *[F.col("_b")[c].alias(c) for c in order + rest]).select(*df.columns)


def impute_brand(catalog: DataFrame, title: str = "product_title", brand: str = "brand") -> DataFrame:
    """P10: NULL brand <- the longest of the title's first 4/3/2 words that is a known brand,
    else the first word (``error101`` for an empty title)."""
    known = catalog.where(F.col(brand).isNotNull()).select(F.col(brand).alias("cand")).distinct()
    if fits(known, BROADCAST_BRANDS):
        known = F.broadcast(known)
    missing = catalog.where(F.col(brand).isNull()).select(
        "product_uid", F.explode(F.array(*[
            F.struct(F.lit(n).alias("n"), tx.first_n_words(title, n).alias("cand"))
            for n in (4, 3, 2)])).alias("c")).select("product_uid", "c.n", "c.cand")
    best = (missing.join(known, "cand", "left_semi")
                   .groupBy("product_uid").agg(F.max(F.struct("n", "cand"))["cand"].alias("_imp")))
    out = catalog.join(best, "product_uid", "left")
    return out.withColumn(brand, F.coalesce(F.col(brand), F.col("_imp"),
                                            tx.first_n_words(title, 1))).drop("_imp")


def assemble_catalog(train: DataFrame, test: DataFrame, attributes: DataFrame,
                     descriptions: DataFrame, persist: bool = True) -> DataFrame:
    """One row per product with title, attribute text, brand, description and cleaned text.

    The unioned pair rows and the joined (pre-imputation) catalog are each read by
    several later steps; they are written once so the plan does not repeat the
    upstream joins for every reader.
    """
    cut = (lambda df, name: materialize(df, name)) if persist else (lambda df, name: df)
    cols = ["id", "product_uid", "product_title", "search_term"]
    both = cut(train.select(*cols, F.lit(0).alias("src"))
               .unionByName(test.select(*cols, F.lit(1).alias("src"))), "catalog-pairs")
    # attributes / brands only of products present (the source filters by hand; a semi join here)
    present = both.select("product_uid").distinct()
    attrs = attributes.join(present, "product_uid", "left_semi")
    at = attribute_text(attrs, fill_null=True)
    br = brand_rows(attrs, dedupe=True)
    desc = descriptions.select("product_uid", tx.split_glued_words("product_description")
                               .alias("product_description"))
    first = first_row_per_key(both, "product_uid", ["src", "id"])
    cat = (first.select("product_uid", "product_title")
                .join(at, "product_uid", "left")
                .join(br, "product_uid", "left")
                .join(desc, "product_uid", "left"))
    cat = impute_brand(cut(cat, "catalog-joined"))
    cat = cat.withColumn("combined_attr", F.coalesce("combined_attr", "product_description"))
    text = F.concat(F.col("product_title"), F.lit(" "), F.col("brand"), F.lit(" "), F.col("product_description"))
    return cat.select("product_uid", "product_title", "combined_attr", "brand", "product_description",
                      tx.clean_text(text).alias("text"))


def assemble_pairs(pairs: DataFrame, attributes: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Modelling table (notebook build): NULL attribute rows dropped, attribute summary,
    description and brand joined left, missing ones filled with ``NoAttribute`` / ``NoBrand``."""
    a = attributes.na.drop("any", subset=["product_uid", "name", "value"])
    summ = attribute_text(a, fill_null=False).withColumnRenamed("combined_attr", "attribute_summary")
    br = brand_rows(a, dedupe=True)
    out = (pairs.join(descriptions.select("product_uid", "product_description"), "product_uid", "left")
                .join(summ, "product_uid", "left")
                .join(br, "product_uid", "left"))
    return out.na.fill({"attribute_summary": "NoAttribute", "brand": "NoBrand"})


def relevance_class(score: Column) -> Column:
    """Nearest of the valid scores; a tie goes to the earlier value in the list."""
    # --- fixed values: valid relevance scores, in the source's order ------------
    valid = [3.00, 2.33, 2.67, 2.00, 1.67, 1.33, 1.00]
    # ------------------------------------------------------------------------------
    cands = F.array(*[F.struct(F.abs(score - F.lit(v)).alias("d"), F.lit(i).alias("i"), F.lit(v).alias("v"))
                      for i, v in enumerate(valid)])
    return F.array_min(cands)["v"]


def clip(c: Column, lo: float = 1.0, hi: float = 3.0) -> Column:
    """Clip predictions into [lo, hi]."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))
