"""Connected components of a link table, as alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevo.session import materialize


def _tangled(e: DataFrame) -> int:
    """Nodes that keep the links from being stars: they hang on several nodes, or hang on one and carry others."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("carries")).unionByName(
        e.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("carries")))
    return ends.groupBy("node").agg(F.sum("hangs").alias("h"), F.max("carries").alias("c")).where("h > 1 or (h > 0 and c > 0)").count()


def stars(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(u, v) for every node u of a link that is not the smallest node reachable, which is v.

    Each round joins the links with the least neighbour of each node, so a hub is one row of the
    aggregate and a join that Spark can split. Rounds end when the links are stars: as u > v in every link, each node
    then hangs on its smallest one. No links: no rows. Null ends are ignored.
    """
    e = materialize(links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc-links")
    while _tangled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v"))
        # every node is in some link (v, m) unless it is the least of its neighbourhood
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small, "cc-links")
    return e


def labels(e: DataFrame) -> DataFrame:
    """(node, component) for every node of ``stars``."""
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reachable."""
    return labels(stars(links, a, b))
