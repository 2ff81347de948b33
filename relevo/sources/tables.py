"""Readers for the input tables.

Every reader selects only the columns it needs, so the parquet scan's
``ReadSchema`` is pruned and later filters push down into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Give CPU-heavy text work at least one partition per core.

    A small file with one row group scans as one task; on a cluster the scan
    already yields many more partitions than cores and this is a no-op, so the
    extra shuffle only happens where it pays for itself. Spreading by ``key``
    (hash) lets later per-key aggregations reuse the partitioning.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key) if key else df.repartition(cores)
    return df


def documents(spark, sf_dir, columns=("doc_id", "text", "lang", "source", "n_chars")):
    df = read_table(spark, sf_dir, "documents", list(columns))
    return spread(df, "doc_id") if "text" in columns else df


def labels(spark, sf_dir):
    return read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])


def benchmark(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark", ["item_id", "text"])


def conversations(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])


def part(spark, sf_dir, columns=("p_partkey", "p_name", "p_brand", "p_type")):
    return read_table(spark, sf_dir, "part", list(columns))


def embeddings(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
