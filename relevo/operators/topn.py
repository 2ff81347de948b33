"""Top-n rows per group, safe for a group that holds a large share of all rows.

A plain ``row_number() over (partition by g order by ...)`` sorts every row of a
group inside one task. Here rows are first spread over ``salt`` sub-groups by a
hash of a tie-break key; each sub-group keeps its own top n (so at most
``salt * n`` rows per group survive), and a second window picks the final n.
The result is exact: a row in the global top n is in its sub-group's top n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group_cols, order_cols: list[Column], n: int,
                    salt_cols=None, salt: int = 16, rank_col: str = "rank") -> DataFrame:
    group_cols = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    if salt and salt > 1 and salt_cols:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_cols), F.lit(salt)))
        w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
        df = (salted.withColumn("_r1", F.row_number().over(w1))
                    .where(F.col("_r1") <= n).drop("_r1", "_salt"))
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows. Counted in every partition; no row moves to another task."""
    return df.count() <= max_rows
