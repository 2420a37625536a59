"""Top-k, quotas, strata and seeded samples, all without a random generator: the same rows give the same sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.operators.lookup import beside
from weftline.operators.sequences import numbered


def cap(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each key. Spark keeps n rows per key and task before it shuffles."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def round_robin(df: DataFrame, group: str, stratum: str, order: Sequence[str], quota: int) -> DataFrame:
    """Up to `quota` rows of each group, one of each stratum in turn; larger strata first. Adds `pick`, the place in the turn."""
    size = df.groupBy(group, stratum).agg(F.count(F.lit(1)).alias("__size"))
    rows = cap(df, [group, stratum], order, quota).withColumn("__rn", F.row_number().over(W.partitionBy(group, stratum).orderBy(*order)))
    turn = W.partitionBy(group).orderBy("__rn", F.desc("__size"), stratum)
    return rows.join(size, [group, stratum]).withColumn("pick", F.row_number().over(turn)).filter(F.col("pick") <= quota).drop("__rn", "__size")


def seeded(df: DataFrame, keys: Sequence[str], ident: str, n: int, seed: int) -> DataFrame:
    """n rows of each key in the order of a seeded hash: a sample without replacement that doesn't depend on partitions."""
    return cap(df, keys, [F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(ident).cast("string"))), ident], n)


def resampled(df: DataFrame, group: str, ident: str, keep: Column, size: int, reps: int, seed: int) -> DataFrame:
    """`reps` subsets of `size` rows of each group, the rows for which `keep` holds always among them. Adds rep."""
    many = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    return cap(many, [group, "rep"], [F.when(keep, 0).otherwise(1), F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("rep").cast("string"), F.col(ident).cast("string"))), ident], size)


def quota_fill(df: DataFrame, prefer: Column, order: Sequence[str], n: int, cell: float = 1 << 16) -> DataFrame:
    """n rows: the preferred first, topped up with an even stride through the others in their order."""
    marked = df.withColumn("__p", F.when(prefer, 0).otherwise(1))
    share = marked.agg(F.count_if(F.col("__p") == 0).alias("a"), F.count_if(F.col("__p") == 1).alias("b"))
    step = F.greatest(F.lit(1), F.floor(F.col("b") / F.greatest(F.lit(1), n - F.col("a"))))
    ranked = beside(numbered(marked, ["__p"], order, cell, "__i").withColumn("__i", F.col("__i") - 1), share).withColumn("__s", F.when(F.col("__p") == 0, 0).otherwise((F.col("__i") % step != 0).cast("int")))
    return ranked.orderBy("__p", "__s", "__i").limit(n).drop("__p", "__i", "a", "b", "__s")
