"""Ranks and running sums within a key that don't put a whole key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from weftline.operators.lookup import all_null_safe


def sum_before(df: DataFrame, keys: Sequence[str], value: str, weight: str, width: float, out: str) -> DataFrame:
    """Add, as `out`, the sum of `weight` over the rows of the same keys with a smaller `value`.

    df must have one row per (keys, value). The key's range of values is cut into buckets of `width`; only a bucket is
    sorted in one task, and the buckets' totals are summed per key. With whole numbers a bucket has at most `width`
    rows, and a key's list of buckets has range / width rows, however many rows the key holds.
    """
    keys = list(keys)
    df = df.withColumn("__bucket", F.floor(F.col(value) / F.lit(width)).cast("long"))
    inner = W.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    total = df.groupBy(*keys, "__bucket").agg(F.sum(weight).alias("__w")).withColumn("__off", F.coalesce(F.sum("__w").over(outer), F.lit(0))).drop("__w")
    part = df.withColumn("__in", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    both = part.join(total, all_null_safe(part, total, [*keys, "__bucket"]), "inner")
    return both.select(*[part[c] for c in df.columns if c != "__bucket"], (F.col("__in") + F.col("__off")).cast("long").alias(out))
