"""Sets of keys, first-wins dimensions, field-wise merges and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def two_way(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str] = ("only_in_a", "only_in_b")) -> DataFrame:
    """Keys that only one side has, tagged; null keys are left out."""
    x, y = a.select(key).filter(F.col(key).isNotNull()).distinct(), b.select(key).filter(F.col(key).isNotNull()).distinct()
    return x.join(y, key, "left_anti").select(key, F.lit(names[0]).alias("side")).unionByName(y.join(x, key, "left_anti").select(key, F.lit(names[1]).alias("side")))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the order, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def merge_fields(new: DataFrame, old: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per key of either side; of each field the new value unless it is null or empty, else the old."""
    n = new.select(key, *[F.col(f).alias(f"__n_{f}") for f in fields])
    o = old.select(key, *[F.col(f).alias(f"__o_{f}") for f in fields])
    pick = lambda f: F.coalesce(F.nullif(F.col(f"__n_{f}"), F.lit("")), F.nullif(F.col(f"__o_{f}"), F.lit(""))).alias(f)
    return n.join(o, key, "full_outer").select(key, *[pick(f) for f in fields])


def upsert(new: DataFrame, old: DataFrame, key: str, keep_if_blank: Sequence[str] = ()) -> DataFrame:
    """old with the rows of new in place of those of the same key, ordered by key; a blank new value of keep_if_blank leaves the old one. Doing it twice changes nothing."""
    cols = [c for c in new.columns if c != key]
    n = new.select(key, F.lit(True).alias("__new"), *[F.col(c).alias(f"__n_{c}") for c in cols])
    o = old.select(key, *[F.col(c).alias(f"__o_{c}") for c in cols])

    def value(c: str):
        fresh = F.coalesce(F.nullif(F.col(f"__n_{c}"), F.lit("")), F.col(f"__o_{c}")) if c in keep_if_blank else F.col(f"__n_{c}")
        return F.when(F.col("__new"), fresh).otherwise(F.col(f"__o_{c}")).alias(c)

    return o.join(n, key, "full_outer").select(key, *[value(c) for c in cols]).orderBy(key)


def insert_new(new: DataFrame, old: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """old with the rows of new whose key it doesn't have yet; of several new rows with a key the first."""
    return old.unionByName(first_wins(new, [key], order).select(*old.columns).join(old.select(key), key, "left_anti"))


def prefer_version(df: DataFrame, keys: Sequence[str], version: str, precedence: Sequence[str]) -> DataFrame:
    """Only the rows of the strictest version each key has. precedence: from the least to the strictest."""
    rank = F.array_position(F.array(*[F.lit(v) for v in precedence]), F.col(version))
    top = df.groupBy(*keys).agg(F.max(rank).alias("__top"))
    return df.join(top, list(keys)).filter(rank == F.col("__top")).drop("__top")


def vocabulary(df: DataFrame, word: str, least: int) -> DataFrame:
    """word, id (from 0, in the words' order) and count of words seen at least so often."""
    counted = df.groupBy(word).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & F.col(word).isNotNull()).withColumn("__p", F.substring(word, 1, 2))
    # Words are ranked within their first two letters; only the list of these is sorted as a whole.
    before = counted.groupBy("__p").count().withColumn("__off", F.coalesce(F.sum("count").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    nth = F.row_number().over(W.partitionBy("__p").orderBy(word))
    return counted.withColumn("__n", nth).join(before, "__p").select(word, "n", (F.col("__off") + F.col("__n") - 1).cast("long").alias("id"))
