"""Joins by time: the neighbours before and after, nearest, as-of, and interval joins by buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.operators.lookup import all_null_safe


def _sound(df: DataFrame, time: str) -> Column:
    t = F.col(time)
    return t.isNotNull() & ~F.isnan(t) if dict(df.dtypes)[time] in ("double", "float") else t.isNotNull()


def neighbours(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, carry: Sequence[str], cell: float) -> DataFrame:
    """Each left row with the right rows of the same keys next to it in time: structs `before` (time <= its own) and `after` (time > its own), null where there is none.

    A struct has `t`, the right row's time, and the columns of `carry`. Of right rows at the same time the least by
    `carry` counts. Time is cut into cells: rows are sorted within a cell only, and each cell's first and last right
    row are carried over to later and earlier cells, so that no key is sorted in one task. Left rows without a time
    come out with null neighbours; copies of left rows stay copies; null keys meet null keys.
    """
    keys = list(keys)
    names = [f"k{i}" for i in range(len(keys))]
    ks = lambda df: [F.col(k).alias(n) for k, n in zip(keys, names)]
    of = F.struct(F.col("t"), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
    r = right.filter(_sound(right, right_time)).select(*ks(right), F.col(right_time).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    r = r.groupBy(*names, "t").agg(F.min(F.struct(*[f"c{i}" for i in range(len(carry))])).alias("c")).select(*names, "t", *[F.col(f"c.c{i}").alias(f"c{i}") for i in range(len(carry))])
    r = r.select(*names, "t", of.alias("r"), F.lit(0).alias("side"))
    timed = left.withColumn("__own", F.struct(*left.columns)).withColumn("__t", F.when(_sound(left, left_time), F.col(left_time)))
    lone = timed.filter("__t is null")
    own = timed.filter("__t is not null").select(*ks(timed), F.col("__t").alias("t"), F.col("__own").alias("l"), F.lit(1).alias("side"))
    every = r.withColumn("l", F.lit(None).cast(own.schema["l"].dataType)).unionByName(own.withColumn("r", F.lit(None).cast(r.schema["r"].dataType)))
    every = every.withColumn("cell", F.floor(F.col("t") / F.lit(cell)).cast("long"))
    inner = W.partitionBy(*names, "cell").orderBy("t", "side")
    seen = every.withColumn("b", F.last("r", True).over(inner.rowsBetween(W.unboundedPreceding, 0))).withColumn("a", F.first("r", True).over(inner.rowsBetween(0, W.unboundedFollowing)))
    cells = every.groupBy(*names, "cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    outer = W.partitionBy(*names).orderBy("cell")
    cells = cells.select(*names, "cell", F.last("hi", True).over(outer.rowsBetween(W.unboundedPreceding, -1)).alias("b0"), F.first("lo", True).over(outer.rowsBetween(1, W.unboundedFollowing)).alias("a0"))
    seen = seen.filter("side = 1")
    both = seen.join(cells, all_null_safe(seen, cells, [*names, "cell"]))
    got = both.select("l.*", F.coalesce("b", "b0").alias("before"), F.coalesce("a", "a0").alias("after"))
    none = F.lit(None).cast(r.schema["r"].dataType)
    return got.unionByName(lone.select("__own.*", none.alias("before"), none.alias("after")))


def asof_before(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, carry: Sequence[str], cell: float) -> DataFrame:
    """Left rows with `match`: the last right row at or before their time, null if none."""
    return neighbours(left, right, keys, left_time, right_time, carry, cell).withColumnRenamed("before", "match").drop("after")


def next_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, carry: Sequence[str], cell: float, limit: float) -> DataFrame:
    """Left rows with `match`: the first right row after their time and at most `limit` later, null if none."""
    near = neighbours(left, right, keys, left_time, right_time, carry, cell)
    return near.withColumn("match", F.when(F.col("after.t") - F.col(left_time) <= limit, F.col("after"))).drop("before", "after")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, carry: Sequence[str], cell: float, limit: float | None = None) -> DataFrame:
    """Left rows with `match`: the right row nearest in time, before or after; of two equally near the earlier."""
    near = neighbours(left, right, keys, left_time, right_time, carry, cell)
    db, da = F.col(left_time) - F.col("before.t"), F.col("after.t") - F.col(left_time)
    pick = F.when(F.col("after").isNull() | (db <= da), F.col("before")).otherwise(F.col("after"))
    near = near.withColumn("match", pick).drop("before", "after")
    return near if limit is None else near.withColumn("match", F.when(F.abs(F.col("match.t") - F.col(left_time)) <= limit, F.col("match")))


def in_interval(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Points joined with the spans of the same keys with start <= time <= end: an equi-join on time buckets of `width`, to which each span is spread.

    A span gives a row per bucket it touches, a point one; so no pair is looked at that doesn't share a bucket. Choose
    width near the usual length of spans. Spans turned round or without an end match nothing. how: inner or left_semi.
    """
    keys = list(keys)
    at = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    s = spans.filter(F.col(start) <= F.col(end)).withColumn("__b", F.explode(F.sequence(at(start), at(end))))
    p = points.withColumn("__b", at(time))
    joined = p.join(s, [*keys, "__b"]) if how == "inner" else None
    if how == "inner":
        return joined.filter((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("__b")
    cond = F.lit(True)
    for k in [*keys, "__b"]:
        cond = cond & (p[k] == s[k])
    return p.join(s, cond & (p[time] >= s[start]) & (p[time] <= s[end]), "left_semi").drop("__b")


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], a_span: tuple[str, str], b_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs of spans of the same keys that share more than a point, once each, with `overlap`, their common length.

    Both sides are spread over buckets of `width`; of the buckets a pair shares only the first, in which the later of
    the two begins, gives the pair. Column names beside the keys must differ between the sides.
    """
    keys = list(keys)
    (a0, a1), (b0, b1) = a_span, b_span
    at = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    x = a.filter(F.col(a0) < F.col(a1)).withColumn("__b", F.explode(F.sequence(at(a0), at(a1))))
    y = b.filter(F.col(b0) < F.col(b1)).withColumn("__b", F.explode(F.sequence(at(b0), at(b1))))
    lo, hi = F.greatest(a0, b0), F.least(a1, b1)
    both = x.join(y, [*keys, "__b"]).filter((lo < hi) & (F.floor(lo / F.lit(width)).cast("long") == F.col("__b")))
    return both.withColumn("overlap", hi - lo).drop("__b")
