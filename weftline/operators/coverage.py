"""Periods covered without interruption, and the gaps between them, by ranked boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from weftline.operators.lookup import all_null_safe
from weftline.operators.rank import sum_before
from weftline.session import cut

BUCKET = 1 << 15


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, width: float = BUCKET) -> DataFrame:
    """One row per period and per gap between successive periods: keys, kind ('period' or 'gap'), start, end.

    Starts and ends are sorted independently per key. Where the start of the next rank exceeds the end of a rank, a gap
    lies between the two; the k-th start of a period pairs with the k-th end. Equal boundaries are counted together
    before anything is shuffled, and ranks come from buckets of `width` (sum_before), so that a key with a third of all
    rows is spread over its buckets. The counts and the gaps are used several times, so both are written to the shared
    folder once.

    Intervals are half open. Those that overlap, nest or touch form one period. Rows with a missing (null, NaN) boundary
    or with end <= start are left out; a null key is a key of its own; an empty table gives no rows; copies change
    nothing; other columns are ignored.
    """
    keys = list(keys)
    s, e = F.col(start), F.col(end)
    if dict(df.dtypes)[start] in ("double", "float") or dict(df.dtypes)[end] in ("double", "float"):
        s, e = F.nanvl(s.cast("double"), F.lit(None)), F.nanvl(e.cast("double"), F.lit(None))
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    ks = [f"k{i}" for i in range(len(keys))]
    sides = df.select(*named, s.alias("s"), e.alias("e")).filter("s < e").select(*ks, F.posexplode(F.array("s", "e")).alias("side", "at"))
    counted = cut(sides.groupBy(*ks, "side", "at").agg(F.count(F.lit(1)).alias("n")))
    ranked = sum_before(counted, [*ks, "side"], "at", "n", width, "before")
    starts = ranked.filter("side = 0").select(*ks, F.col("at").alias("opens"), (F.col("before") + 1).alias("nth"))
    ends = ranked.filter("side = 1").select(*ks, F.col("at").alias("closes"), (F.col("before") + F.col("n") + 1).alias("nth"))
    found = ends.join(starts, all_null_safe(ends, starts, [*ks, "nth"]) & (starts["opens"] > ends["closes"]))
    holes = cut(found.select(*[ends[k] for k in ks], "closes", "opens"))
    outer = counted.groupBy(*ks).agg(F.min(F.when(F.col("side") == 0, F.col("at"))).alias("first"), F.max(F.when(F.col("side") == 1, F.col("at"))).alias("last"))
    bounds = (
        holes.select(*ks, F.posexplode(F.array("opens", "closes")).alias("side", "at"))
        .unionByName(outer.select(*ks, F.posexplode(F.array("first", "last")).alias("side", "at")))
        .withColumn("one", F.lit(1))
    )
    nth = sum_before(bounds, [*ks, "side"], "at", "one", width, "nth").drop("one")
    a, b = nth.filter("side = 0").withColumnRenamed("at", start), nth.filter("side = 1").withColumnRenamed("at", end)
    periods = a.join(b, all_null_safe(a, b, [*ks, "nth"])).select(*[a[k] for k in ks], F.lit("period").alias("kind"), start, end)
    gaps = holes.select(*ks, F.lit("gap").alias("kind"), F.col("closes").alias(start), F.col("opens").alias(end))
    both = periods.unionByName(gaps)
    return both.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "kind", start, end)
