"""Ranking metrics and distribution-free statistics from aggregates; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.operators.lookup import beside
from weftline.operators.sequences import running_sum

#: Cells of the range of values in which ranks are counted.
CELLS = 4096


def average_rank(value: str, keys: Sequence[str] = ()) -> Column:
    """Rank of a value; equal values share the mean of their ranks."""
    return F.rank().over(W.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / F.lit(2.0)


def average_ranks(df: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add average_rank by way of the distinct values' counts, so that ties meet before anything is sorted; and the values' range is cut into CELLS cells, each sorted on its own."""
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    ends = counts.agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    spread = F.greatest((F.col("__hi") - F.col("__lo")) / CELLS, F.lit(1e-300))
    celled = beside(counts, ends).withColumn("__at", F.floor((F.col(value) - F.col("__lo")) / spread).cast("double")).drop("__lo", "__hi")
    ranked = running_sum(celled, keys, ["__at", value], "__n", 1.0, "__upto")
    ranks = ranked.select(*keys, value, (F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, [*keys, value])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho: the correlation of average ranks; n. Rows with a null are left out."""
    own = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = average_ranks(average_ranks(own, "x", "rx"), "y", "ry")
    return ranked.agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def mann_whitney(df: DataFrame, group: str, value: str, first: object) -> DataFrame:
    """u of the rows whose group is `first` against all others, the share of pairs in which `first` is less (ties count half), n1, n2, z by the normal approximation, and its two-sided p; ties are corrected for."""
    own = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select((F.col(group) == F.lit(first)).alias("g"), F.col(value).alias("v"))
    sums = average_ranks(own, "v", "r").agg(F.sum(F.when(F.col("g"), F.col("r"))).alias("r1"), F.count_if("g").alias("n1"), F.count_if(~F.col("g")).alias("n2"))
    ties = own.groupBy("v").agg(F.count(F.lit(1)).alias("t")).agg(F.coalesce(F.sum(F.pow("t", F.lit(3)) - F.col("t")), F.lit(0.0)).alias("t3"))
    u, n, m = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n2"), F.col("n1") + F.col("n2")
    sd = F.sqrt(n / 12.0 * (m + 1 - F.col("t3") / F.nullif(m * (m - 1), F.lit(0))))
    told = beside(sums, ties).select(u.alias("u"), (1 - u / n).alias("p_less"), "n1", "n2", F.when(sd > 0, (u - n / 2) / sd).alias("z"))
    return told.withColumn("p", normal_p(F.col("z")))


def wilcoxon(df: DataFrame, difference: str) -> DataFrame:
    """w_plus of the signed ranks, n without zero differences, z by the normal approximation with tie correction, and its two-sided p."""
    own = df.filter(F.col(difference) != 0).select(F.col(difference).alias("d"), F.abs(difference).alias("a"))
    ties = own.groupBy("a").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("t3"))
    w = average_ranks(own, "a", "r").agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.coalesce("t3", F.lit(0.0)) / 48.0)
    return beside(w, ties).select("w_plus", "n", F.when(sd > 0, (F.col("w_plus") - n * (n + 1) / 4.0) / sd).alias("z")).withColumn("p", normal_p(F.col("z")))


def kendall(df: DataFrame, keys: Sequence[str], x: str, y: str, ident: str) -> DataFrame:
    """Kendall's tau-a per key: the mean sign of all pairs of rows. For short keys (the tokens of a sentence); pairs are within a key."""
    keys = list(keys)
    a, b = df.select(*keys, F.col(x).alias("xa"), F.col(y).alias("ya"), F.col(ident).alias("ia")), df.select(*keys, F.col(x).alias("xb"), F.col(y).alias("yb"), F.col(ident).alias("ib"))
    pairs = a.join(b, keys).filter("ia < ib")
    return pairs.groupBy(*keys).agg(F.avg(F.signum(F.col("xa") - F.col("xb")) * F.signum(F.col("ya") - F.col("yb"))).alias("tau"), F.count(F.lit(1)).alias("n_pairs"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share, within 0 and 1; null for n = 0."""
    n = F.nullif(n, F.lit(0))
    p = hits / n
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def first_hit(ranked: DataFrame, query: Sequence[str], rank: str, correct: str) -> DataFrame:
    """Per query the rank of the first correct candidate, null if none, and how many candidates there are."""
    return ranked.groupBy(*query).agg(F.min(F.when(F.col(correct), F.col(rank))).cast("long").alias("first_rank"), F.count(F.lit(1)).alias("n_candidates"))


def rank_report(hits: DataFrame, slices: Sequence[str] = ()) -> DataFrame:
    """top1, top5, mrr, median and mean rank over queries; chance is the median rank of a random order."""
    r = F.col("first_rank")
    share = lambda k: F.avg(F.coalesce(r <= k, F.lit(False)).cast("int"))
    return hits.groupBy(*slices).agg(
        F.count(F.lit(1)).alias("n"), share(1).alias("top1"), share(5).alias("top5"), F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"), F.median(r).alias("median_rank"),
        F.avg(r).alias("mean_rank"), F.avg((F.col("n_candidates") + 1) / 2.0).alias("chance_rank"),
    )


def null_rank_table(spark, n: int, c: int) -> DataFrame:
    """k, p: the chance that the least rank of c draws without replacement from 1..n exceeds k; and the null mean (n + 1) / (c + 1)."""
    rows = [(k, comb(n - k, c) / comb(n, c), (n + 1) / (c + 1)) for k in range(n - c + 1)]
    return spark.createDataFrame(rows, "k long, p double, null_mean double")


def normal_p(z: Column) -> Column:
    """The two-sided p value of a normal z, by the published polynomial for the error function (error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = F.lit(1.061405429)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + F.lit(c)
    return poly * t * F.exp(-x * x)


def safe_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "r") -> DataFrame:
    """Pearson's correlation per key on the rows that have both; 0 where a side hardly varies."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    flat = (F.stddev_pop(x) < 1e-9) | (F.stddev_pop(y) < 1e-9)
    return both.groupBy(*keys).agg(F.when(flat, F.lit(0.0)).otherwise(F.corr(x, y)).alias(out))
