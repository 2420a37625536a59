"""Data-quality gates: every rule gives issue rows, and issues roll up to a status."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

ISSUE = ("gate", "severity", "video", "seg", "kind", "detail")


def issue(df: DataFrame, when: Column, gate: str, severity: str, kind: str, video: str, seg: Column | str, detail: Column | str) -> DataFrame:
    """An issue row for each row for which `when` holds."""
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return df.filter(when).select(F.lit(gate).alias("gate"), F.lit(severity).alias("severity"), F.col(video).alias("video"), text(seg).alias("seg"), F.lit(kind).alias("kind"), text(detail).alias("detail"))


def issues_of(df: DataFrame, rules: Sequence[tuple[Column, str, str, Column]], gate: str, video: str, seg: Column | str) -> DataFrame:
    """Issues of several rules (condition, severity, kind, detail) over one pass of the rows."""
    found = F.array(*[F.when(F.coalesce(w, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(k).alias("kind"), d.cast("string").alias("detail"))) for w, s, k, d in rules])
    own = df.select(F.col(video).alias("video"), (F.col(seg) if isinstance(seg, str) else seg).cast("string").alias("seg"), F.explode(F.array_compact(found)).alias("i"))
    return own.select(F.lit(gate).alias("gate"), "i.severity", "video", "seg", "i.kind", "i.detail")


def all_issues(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def roll_up(issues: DataFrame, checked: DataFrame) -> DataFrame:
    """gate, n_checked, n_failed, n_flagged, status: HARD issues fail a gate, others flag it; SKIPPED where nothing was checked. checked: gate, n_checked."""
    n = issues.groupBy("gate").agg(F.count_if(F.col("severity") == "HARD").alias("n_failed"), F.count_if(F.col("severity") == "FLAG").alias("n_flagged"))
    both = checked.join(n, "gate", "left").fillna(0, ["n_failed", "n_flagged"])
    status = F.when(F.col("n_checked") == 0, "SKIPPED").when(F.col("n_failed") > 0, "FAIL").when(F.col("n_flagged") > 0, "FLAG").otherwise("PASS")
    return both.withColumn("status", status)


def overall(results: DataFrame, hard_gates: Sequence[str]) -> DataFrame:
    """exit_code 1 if a gate of hard_gates failed, else 0."""
    return results.agg(F.coalesce(F.max(((F.col("status") == "FAIL") & F.col("gate").isin(*hard_gates)).cast("int")), F.lit(0)).alias("exit_code"))
