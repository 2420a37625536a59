"""Segments: periods covered without interruption and the gaps between them (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.catalog import table
from weftline.operators.coverage import periods_and_gaps
from weftline.operators.lookup import lookup_join
from weftline.plans.registry import CORE

RATE = r"\A *([0-9]+(?:\.[0-9]+)?)(?:/([0-9]+(?:\.[0-9]+)?))? *\z"


def frame_rates(manifest: DataFrame) -> DataFrame:
    """video, num, den: the frame rate of each video as a fraction. Of several rows of a video with sound rates the least counts; a rate that is no number, or nothing over nothing, is none."""
    num, den = F.regexp_extract("fps", RATE, 1).try_cast("double"), F.regexp_extract("fps", RATE, 2)
    parsed = manifest.select(F.col("id").alias("video"), num.alias("num"), F.when(den == "", F.lit(1.0)).otherwise(den.try_cast("double")).alias("den"))
    least = parsed.filter("num > 0 and den > 0").groupBy("video").agg(F.min(F.struct((F.col("num") / F.col("den")).alias("rate"), "num", "den")).alias("r"))
    return least.select("video", "r.num", "r.den")


def framed(segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """video, version, start_frame, end_frame: a missing frame is its seconds times the rate, rounded; where frames and seconds disagree, frames hold."""
    own = segments.select("video", "version", "start_frame", "end_frame", "start_sec", "end_sec").distinct()
    whole = own.filter("start_frame is not null and end_frame is not null")
    part = lookup_join(own.filter("start_frame is null or end_frame is null"), frame_rates(manifest), ["video"])
    of = lambda f, s: F.coalesce(f, F.round(F.nanvl(s, F.lit(None)) * F.col("num") / F.col("den")).cast("long")).alias(f)
    cols = ["video", "version", "start_frame", "end_frame"]
    return whole.select(*cols).unionByName(part.select("video", "version", of("start_frame", "start_sec"), of("end_frame", "end_sec")))


P2_SQL = """
with rates as (select id as video, min(try_cast(split_part(trim(fps), '/', 1) as double) / case when trim(fps) like '%/%' then try_cast(split_part(trim(fps), '/', 2) as double) else 1 end) as fps from manifest where trim(fps) <> '' group by 1),
f as (select s.video, version, coalesce(start_frame, cast(round(start_sec * fps) as bigint)) as a, coalesce(end_frame, cast(round(end_sec * fps) as bigint)) as b from segments s left join rates r on r.video = s.video),
ok as (select distinct * from f where a < b),
prev as (select *, max(b) over (partition by video, version order by a, b rows between unbounded preceding and 1 preceding) as pb from ok),
grp as (select *, sum(case when pb is null or a > pb then 1 else 0 end) over (partition by video, version order by a, b rows unbounded preceding) as g from prev),
per as (select video, version, g, min(a) as start_frame, max(b) as end_frame from grp group by 1, 2, 3)
select video, version, 'period' as kind, start_frame, end_frame from per
union all
select video, version, 'gap', pe, start_frame from (select *, lag(end_frame) over (partition by video, version order by start_frame) as pe from per) where pe is not null
"""


@CORE.add("p2_found", P2_SQL)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    frames = framed(table(spark, folder, "segments"), table(spark, folder, "manifest"))
    return periods_and_gaps(frames, ["video", "version"], "start_frame", "end_frame")
