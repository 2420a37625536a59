"""Landmark features, frame gates, decision rules and checks of an ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from weftline.functions import predicates as P
from weftline.operators import evaluation as E, tensor as L
from weftline.operators.lookup import beside, lookup_join
from weftline.plans.common import CLIPS, MAN, REV, SEG, clips, manifest, review, segments, six
from weftline.plans.evaluation import _EMB, _PAIR, p_sql, predicted, similarities
from weftline.plans.gates import _RATE, _REVI, review_issues
from weftline.plans.landmarks import _PTS, points
from weftline.plans.registry import CORE
from weftline.plans.spans import frame_rates

add = CORE.add


@add("q_valid_slice", f"with {_PTS}, e as (select video, min(frame) as f0 from p group by 1), s as (select p.video, frame from p join e using (video) where row_no = 0 and x is not null and frame >= greatest(0, f0 - 40) and frame < f0 + 200) select video, count(*) as n, count(*) >= 3 as usable from s group by 1")
def q_valid_slice(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a clamped window whose first feature is known, and whether they make a template (three or more)."""
    p = points(spark, d).filter("row_no = 0")
    e = p.groupBy("video").agg(F.min("frame").alias("f0"))
    s = L.valid_slice(lookup_join(p, e, ["video"], "inner"), "frame", F.col("f0") - 40, F.col("f0") + 200, "x")
    return s.groupBy("video").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= 3).alias("usable"))


_SIX = f"{_PTS}, f as (select video, frame, max(case when row_no = 1 then x end) as x1, max(case when row_no = 1 then y end) as y1, max(case when row_no = 2 then x end) as x2, max(case when row_no = 2 then y end) as y2, max(case when row_no = 3 then x end) as x3, max(case when row_no = 3 then y end) as y3, max(case when row_no = 4 then x end) as x4, max(case when row_no = 4 then y end) as y4 from p group by 1, 2), a as (select *, sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2)) as eye, sqrt(pow(x3 - x4, 2) + pow(y3 - y4, 2)) as gap from f)"


def apertures(spark: SparkSession, d: str) -> DataFrame:
    return L.apertures(points(spark, d), ["video"], (1, 2), (3, 4))


@add("q_apertures", f"with {_SIX} select video, frame, round(gap / nullif(eye, 0), 6) as aperture, coalesce(gap / nullif(eye, 0) < 0.9 or eye is null, true) as occluded from a")
def q_apertures(spark: SparkSession, d: str) -> DataFrame:
    """The distance of two points in eye distances, and whether a frame counts as occluded: too near, or no face."""
    return apertures(spark, d).select("video", "frame", six(F.col("aperture"), "aperture"), F.coalesce((F.col("aperture") < 0.9) | F.col("unit").isNull(), F.lit(True)).alias("occluded"))


@add("q_hand_to_mouth", f"with {_PTS}, m as (select video, frame, x as mx, y as my from p where row_no = 5 and x is not null), h as (select video, frame, x, y from p where row_no between 10 and 30 and x is not null) select h.video, h.frame, round(min(sqrt(pow(x - mx, 2) + pow(y - my, 2))), 6) as nearest from h join m using (video, frame) group by 1, 2")
def q_hand_to_mouth(spark: SparkSession, d: str) -> DataFrame:
    """How near any point of the hand comes to the mouth, per frame."""
    return L.nearest_point(points(spark, d), ["video"], (10, 31), 5).select("video", "frame", six(F.col("nearest"), "nearest"))


@add("q_series_score", f"with {_PTS}, c as (select video, row_no, case when stddev_pop(x) < 1e-9 or stddev_pop(y) < 1e-9 then 0 else corr(x, y) end as r from p where x is not null and y is not null group by 1, 2) select video, round(coalesce(sum(case when row_no = 3 then r when row_no = 4 then -r end), 0), 6) as score from c where row_no in (3, 4) group by 1")
def q_series_score(spark: SparkSession, d: str) -> DataFrame:
    """The correlation of two series minus that of two others, each on the samples both have; a constant series counts 0."""
    p = points(spark, d).filter("row_no in (3, 4)")
    r = E.safe_correlation(p, ["video", "row_no"], "x", "y")
    return r.groupBy("video").agg(six(F.coalesce(F.sum(F.when(F.col("row_no") == 3, F.col("r")).otherwise(-F.col("r"))), F.lit(0.0)), "score"))


@add("q_frame_coverage", f"with {_PTS} select video, max(frame) + 1 as n_frames, count(distinct case when row_no < 21 and x is not null then frame end) as n_hand, round(100.0 * count(distinct case when row_no < 21 and x is not null then frame end) / (max(frame) + 1), 1) as percent from p group by 1")
def q_frame_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Frames with a hand as a share of all up to the last, in percent."""
    p = points(spark, d)
    f = p.groupBy("video", "frame").agg(F.bool_or((F.col("row_no") < 21) & F.col("x").isNotNull()).alias("hand"))
    n = f.groupBy("video").agg((F.max("frame") + 1).alias("n_frames"), F.count_if("hand").alias("n_hand"))
    return n.withColumn("percent", F.round(F.lit(100.0) * F.col("n_hand") / F.col("n_frames"), 1))


@add("q_pose_check", f"with {_PTS}, f as (select video, frame, bool_or(x is not null and row_no < 2) as hand from p group by 1, 2) select video, round(avg(hand::int), 6) as share, avg(hand::int) < 0.5 as flagged from f group by 1")
def q_pose_check(spark: SparkSession, d: str) -> DataFrame:
    """The share of frames with a hand; videos below half are flagged."""
    c = L.coverage(points(spark, d), ["video"], (0, 2))
    return c.select("video", six(F.col("coverage"), "share"), (F.col("coverage") < 0.5).alias("flagged"))


@add("q_missing_points", f"with {_PTS} select video, round(avg((x is null)::int), 6) as missing from p group by 1")
def q_missing_points(spark: SparkSession, d: str) -> DataFrame:
    return L.missing_share(points(spark, d), ["video"]).select("video", six(F.col("missing"), "missing"))


@add("q_frame_map", f"with {_PTS} select video, frame, max(case when row_no = 3 then x end) as x3, max(case when row_no = 7 then y end) as y7 from p group by 1, 2")
def q_frame_map(spark: SparkSession, d: str) -> DataFrame:
    """Points of a frame as a map from row to point, and two of them looked up."""
    m = L.frame_maps(points(spark, d), ["video"])
    return m.select("video", "frame", F.col("points")[3]["x"].alias("x3"), F.col("points")[7]["y"].alias("y7"))


@add("q_body_frame", f"with {_PTS}, m as (select video, avg(x) as cx, avg(y) as cy from (select video, frame, (max(case when row_no = 1 then x end) + max(case when row_no = 2 then x end)) / 2 as x, (max(case when row_no = 1 then y end) + max(case when row_no = 2 then y end)) / 2 as y, sqrt(pow(max(case when row_no = 1 then x end) - max(case when row_no = 2 then x end), 2) + pow(max(case when row_no = 1 then y end) - max(case when row_no = 2 then y end), 2)) as w from p group by 1, 2) where x is not null and w > 1e-6 group by 1), w as (select video, avg(w) as w from (select video, frame, sqrt(pow(max(case when row_no = 1 then x end) - max(case when row_no = 2 then x end), 2) + pow(max(case when row_no = 1 then y end) - max(case when row_no = 2 then y end), 2)) as w from p group by 1, 2) where w > 1e-6 group by 1) select p.video, frame, row_no::int as row_no, round(coalesce((x - cx) / w, 0), 5) as x from p join m using (video) join w using (video) where row_no < 4")
def q_body_frame(spark: SparkSession, d: str) -> DataFrame:
    """Points relative to the middle of the shoulders, in shoulder widths."""
    moved = L.body_frame(points(spark, d), ["video"], shoulders=(1, 2))
    return moved.filter("row_no < 4").select("video", "frame", F.col("row_no").cast("int").alias("row_no"), F.round("x", 5).alias("x"))


@add("q_best_region", f"with {SEG}, c as (select video, version, avg(hand_coverage) as rate from seg where hand_coverage is not null group by 1, 2), r as (select *, row_number() over (partition by video order by rate + case when version = 'segments' then 0.05 else 0 end desc, version) as rn from c) select video, version as region from r where rn = 1")
def q_best_region(spark: SparkSession, d: str) -> DataFrame:
    """The version of the greatest mean coverage, with a bonus for the first."""
    c = segments(spark, d).filter("hand_coverage is not null").groupBy("video", "version").agg(F.avg("hand_coverage").alias("rate"))
    return L.best_region(c, ["video"], "version", "rate", F.when(F.col("version") == "segments", 0.05).otherwise(0.0)).select("video", F.col("version").alias("region"))


@add("q_unmirror", f"with {_PTS} select video, frame, row_no::int as row_no, case when video::bigint % 2 = 0 then 1 - x else x end as x from p where row_no < 3")
def q_unmirror(spark: SparkSession, d: str) -> DataFrame:
    """Points flipped back where the file is labelled left."""
    p = points(spark, d).filter("row_no < 3").withColumn("side", F.when(F.col("video").cast("long") % 2 == 0, "left").otherwise("right"))
    return L.unmirror(p, "side").select("video", "frame", F.col("row_no").cast("int").alias("row_no"), "x")


_FLAG = f"{_REVI}, fl as (select video, array_to_string(list_sort(list(distinct kind)), ',') as flags, count(distinct kind) as n from review_issues group by 1)"


@add("q_flags", f"with {_FLAG} select video, flags, n, n = len(string_split(flags, ',')) as round_trip from fl")
def q_flags(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of issues of a video as one text, and as many when it is taken apart again."""
    f = review_issues(spark, d).groupBy("video").agg(F.array_sort(F.collect_set("kind")).alias("a"))
    joined = f.select("video", F.array_join("a", ",").alias("flags"), F.size("a").cast("long").alias("n"))
    return joined.withColumn("round_trip", F.col("n") == F.size(F.split("flags", ",")))


@add("q_format_split", f"with {REV}, k as (select distinct source, lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) as ext from rev where file is not null) select source, array_to_string(list_sort(list(case when ext = 'mp4' then 'video' when ext in ('npz', 'npy') then 'array' else 'other' end)), ',') as kinds, count_if(ext <> 'mp4')::bigint as n_other from k group by 1")
def q_format_split(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of files a source names, and how many extensions it has that aren't the expected one."""
    ext = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    k = review(spark, d).filter("file is not null").select("source", ext.alias("ext"), P.file_kind(F.col("file")).alias("kind")).distinct()
    return k.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"), F.count_if(F.col("ext") != "mp4").alias("n_other"))


@add("q_container_mismatch", f"with {SEG}, {MAN}, {_RATE}, c as (select video, max(end_sec) as dur, max(end_frame) as frames from seg group by 1) select video, abs(dur - frames / nullif(fps, 0)) > 0.01 * greatest(dur, frames / nullif(fps, 0)) as mismatch from c join rate using (video) where dur is not null and frames is not null and fps > 0")
def q_container_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Whether a video's length in seconds and in frames over its rate agree to a hundredth."""
    c = segments(spark, d).groupBy("video").agg(F.max("end_sec").alias("dur"), F.max("end_frame").alias("frames"))
    both = lookup_join(c, frame_rates(manifest(spark, d)).select("video", (F.col("num") / F.col("den")).alias("fps")), ["video"], "inner").filter("dur is not null and frames is not null and fps > 0")
    return both.select("video", P.container_mismatch(F.col("dur"), F.col("frames"), F.col("fps")).alias("mismatch"))


@add("q_presence_hours", f"with {SEG}, t as (select video, round((end_sec - start_sec) * 1000)::bigint as dur, coalesce(hand_coverage >= 0.6, false) and round((end_sec - start_sec) * 1000) >= 2000 as kept from seg where end_sec > start_sec) select video, count(*) as n_before, round(sum(dur)::double / 3600000, 9) as hours_before, count_if(kept)::bigint as n_after, round(coalesce(sum(case when kept then dur end), 0)::double / 3600000, 9) as hours_after from t group by 1")
def q_presence_hours(spark: SparkSession, d: str) -> DataFrame:
    """Segments and hours of each video before and after the presence rule."""
    s = segments(spark, d).filter("end_sec > start_sec").withColumn("dur", F.round((F.col("end_sec") - F.col("start_sec")) * 1000).cast("long")).withColumn("kept", P.eligible(F.col("dur"), F.col("hand_coverage"), 2000, 0.6))
    return s.groupBy("video").agg(F.count(F.lit(1)).alias("n_before"), F.round(F.sum("dur") / 3600000, 9).alias("hours_before"), F.count_if("kept").alias("n_after"), F.round(F.coalesce(F.sum(F.when(F.col("kept"), F.col("dur"))), F.lit(0)) / 3600000, 9).alias("hours_after"))


@add("q_ingest_checks", f"with {CLIPS}, {REV}, c as (select 'leaked_ids' as kind, count_if(file not in (select file from clips))::bigint as n_bad, count(*) as n from rev where file is not null union all select 'missing_word', count_if(word is null)::bigint, count(*) from clips union all select 'accent_round_trip', count_if(encode(word)::varchar is null)::bigint, count(*) from clips union all select 'no_time', count_if(word_start is null and video_start is null)::bigint, count(*) from clips) select kind, n, n_bad, case when n_bad = 0 then 'PASS' else 'FAIL' end as status from c")
def q_ingest_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks of what was loaded, each with how many rows it looked at and how many fail it."""
    c, r = clips(spark, d), review(spark, d).filter("file is not null")
    check = lambda df, kind, bad: df.agg(F.lit(kind).alias("kind"), F.count_if(bad).alias("n_bad"), F.count(F.lit(1)).alias("n"))
    known = r.join(c.select("file", F.lit(True).alias("there")), "file", "left")
    word = F.col("word")
    every = check(known, "leaked_ids", F.col("there").isNull()).unionByName(check(c, "missing_word", word.isNull())).unionByName(check(c, "accent_round_trip", F.decode(F.encode(word, "UTF-8"), "UTF-8") != word)).unionByName(check(c, "no_time", F.expr("word_start is null and video_start is null")))
    return every.select("kind", "n", "n_bad", F.when(F.col("n_bad") == 0, "PASS").otherwise("FAIL").alias("status"))


_SIGNED = f"{_PAIR}, dd as (select abs(p0 - t0) as err, abs((p0 + p1) / 2 - (t0 + t1) / 2) as other, p1 - p0 as span, t1 - t0 as was from t), df as (select err - other as df, abs(err - other) as a from dd where err <> other), rk as (select df, a, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as r from df), ti as (select coalesce(sum(n * n * n - n), 0)::double as t3 from (select count(*)::double as n from df group by a)), wp as (select coalesce(sum(case when df > 0 then r end), 0)::double as w_plus, count(*) as n from rk), z as (select w_plus, n, (w_plus - n * (n + 1) / 4.0) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - t3 / 48.0), 0) as z from wp, ti)"


@add("q_paired_rule", f"with {_SIGNED}, m as (select median(err) as before, median(other) as after, median(was) as span_before, median(span) as span_after from dd) select n, round(before, 6) as before, round(after, 6) as after, round({p_sql('z')}, 6) as p, after < before and {p_sql('z')} < 0.05 and span_after <= 1.1 * span_before as adopt from z, m")
def q_paired_rule(spark: SparkSession, d: str) -> DataFrame:
    """The decision on a second way to align: the median error falls, the signed ranks say p < .05, and spans grow by a tenth at most."""
    t = predicted(spark, d).select(F.abs(F.col("p0") - F.col("t0")).alias("err"), F.abs((F.col("p0") + F.col("p1")) / 2 - (F.col("t0") + F.col("t1")) / 2).alias("other"), (F.col("p1") - F.col("p0")).alias("span"), (F.col("t1") - F.col("t0")).alias("was"))
    w = E.wilcoxon(t.withColumn("df", F.col("err") - F.col("other")), "df")
    m = t.agg(F.median("err").alias("before"), F.median("other").alias("after"), F.median("was").alias("span_before"), F.median("span").alias("span_after"))
    both = beside(w, m)
    adopt = (F.col("after") < F.col("before")) & (F.col("p") < 0.05) & (F.col("span_after") <= 1.1 * F.col("span_before"))
    return both.select("n", six(F.col("before"), "before"), six(F.col("after"), "after"), six(F.col("p"), "p"), adopt.alias("adopt"))


_HITS = f"{_EMB}, f as (select query, min(case when ol = ql then rn end) as first_rank, max(case when ol <> ql then sim end) as rival from r group by 1)"


@add("q_conditional", f"with {_HITS}, g as (select *, rank() over (order by first_rank) + (count(*) over (partition by first_rank) - 1) / 2.0 as ra, rank() over (order by rival) + (count(*) over (partition by rival) - 1) / 2.0 as rb from f where first_rank is not null and rival is not null) select count_if(first_rank <= 3)::bigint as n_near, round(avg(case when first_rank <= 3 then rival end), 6) as near_rival, round(avg(case when first_rank > 3 then rival end), 6) as far_rival, round(corr(ra, rb), 6) as rho from g")
def q_conditional(spark: SparkSession, d: str) -> DataFrame:
    """The best rival of queries that were found among the first three against that of the others, and the rank correlation."""
    ranked = similarities(spark, d).withColumn("rn", F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "other")))
    f = ranked.groupBy("query").agg(F.min(F.when(F.col("ol") == F.col("ql"), F.col("rn"))).alias("first_rank"), F.max(F.when(F.col("ol") != F.col("ql"), F.col("sim"))).alias("rival")).filter("first_rank is not null and rival is not null")
    m = f.agg(F.count_if(F.col("first_rank") <= 3).alias("n_near"), six(F.avg(F.when(F.col("first_rank") <= 3, F.col("rival"))), "near_rival"), six(F.avg(F.when(F.col("first_rank") > 3, F.col("rival"))), "far_rival"))
    return beside(m, E.spearman(f, "first_rank", "rival").select(six(F.col("rho"), "rho")))


@add("q_shift_verdict", f"with {_PAIR}, m as (select video, median(p0 - t0) as shift, quantile_cont(p0 - t0, 0.75) - quantile_cont(p0 - t0, 0.25) as spread from t group by 1) select video, case when abs(shift) < 0.05 then 'NO-OP' when abs(shift) >= 0.5 and spread < 1.0 then 'WORKING' when spread >= 1.0 then 'NOISY' else 'UNCLEAR' end as verdict from m")
def q_shift_verdict(spark: SparkSession, d: str) -> DataFrame:
    """What a flat shift of a video's segments does."""
    q = predicted(spark, d).groupBy("video").agg(F.percentile(F.col("p0") - F.col("t0"), [0.25, 0.5, 0.75]).alias("q"))
    return q.select("video", P.shift_verdict(F.col("q")[1], F.col("q")[2] - F.col("q")[0]).alias("verdict"))


@add("q_go_verdict", f"with {REV}, c as (select source, count_if(verdict = 'y')::double as h, count_if(verdict in ('y', 'n'))::double as n from rev group by 1), w as (select source, h, n, h / n as p, 1.96 * 1.96 as zz from c where n > 0), i as (select source, (p + zz / (2 * n)) / (1 + zz / n) as c, 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n) as h from w) select source, case when c - h > 0.5 then 'GO' when c + h < 0.5 then 'NO-GO' else 'INCONCLUSIVE' end as verdict from i")
def q_go_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether the interval of a source's share of hits lies above or below chance."""
    c = review(spark, d).groupBy("source").agg(F.count_if(F.col("verdict") == "y").alias("h"), F.count_if(F.col("verdict").isin("y", "n")).alias("n")).filter("n > 0")
    lo, hi = E.wilson(F.col("h"), F.col("n"))
    return c.select("source", P.go_verdict(lo, hi, F.lit(0.5)).alias("verdict"))


@add("q_chunk_status", f"with {SEG} select file, version, video, case when coalesce(end_frame < start_frame, false) then 'error' when coalesce(n_frames, 0) < 60 then 'end_of_audio' else 'ok' end as status from seg")
def q_chunk_status(spark: SparkSession, d: str) -> DataFrame:
    """Pieces that failed, that were empty, and that are fine, in this order."""
    return segments(spark, d).select("file", "version", "video", P.chunk_status(F.coalesce(F.col("end_frame") < F.col("start_frame"), F.lit(False)).cast("int"), F.coalesce("n_frames", F.lit(0)), 60).alias("status"))
