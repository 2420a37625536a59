"""The ladder of data-quality gates on the tables, its roll-up, and the flagship on the event feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.catalog import table
from weftline.operators.gates import all_issues, issues_of, overall, roll_up
from weftline.operators.lookup import lookup_join
from weftline.operators.sequences import lag_in_cells, longest_run
from weftline.plans.common import ASR, CLIPS, EV, MAN, REV, SEG, clips, events, heard, manifest, review, segments
from weftline.plans.registry import CORE
from weftline.session import cut
from weftline.plans.sheets import JUDGED_SQL, loaded
from weftline.plans.spans import frame_rates

add = CORE.add
HARD_GATES = ("integrity", "temporal")
_RATE = "rate as (select id as video, try_cast(split_part(trim(fps, ' '), '/', 1) as double) / case when fps like '%/%' then try_cast(split_part(trim(fps, ' '), '/', 2) as double) else 1 end as fps from man where trim(coalesce(fps, ''), ' ') <> '')"

STILL_LIMIT = 3


class Inputs:
    """The tables that several gates read, each row once; written to the shared folder if the gates run together."""

    def __init__(self, spark: SparkSession, d: str, together: bool = False) -> None:
        keep = cut if together else lambda df: df
        self.segments, self.review, self.manifest = keep(segments(spark, d)), keep(review(spark, d)), manifest(spark, d)


_ACT = f"""{EV}, act as (select user_id, bin, avg(value) as v from ev group by 1, 2), fl as (select *, v < 20 as still, row_number() over (partition by user_id order by bin) - row_number() over (partition by user_id, v < 20 order by bin) as k from act),
runs as (select user_id, still, k, count(*) as n from fl group by 1, 2, 3), acts as (select user_id, coalesce(max(case when still then n end), 0)::bigint as longest_still from runs group by 1), fr as (select user_id, avg((not still)::int) as active from fl group by 1)"""


def activity(spark: SparkSession, d: str) -> DataFrame:
    """user_id, longest_still, active: hourly bins, still where their mean value is low."""
    bins = events(spark, d).groupBy("user_id", "bin").agg((F.avg("value") < 20).alias("still"))
    share = bins.groupBy("user_id").agg(F.avg((~F.col("still")).cast("int")).alias("active"))
    return longest_run(bins, ["user_id"], "bin", "still", True).withColumnRenamed("longest", "longest_still").join(share, "user_id")


@add("q_gate_activity", f"with {_ACT} select user_id, longest_still, round(active, 6) as active, case when longest_still > {STILL_LIMIT} or active < 0.5 then 'FLAG' else 'PASS' end as status from acts join fr using (user_id)")
def q_gate_activity(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: bins, active or still, the longest still run, the rule, a status per user."""
    a = activity(spark, d)
    status = F.when((F.col("longest_still") > STILL_LIMIT) | (F.col("active") < 0.5), "FLAG").otherwise("PASS")
    return a.select("user_id", "longest_still", F.round("active", 6).alias("active"), status.alias("status"))


_TEMP = f"""{SEG}, {MAN}, {_RATE}, {ASR}, {REV}, s as (select s.*, fps, lag(end_frame) over (partition by s.video, version order by start_frame nulls first, file) as pe from seg s left join rate r on r.video = s.video),
w as (select *, lag(start) over (partition by video order by idx) as ps from heard),
rv as (select source || ':' || row_no as seg, regexp_extract(file, '(.{{11}})\\.mp4$', 1) as video, trim(sign_start, ' ') as a, trim(sign_end, ' ') as b from rev where trim(coalesce(sign_start, ''), ' ') <> '' or trim(coalesce(sign_end, ''), ' ') <> ''),
rn as (select *, case when regexp_full_match(a, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') then a::double end as x, case when regexp_full_match(b, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') then b::double end as y from rv),
temporal as (
 select 'HARD' as severity, video, version || '/' || file as seg, 'non_positive_duration' as kind from s where end_frame <= start_frame
 union all select 'HARD', video, version || '/' || file, 'frame_count_mismatch' from s where abs(end_frame - start_frame - n_frames) > 1
 union all select 'HARD', video, version || '/' || file, 'frame_time_mismatch' from s where abs(start_frame / fps - start_sec) > 1 / fps + 1e-6
 union all select 'HARD', video, version || '/' || file, 'overlapping_segments' from s where start_frame < pe
 union all select 'HARD', video, idx::varchar, 'negative_time' from w where start < 0
 union all select 'HARD', video, idx::varchar, 'inverted_word' from w where end_sec < start
 union all select 'HARD', video, idx::varchar, 'non_monotonic' from w where start < ps - 1e-6
 union all select 'FLAG', video, seg, 'unparseable_review_timing' from rn where x is null or y is null
 union all select 'HARD', video, seg, 'negative_review_timing' from rn where x is not null and y is not null and (x < 0 or y < 0)
 union all select 'HARD', video, seg, 'inverted_review_timing' from rn where y <= x
 union all select 'FLAG', video, seg, 'long_review_timing' from rn where y - x >= 30)"""


def temporal_issues(spark: SparkSession, d: str, own: Inputs | None = None) -> DataFrame:
    """Segments against their frames, words against their order, reviews against their times."""
    own = own or Inputs(spark, d)
    s = own.segments.select("video", "version", "file", "start_frame", "end_frame", "start_sec", "n_frames")
    s = lag_in_cells(s, ["video", "version"], ["start_frame", "file"], ["end_frame"], 1 << 14)
    s = lookup_join(s, frame_rates(own.manifest).select("video", (F.col("num") / F.col("den")).alias("fps")), ["video"])
    n = F.lit(None).cast("string")
    seg = issues_of(s, [
        (F.expr("end_frame <= start_frame"), "HARD", "non_positive_duration", n), (F.expr("abs(end_frame - start_frame - n_frames) > 1"), "HARD", "frame_count_mismatch", n),
        (F.expr("abs(start_frame / fps - start_sec) > 1 / fps + 1e-6"), "HARD", "frame_time_mismatch", n), (F.expr("start_frame < prev.end_frame"), "HARD", "overlapping_segments", n),
    ], "temporal", "video", F.concat("version", F.lit("/"), "file"))
    w = lag_in_cells(heard(spark, d).select("video", "idx", "start", "end_sec"), ["video"], ["idx"], ["start"], 4096)
    word = issues_of(w, [(F.expr("start < 0"), "HARD", "negative_time", n), (F.expr("end_sec < start"), "HARD", "inverted_word", n), (F.expr("start < prev.start - 1e-6"), "HARD", "non_monotonic", n)], "temporal", "video", "idx")
    number = lambda c: F.when(F.trim(c).rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z"), F.trim(c).try_cast("double"))
    r = own.review.filter("trim(coalesce(sign_start, '')) <> '' or trim(coalesce(sign_end, '')) <> ''").select("source", "row_no", F.regexp_extract("file", r"(.{11})\.mp4$", 1).alias("video"), number("sign_start").alias("x"), number("sign_end").alias("y"))
    rev = issues_of(r, [
        (F.expr("x is null or y is null"), "FLAG", "unparseable_review_timing", n), (F.expr("x is not null and y is not null and (x < 0 or y < 0)"), "HARD", "negative_review_timing", n),
        (F.expr("y <= x"), "HARD", "inverted_review_timing", n), (F.expr("y - x >= 30"), "FLAG", "long_review_timing", n),
    ], "temporal", "video", F.concat_ws(":", "source", F.col("row_no").cast("string")))
    return all_issues([seg, word, rev])


@add("q_gate_temporal", f"with {_TEMP} select severity, video, seg, kind from temporal")
def q_gate_temporal(spark: SparkSession, d: str) -> DataFrame:
    return temporal_issues(spark, d).select("severity", "video", "seg", "kind")


_INT = f"""{SEG}, {MAN}, {CLIPS}, acn as (select video, count(*) as actual from seg where version = 'segments' group by 1),
integrity as (select 'FLAG' as severity, id as video, null as seg, 'stale_manifest_row' as kind from man join acn on acn.video = id where regexp_full_match(n_segs, '[0-9]+') and try_cast(n_segs as bigint) <> actual
 union all select distinct 'FLAG', id, null, 'garbage_manifest_row' from manifest where id is null or not regexp_full_match(id, '[A-Za-z0-9_-]{{11}}') or not coalesce(regexp_full_match(n_segs, '[+-]?[0-9]+'), false)
 union all select 'HARD', video, file, 'missing_frames' from seg where start_frame is null and end_frame is null and start_sec is null and end_sec is null
 union all select distinct 'FLAG', video, null, 'not_in_manifest' from seg where video not in (select id from man)
 union all select distinct 'FLAG', video, null, 'clips_without_segments' from clips where video not in (select video from seg))"""


def integrity_issues(spark: SparkSession, d: str, own: Inputs | None = None) -> DataFrame:
    """Manifest against segments, segments against the manifest, clips against segments."""
    own = own or Inputs(spark, d)
    s, m = own.segments, own.manifest
    none = F.lit(None).cast("string")
    tag = lambda df, sev, video, seg, kind: df.select(F.lit("integrity").alias("gate"), F.lit(sev).alias("severity"), F.col(video).alias("video"), seg.alias("seg"), F.lit(kind).alias("kind"), none.alias("detail"))
    actual = s.filter("version = 'segments'").groupBy(F.col("video").alias("id")).agg(F.count(F.lit(1)).alias("actual"))
    stale = m.filter(r"n_segs rlike '\\A[0-9]+\\z'").join(actual, "id").filter(F.col("n_segs").try_cast("long") != F.col("actual"))
    garbage = table(spark, d, "manifest").filter(F.col("id").isNull() | ~F.col("id").rlike(r"\A[A-Za-z0-9_-]{11}\z") | ~F.coalesce(F.col("n_segs").rlike(r"\A[+-]?[0-9]+\z"), F.lit(False))).select("id").distinct()
    lost = s.filter("start_frame is null and end_frame is null and start_sec is null and end_sec is null")
    videos = s.select("video").distinct()
    return all_issues([
        tag(stale, "FLAG", "id", none, "stale_manifest_row"), tag(garbage, "FLAG", "id", none, "garbage_manifest_row"), tag(lost, "HARD", "video", F.col("file"), "missing_frames"),
        tag(videos.join(m.select(F.col("id").alias("video")), "video", "left_anti"), "FLAG", "video", none, "not_in_manifest"),
        tag(clips(spark, d).select("video").distinct().join(videos, "video", "left_anti"), "FLAG", "video", none, "clips_without_segments"),
    ])


@add("q_gate_integrity", f"with {_INT} select severity, video, seg, kind from integrity")
def q_gate_integrity(spark: SparkSession, d: str) -> DataFrame:
    return integrity_issues(spark, d).select("severity", "video", "seg", "kind")


_PRES = f"{SEG}, presence as (select 'FLAG' as severity, video, version || '/' || file as seg, 'excluded' as kind from seg where not coalesce(hand_coverage >= 0.6, false) or coalesce(end_sec - start_sec, 0) < 2)"


def presence_issues(spark: SparkSession, d: str, own: Inputs | None = None) -> DataFrame:
    s = (own or Inputs(spark, d)).segments
    return issues_of(s, [(F.expr("not coalesce(hand_coverage >= 0.6, false) or coalesce(end_sec - start_sec, 0) < 2"), "FLAG", "excluded", F.col("hand_coverage"))], "presence", "video", F.concat("version", F.lit("/"), "file"))


@add("q_gate_presence", f"with {_PRES} select severity, video, seg, kind from presence")
def q_gate_presence(spark: SparkSession, d: str) -> DataFrame:
    return presence_issues(spark, d).select("severity", "video", "seg", "kind")


_REVI = f"""{REV}, rr as (select *, source || ':' || row_no as seg, regexp_extract(file, '(.{{11}})\\.mp4$', 1) as video, trim(coalesce(sign_start, ''), ' ') as a, trim(coalesce(sign_end, ''), ' ') as b from rev), review_issues as (
 select 'FLAG' as severity, video, seg, 'invalid_verdict' as kind from rr where verdict not in ('y', 'n', 'neg', '')
 union all select 'FLAG', video, seg, 'verdict_without_signer' from rr where verdict in ('y', 'n', 'neg') and trim(coalesce(signer, ''), ' ') = ''
 union all select 'FLAG', video, seg, 'incomplete_timing' from rr where (a = '') <> (b = ''))"""


def review_issues(spark: SparkSession, d: str, own: Inputs | None = None) -> DataFrame:
    r = (own or Inputs(spark, d)).review.withColumn("video", F.regexp_extract("file", r"(.{11})\.mp4$", 1))
    a, b = F.trim(F.coalesce("sign_start", F.lit(""))), F.trim(F.coalesce("sign_end", F.lit("")))
    v = F.col("verdict")
    return issues_of(r, [(~v.isin("y", "n", "neg", ""), "FLAG", "invalid_verdict", v), (v.isin("y", "n", "neg") & (F.trim(F.coalesce("signer", F.lit(""))) == ""), "FLAG", "verdict_without_signer", v), ((a == "") != (b == ""), "FLAG", "incomplete_timing", v)], "review", "video", F.concat_ws(":", "source", F.col("row_no").cast("string")))


@add("q_gate_review", f"with {_REVI} select severity, video, seg, kind from review_issues")
def q_gate_review(spark: SparkSession, d: str) -> DataFrame:
    return review_issues(spark, d).select("severity", "video", "seg", "kind")


def _checked(own: Inputs, active: DataFrame) -> DataFrame:
    n = lambda df, g: df.agg(F.count(F.lit(1)).alias("n_checked")).select(F.lit(g).alias("gate"), "n_checked")
    s = own.segments.agg(F.count(F.lit(1)).alias("n_checked")).select(F.explode(F.array(*map(F.lit, ("integrity", "temporal", "presence")))).alias("gate"), "n_checked")
    return all_issues([s, n(active, "activity"), n(own.review, "review")])


def results(spark: SparkSession, d: str) -> DataFrame:
    """All gates rolled up. What several of them read is written once."""
    own, every = Inputs(spark, d, True), cut(activity(spark, d))
    a = every.filter((F.col("longest_still") > STILL_LIMIT) | (F.col("active") < 0.5))
    still = a.select(F.lit("activity").alias("gate"), F.lit("FLAG").alias("severity"), F.col("user_id").cast("string").alias("video"), F.lit(None).cast("string").alias("seg"), F.lit("still").alias("kind"), F.col("longest_still").cast("string").alias("detail"))
    return roll_up(all_issues([integrity_issues(spark, d, own), temporal_issues(spark, d, own), presence_issues(spark, d, own), still, review_issues(spark, d, own)]), _checked(own, every))


def _parts(*ctes: str) -> str:
    """The common table expressions of several queries, each name once."""
    seen: dict[str, str] = {}
    for text in ctes:
        depth, start = 0, 0
        for i, ch in enumerate(text + ","):
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                part = text[start:i].strip()
                seen.setdefault(part.split(" as ")[0], part)
                start = i + 1
    return ", ".join(seen.values())


_ROLL = _parts(_INT, _TEMP, _PRES, _ACT, _REVI) + f""", iss as (select 'integrity' as gate, severity from integrity union all select 'temporal', severity from temporal union all select 'presence', severity from presence union all select 'review', severity from review_issues
 union all select 'activity', 'FLAG' from acts join fr using (user_id) where longest_still > {STILL_LIMIT} or active < 0.5),
chk as (select 'integrity' as gate, count(*) as n_checked from seg union all select 'temporal', count(*) from seg union all select 'presence', count(*) from seg union all select 'activity', count(*) from acts union all select 'review', count(*) from rev),
res as (select gate, n_checked, count_if(severity = 'HARD') as n_failed, count_if(severity = 'FLAG') as n_flagged from chk left join iss using (gate) group by 1, 2)"""


@add("q_gate_rollup", f"with {_ROLL} select gate, n_checked, n_failed::bigint as n_failed, n_flagged::bigint as n_flagged, case when n_checked = 0 then 'SKIPPED' when n_failed > 0 then 'FAIL' when n_flagged > 0 then 'FLAG' else 'PASS' end as status from res")
def q_gate_rollup(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d)


@add("q_gate_exit", f"with {_ROLL} select max((n_failed > 0 and gate in ('integrity', 'temporal'))::int) as exit_code from res")
def q_gate_exit(spark: SparkSession, d: str) -> DataFrame:
    return overall(results(spark, d), HARD_GATES)


@add("q_loaded_times", JUDGED_SQL + "select verdict, count(*) as n, round(median(ev - sv), 6) as med from judged where reason is null and not sb group by 1")
def q_loaded_times(spark: SparkSession, d: str) -> DataFrame:
    """Length of the signed moments that could be loaded, by verdict."""
    r = loaded(spark, d).filter("sign_start is not null")
    return r.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.median(F.expr("sign_end - sign_start")), 6).alias("med"))
