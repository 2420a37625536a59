"""Landmark operators on vectors read as frames, and further retrieval and label queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.catalog import table
from weftline.functions import predicates as P
from weftline.functions.text import fold_key
from weftline.operators import tensor as L
from weftline.plans.common import ASR, EV, HOUR, REV, SEG, events, heard, review, segments, six
from weftline.plans.evaluation import similarities
from weftline.plans.registry import CORE
from weftline.plans.texts import _FOLD

add = CORE.add
_PTS = "pts as (select label::varchar as video, vec_id as frame, unnest(generate_series(0, 31)) as row_no, embedding::double[] as v from embeddings), p as (select video, frame, row_no, case when v[row_no * 2 + 1] > -0.2 then v[row_no * 2 + 1] end as x, v[row_no * 2 + 2] as y from pts)"


def points(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as frames of 32 points with two coordinates; the label as video; a point far to the left is missing."""
    e = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("video"), F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("v"))
    p = e.select("video", "frame", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("row_no"), "v")
    x, y = F.get("v", F.col("row_no") * 2), F.get("v", F.col("row_no") * 2 + 1)
    return p.select("video", "frame", "row_no", F.when(x > -0.2, x).alias("x"), y.alias("y"), F.lit(None).cast("double").alias("z"))


@add("q_landmark_coverage", f"with {_PTS}, k as (select video, frame, bool_or(x is not null and row_no < 4) as k from p group by 1, 2) select video, round(avg(k::int), 6) as coverage, count(*) as n_frames from k group by 1")
def q_landmark_coverage(spark: SparkSession, d: str) -> DataFrame:
    return L.coverage(points(spark, d), ["video"], (0, 4)).select("video", six(F.col("coverage"), "coverage"), "n_frames")


@add("q_motion", f"with {_PTS}, m as (select *, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as dd from p window w as (partition by video, row_no order by frame)) select video, frame, round(coalesce(avg(dd), 0), 6) as energy from m group by 1, 2")
def q_motion(spark: SparkSession, d: str) -> DataFrame:
    return L.motion(points(spark, d), ["video"]).select("video", "frame", six(F.col("energy"), "energy"))


@add("q_dominant_side", f"with {_PTS}, q as (select * from p where x is not null and row_no in (0, 21)), m as (select video, row_no, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as dd from q window w as (partition by video, row_no order by frame)), s as (select video, coalesce(sum(case when row_no = 0 then dd end), 0) as l, coalesce(sum(case when row_no = 21 then dd end), 0) as r from m group by 1) select video, case when l > r then 'left' else 'right' end as side from s")
def q_dominant_side(spark: SparkSession, d: str) -> DataFrame:
    return L.dominant_side(points(spark, d), ["video"])


@add("q_robust_box", f"with {_PTS}, b as (select video, quantile_cont(x, 0.02) as a0, quantile_cont(x, 0.98) as a1, quantile_cont(y, 0.02) as b0, quantile_cont(y, 0.98) as b1 from p where x is not null group by 1) select video, round(greatest(0, a0 - (a1 - a0) * 0.1), 6) as x0, round(greatest(0, b0 - (b1 - b0) * 0.1), 6) as y0, round(least(1, a1 + (a1 - a0) * 0.1), 6) as x1, round(least(1, b1 + (b1 - b0) * 0.1), 6) as y1 from b")
def q_robust_box(spark: SparkSession, d: str) -> DataFrame:
    return L.robust_box(points(spark, d), ["video"], (0, 32), 0.1).select("video", *[six(F.col(c), c) for c in ("x0", "y0", "x1", "y1")])


@add("q_dense_grid", f"with {_PTS}, e as (select video, min(frame) as a, max(frame) as b from p group by 1), f as (select video, unnest(generate_series(a, b)) as frame from e), g as (select video, frame, unnest(generate_series(0, 31)) as row_no from f) select g.video, g.frame, g.row_no::int as row_no, p.y from g left join p using (video, frame, row_no)")
def q_dense_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every frame of a video from its first to its last with all 32 rows."""
    return L.dense(points(spark, d), ["video"], 32).select("video", "frame", "row_no", "y")


@add("q_contours", f"with {_PTS}, q as (select *, avg(x) over w as cx, avg(y) over w as cy, count(x) over w as n from p where row_no in (3, 4, 5, 6) window w as (partition by video, frame)) select video, frame, row_no::int as row_no, round(x - cx, 6) as dx, round(y - cy, 6) as dy from q where n = 4")
def q_contours(spark: SparkSession, d: str) -> DataFrame:
    """Points of a contour around its centre, only where all are known."""
    c = L.centred_contour(points(spark, d), ["video"], (3, 4, 5, 6)).filter("contour is not null")
    x = c.select("video", "frame", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"), "contour")
    return x.select("video", "frame", (F.col("i") + 3).alias("row_no"), six(F.get("contour", F.col("i") * 2), "dx"), six(F.get("contour", F.col("i") * 2 + 1), "dy"))


@add("q_split_at_changes", f"with {SEG}, s as (select video, file, start_frame as a, end_frame as b from seg where version = 'segments' and start_frame < end_frame), c as (select distinct video, start_frame as chg from seg where version = 'segments_revalidated' and start_frame is not null), t as (select video, file, a as x from s union select video, file, b from s union select s.video, file, chg from s join c on c.video = s.video and chg > a and chg < b), l as (select video, file, x as \"start\", lead(x) over (partition by video, file order by x) as \"end\" from t) select video, file, \"start\", \"end\" from l where \"end\" is not null")
def q_split_at_changes(spark: SparkSession, d: str) -> DataFrame:
    """Segments of one version cut at the starts of another."""
    s = segments(spark, d).filter("version = 'segments' and start_frame < end_frame").select("video", "file", F.col("start_frame").alias("start"), F.col("end_frame").alias("end"))
    c = segments(spark, d).filter("version = 'segments_revalidated' and start_frame is not null").select("video", F.col("start_frame").alias("at"))
    return L.split_at_changes(s, c, "video", "start", "end", "at").select("video", "file", "start", "end")


STOP = ("de", "la", "que", "el", "en", "los", "las", "para", "con", "una", "por", "sin")


@add("q_content_words", f"with {ASR}, k as (select {_FOLD.format('word')} as w from heard where word is not null) select w, count(*) as n from k where length(w) >= 3 and w not in {STOP} group by 1")
def q_content_words(spark: SparkSession, d: str) -> DataFrame:
    """How often each folded word is heard, without stop words."""
    stop = spark.createDataFrame([(s,) for s in STOP], "word string")
    h = heard(spark, d).filter("word is not null")
    return P.content_words(h, "word", stop).groupBy(fold_key(F.col("word")).alias("w")).agg(F.count(F.lit(1)).alias("n"))


@add("q_label_filters", f"with {REV} select word, not (length(trim(word, ' ')) < 2 or not regexp_matches(word, '\\p{{L}}')) as usable, length(word) > 0 and not regexp_matches(word, '[( ]') as single, count(*) as n from rev where word is not null group by 1, 2, 3")
def q_label_filters(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("word")
    return review(spark, d).filter("word is not null").groupBy("word", (~P.junk_label(w)).alias("usable"), P.single_word(w).alias("single")).agg(F.count(F.lit(1)).alias("n"))


@add("q_calibration", f"with {EV}, a as (select user_id, bin, avg(value) as v, bool_or(event_type = 'purchase') as known from ev group by 1, 2) select count(*) as n, count(*) filter (where known) as n_known, round(quantile_cont(v, 0.05), 6) as p5, round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(case when known then v end, 0.05), 6) as known_p5, round(quantile_cont(case when known then v end, 0.5), 6) as known_p50 from a")
def q_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of all bins and of those known to be active; the suggested threshold is the latter's p5."""
    a = events(spark, d).groupBy("user_id", "bin").agg(F.avg("value").alias("v"), F.bool_or(F.col("event_type") == "purchase").alias("known"))
    known = F.when(F.col("known"), F.col("v"))
    m = a.agg(F.count(F.lit(1)).alias("n"), F.count_if("known").alias("n_known"), F.percentile("v", [0.05, 0.5]).alias("p"), F.percentile(known, [0.05, 0.5]).alias("k"))
    return m.select("n", "n_known", six(F.col("p")[0], "p5"), six(F.col("p")[1], "p50"), six(F.col("k")[0], "known_p5"), six(F.col("k")[1], "known_p50"))


@add("q_contrast", "with e as (select vec_id, label, embedding::double[] as v from embeddings where vec_id % 20 = 0), o as (select vec_id, label, embedding::double[] as v from embeddings), s as (select e.vec_id, e.label = o.label as same, list_distance(e.v, o.v) as dist from e join o on e.vec_id <> o.vec_id) select round(median(case when same then dist end), 6) as within, round(median(case when not same then dist end), 6) as across, median(case when not same then dist end) / median(case when same then dist end) >= 1.25 as apart from s")
def q_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Median distance within a label and across labels, from the stated queries to all vectors."""
    s = similarities(spark, d).select((F.col("ql") == F.col("ol")).alias("same"), "dist")
    m = s.agg(F.median(F.when(F.col("same"), F.col("dist"))).alias("w"), F.median(F.when(~F.col("same"), F.col("dist"))).alias("a"))
    return m.select(six(F.col("w"), "within"), six(F.col("a"), "across"), (F.col("a") / F.col("w") >= 1.25).alias("apart"))


@add("q_still_share_by_hour", f"with {EV} select (us // {HOUR}) % 24 as hour, count(*) as n, round(avg((value < 20)::int), 6) as still from ev group by 1")
def q_still_share_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy((F.col("bin") % 24).alias("hour")).agg(F.count(F.lit(1)).alias("n"), six(F.avg((F.col("value") < 20).cast("int")), "still"))
