"""Scoring, retrieval, rank statistics, lag estimation and sequence kernels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from weftline.operators.lookup import beside
from weftline.catalog import table
from weftline.functions.kernels import compared, nearest_by_cosine, nearest_by_part, nearest_by_warping, token_align_column
from weftline.functions.vectors import iou, mirror_row, resample
from weftline.functions.text import words
from weftline.operators import evaluation as E
from weftline.operators.sequences import lag_in_cells
from weftline.operators.temporal import nearest, next_within
from weftline.plans.common import ASR, CLIPS, EV, SEG, clips, events, heard, segments, six
from weftline.plans.registry import CORE

add = CORE.add

_PAIR = f"{SEG}, t as (select video, file, a.start_sec as t0, a.end_sec as t1, b.start_sec as p0, b.end_sec as p1 from seg a join seg b using (video, file) where a.version = 'segments' and b.version = 'segments_revalidated' and a.start_sec < a.end_sec and b.start_sec < b.end_sec)"


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """Segments of two versions with one name: t0, t1 of the first and p0, p1 of the second."""
    s = segments(spark, d).filter("start_sec < end_sec")
    a = s.filter("version = 'segments'").select("video", "file", F.col("start_sec").alias("t0"), F.col("end_sec").alias("t1"))
    return a.join(s.filter("version = 'segments_revalidated'").select("video", "file", F.col("start_sec").alias("p0"), F.col("end_sec").alias("p1")), ["video", "file"])


@add("q_interval_metrics", f"with {_PAIR} select video, file, round(greatest(0, least(t1, p1) - greatest(t0, p0)) / ((t1 - t0) + (p1 - p0) - greatest(0, least(t1, p1) - greatest(t0, p0))), 6) as iou, round((p0 + p1) / 2 - (t0 + t1) / 2, 6) as signed_dist, round(abs((p0 + p1) / 2 - (t0 + t1) / 2) / (t1 - t0), 6) as norm_dist, p0 - 1 <= (t0 + t1) / 2 and (t0 + t1) / 2 <= p1 + 1 as contains from t")
def q_interval_metrics(spark: SparkSession, d: str) -> DataFrame:
    t0, t1, p0, p1 = (F.col(c) for c in ("t0", "t1", "p0", "p1"))
    off = (p0 + p1) / 2 - (t0 + t1) / 2
    return predicted(spark, d).select("video", "file", six(iou(t0, t1, p0, p1), "iou"), six(off, "signed_dist"), six(F.abs(off) / (t1 - t0), "norm_dist"), ((p0 - 1 <= (t0 + t1) / 2) & ((t0 + t1) / 2 <= p1 + 1)).alias("contains"))


@add("q_alignment_report", f"with {_PAIR}, arms as (select unnest([0.0, 0.25, 1.0]) as bias), m as (select bias, (p0 + p1) / 2 + bias - (t0 + t1) / 2 as off, p1 - p0 as dur, p0 + bias - 1 <= (t0 + t1) / 2 and (t0 + t1) / 2 <= p1 + bias + 1 as ok from t, arms) select bias::double as bias, count(*) as n, round(avg(ok::int), 6) as contains, round(median(abs(off)), 6) as median_abs, round(avg(abs(off)), 5) as mean_abs, round(median(dur), 6) as median_dur from m group by 1")
def q_alignment_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of each arm of a sweep over shifts."""
    m = predicted(spark, d).withColumn("bias", F.explode(F.array(F.lit(0.0), F.lit(0.25), F.lit(1.0))))
    mid, off = F.expr("(t0 + t1) / 2"), F.expr("(p0 + p1) / 2 + bias - (t0 + t1) / 2")
    ok = ((F.expr("p0 + bias - 1") <= mid) & (mid <= F.expr("p1 + bias + 1"))).cast("int")
    return m.groupBy("bias").agg(F.count(F.lit(1)).alias("n"), six(F.avg(ok), "contains"), six(F.median(F.abs(off)), "median_abs"), F.round(F.avg(F.abs(off)), 5).alias("mean_abs"), six(F.median(F.expr("p1 - p0")), "median_dur"))


_SER = f"{EV}, lo as (select min(bin) as b0 from ev), a as (select bin, sum(case when event_type = 'view' then value else 0 end) as x, sum(case when event_type = 'purchase' then value else 0 end) as y from ev group by 1), z as (select bin, (x - avg(x) over ()) / stddev_pop(x) over () as x, (y - avg(y) over ()) / stddev_pop(y) over () as y from a)"


@add("q_xcorr", f"with {_SER}, l as (select unnest(generate_series(-8, 24)) as lag) select lag, round(avg(p.x * q.y), 6) as r, count(*) as n from l join z p on true join z q on q.bin = p.bin + lag group by 1")
def q_xcorr(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of two hourly series at each lag: each bin is spread to its lags, so the join is on bins alone."""
    a = events(spark, d).groupBy("bin").agg(F.sum(F.when(F.col("event_type") == "view", F.col("value")).otherwise(0)).alias("x"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0)).alias("y"))
    m = a.agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    z = beside(a, m).select("bin", ((F.col("x") - F.col("mx")) / F.col("sx")).alias("x"), ((F.col("y") - F.col("my")) / F.col("sy")).alias("y"))
    p = z.select("x", F.explode(F.sequence(F.lit(-8).cast("long"), F.lit(24).cast("long"))).alias("lag"), F.col("bin").alias("b0")).withColumn("bin", F.col("b0") + F.col("lag"))
    return p.join(z.select("bin", "y"), "bin").groupBy("lag").agg(six(F.avg(F.col("x") * F.col("y")), "r"), F.count(F.lit(1)).alias("n"))


_EMB = "e as (select vec_id, label, embedding::double[] as v from embeddings), q as (select * from e where vec_id % 20 = 0), s as (select q.vec_id as query, q.label as ql, e.vec_id as other, e.label as ol, round(list_cosine_similarity(q.v, e.v), 9) as sim from q join e on e.vec_id <> q.vec_id), r as (select *, row_number() over (partition by query order by sim desc, other) as rn from s)"


def scored_in_blocks(spark: SparkSession, d: str, scored, schema: str) -> DataFrame:
    """What `scored` says of every stated query (ids divisible by 20) and all vectors.

    Queries and vectors are dealt by a hash of their ids into parts of about 256, and each part of the one meets each of
    the other once, in a task of its own: no task holds all vectors, and a pair of parts is scored as a whole.
    """
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("ql"), F.col("v").alias("qv"))
    parts = e.agg(F.ceil(F.count(F.lit(1)) / 256).alias("parts"), F.ceil(F.count_if(F.col("vec_id") % 20 == 0) / 256).alias("blocks"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.greatest(n, F.lit(1)))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # stated, so that the parts aren't put into few tasks for being small
    qs = beside(q, parts).withColumn("block", dealt("query", F.col("blocks"))).withColumn("part", each(F.col("parts"))).drop("parts", "blocks").repartition(n, "block", "part")
    vs = beside(e, parts).withColumn("part", dealt("vec_id", F.col("parts"))).withColumn("block", each(F.col("blocks"))).drop("parts", "blocks").repartition(n, "block", "part")
    return qs.groupBy("block", "part").cogroup(vs.groupBy("block", "part")).applyInPandas(scored, schema)


def similarities(spark: SparkSession, d: str) -> DataFrame:
    """query, ql, other, ol, sim, dist: cosine similarity and distance of the stated queries to all other vectors."""
    return scored_in_blocks(spark, d, compared(), "query long, ql int, other long, ol int, sim double, dist double").withColumn("sim", F.round("sim", 9))


@add("q_cosine_topk", f"with {_EMB} select query, other, round(sim, 6) as sim, rn as rank from r where rn <= 5")
def q_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    near = nearest_in_blocks(spark, d, nearest_by_cosine(5), NEAR, 5)
    return near.select(F.col("a").alias("query"), F.col("b").alias("other"), six(1 - F.col("cost"), "sim"), "rank")


@add("q_loo_eval", f"with {_EMB}, f as (select query, ql, min(case when ol = ql then rn end) as first_rank, count(*) as n_candidates from r group by 1, 2) select coalesce(ql::varchar, '(all)') as label, count(*) as n, round(avg(coalesce((first_rank <= 1)::int, 0)), 6) as top1, round(avg(coalesce((first_rank <= 5)::int, 0)), 6) as top5, round(avg(coalesce(1.0 / first_rank, 0)), 6) as mrr, round(median(first_rank), 6) as median_rank, round(avg(first_rank), 6) as mean_rank, round(avg((n_candidates + 1) / 2.0), 6) as chance_rank from f group by grouping sets ((ql), ())")
def q_loo_eval(spark: SparkSession, d: str) -> DataFrame:
    """Leave one out: rank of the first vector of the query's label, by label and overall."""
    ranked = similarities(spark, d).withColumn("rn", F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "other"))).withColumn("ok", F.col("ol") == F.col("ql"))
    hits = E.first_hit(ranked, ["query", "ql"], "rn", "ok")
    per = E.rank_report(hits.withColumn("label", F.explode(F.array(F.col("ql").cast("string"), F.lit("(all)")))), ["label"])
    return per.select("label", "n", *[six(F.col(c), c) for c in ("top1", "top5", "mrr", "median_rank", "mean_rank", "chance_rank")])


@add("q_forced_choice", f"with {_EMB}, c as (select *, row_number() over (partition by query, ol = ql order by (other * 7919) % 1009, other) as k from s), p as (select * from c where (ol = ql and k = 1) or (ol <> ql and k <= 4)), t as (select *, row_number() over (partition by query order by sim desc, other) as rn from p), f as (select query, min(case when ol = ql then rn end) as r from t group by 1), m as (select count(*) as n, sum((r = 1)::int) as hits, avg(1.0 / r) as mrr from f) select n, hits::bigint as hits, round(mrr, 6) as mrr, round(greatest(0, (hits / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) as lo, round(least(1, (hits / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) as hi from m")
def q_forced_choice(spark: SparkSession, d: str) -> DataFrame:
    """One right and four wrong candidates a query, chosen by a fixed rule; hits, MRR and the Wilson interval."""
    s = similarities(spark, d).withColumn("ok", F.col("ol") == F.col("ql"))
    k = F.row_number().over(W.partitionBy("query", "ok").orderBy((F.col("other") * 7919) % 1009, "other"))
    p = s.withColumn("k", k).filter("(ok and k = 1) or (not ok and k <= 4)")
    f = p.withColumn("rn", F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "other"))).groupBy("query").agg(F.min(F.when(F.col("ok"), F.col("rn"))).alias("r"))
    m = f.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") == 1).alias("hits"), F.avg(1 / F.col("r")).alias("mrr"))
    lo, hi = E.wilson(F.col("hits"), F.col("n"))
    return m.select("n", "hits", six(F.col("mrr"), "mrr"), six(lo, "lo"), six(hi, "hi"))


def _rank(v: str, part: str = "") -> str:
    return f"rank() over ({part} order by {v}) + (count(*) over (partition by {part.removeprefix('partition by ') + ', ' if part else ''}{v}) - 1) / 2.0"


@add("q_spearman", f"with {CLIPS}, x as (select word_start - video_start as a, word_end - word_start as b from clips where word_start is not null and word_end is not null and video_start is not null), r as (select {_rank('a')} as ra, {_rank('b')} as rb from x) select round(corr(ra, rb), 6) as rho, count(*) as n from r")
def q_spearman(spark: SparkSession, d: str) -> DataFrame:
    x = clips(spark, d).select(F.expr("word_start - video_start").alias("a"), F.expr("word_end - word_start").alias("b"))
    return E.spearman(x, "a", "b").select(six(F.col("rho"), "rho"), "n")


@add("q_kendall", f"with {EV}, x as (select user_id, bin // 24 as day, event_id, us, value from ev), p as (select a.user_id, a.day, sign(a.us - b.us) * sign(a.value - b.value) as s from x a join x b on a.user_id = b.user_id and a.day = b.day and a.event_id < b.event_id) select user_id, day, round(avg(s), 6) as tau, count(*) as n_pairs from p group by 1, 2")
def q_kendall(spark: SparkSession, d: str) -> DataFrame:
    """Whether values rise over a user's day."""
    x = events(spark, d).select("user_id", F.floor(F.col("bin") / 24).alias("day"), "event_id", "us", "value")
    return E.kendall(x, ["user_id", "day"], "us", "value", "event_id").select("user_id", "day", six(F.col("tau"), "tau"), "n_pairs")


def p_sql(z: str) -> str:
    """The two-sided p value of a normal z in SQL, as evaluation.normal_p."""
    x = f"(abs({z}) / sqrt(2.0::double))"
    t = f"(1 / (1 + 0.3275911::double * {x}))"
    return f"((((((1.061405429::double * {t} - 1.453152027::double) * {t}) + 1.421413741::double) * {t} - 0.284496736::double) * {t} + 0.254829592::double) * {t} * exp(-{x} * {x}))"


@add("q_mannwhitney", f"with x as (select event_type = 'error' as g, value as v from events where value is not null), r as (select g, {_rank('v')} as r from x), k as (select sum(c * c * c - c) as t3 from (select count(*)::double as c from x group by v)), s as (select sum(case when g then r end) as r1, count_if(g)::double as n1, count_if(not g)::double as n2, count(*)::double as m from r), z as (select r1 - n1 * (n1 + 1) / 2 as u, n1, n2, (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12.0 * (m + 1 - t3 / (m * (m - 1)))) as z from s, k) select round(u, 6) as u, round(1 - u / (n1 * n2), 6) as p_less, n1::bigint as n1, n2::bigint as n2, round(z, 6) as z, round({p_sql('z')}, 6) as p from z")
def q_mannwhitney(spark: SparkSession, d: str) -> DataFrame:
    m = E.mann_whitney(table(spark, d, "events"), "event_type", "value", "error")
    return m.select(six(F.col("u"), "u"), six(F.col("p_less"), "p_less"), "n1", "n2", six(F.col("z"), "z"), six(F.col("p"), "p"))


@add("q_wilcoxon", f"with {_PAIR}, x as (select round((p0 + p1) - (t0 + t1), 3) as d from t), y as (select d, abs(d) as a from x where d <> 0), r as (select d, a, {_rank('a')} as r from y), k as (select sum(c * c * c - c) as t3 from (select count(*)::double as c from y group by a)), w as (select sum(case when d > 0 then r else 0 end) as w_plus, count(*)::double as n from r), z as (select w_plus, n, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t3 / 48) as z from w, k) select round(w_plus, 6) as w_plus, n::bigint as n, round(z, 6) as z, round({p_sql('z')}, 6) as p from z")
def q_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    w = E.wilcoxon(predicted(spark, d).select(F.round(F.expr("(p0 + p1) - (t0 + t1)"), 3).alias("d")), "d")
    return w.select(six(F.col("w_plus"), "w_plus"), "n", six(F.col("z"), "z"), six(F.col("p"), "p"))


@add("q_null_rank", "with k as (select unnest(generate_series(0, 20)) as k) select k, round(((25.0 - k) * (24 - k) * (23 - k) * (22 - k) * (21 - k)) / (25.0 * 24 * 23 * 22 * 21), 9) as p, round(26 / 6.0, 9) as null_mean from k")
def q_null_rank(spark: SparkSession, d: str) -> DataFrame:
    """Null distribution of the least of five ranks out of 25, in closed form."""
    return E.null_rank_table(spark, 25, 5).select("k", F.round("p", 9).alias("p"), F.round("null_mean", 9).alias("null_mean"))


@add("q_mirror_coverage", "with x as (select vec_id, unnest(embedding::double[]) as v, generate_subscripts(embedding, 1) - 1 as row_no from embeddings), m as (select vec_id, case when row_no < 21 then row_no + 21 when row_no < 42 then row_no - 21 else row_no end as row_no, case when abs(v) > 0.05 then 1 - v end as v from x) select vec_id, round(avg((v is not null)::int), 6) as coverage, round(avg(case when row_no < 21 then v end), 6) as left_mean, round(avg(case when row_no between 21 and 41 then v end), 6) as right_mean from m group by 1")
def q_mirror_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Vectors read as landmark rows: mirrored, hands exchanged, and the share of rows that are there."""
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("r", "v"))
    m = x.select("vec_id", mirror_row(F.col("r")).alias("row_no"), F.when(F.abs("v") > 0.05, 1 - F.col("v")).alias("v"))
    return m.groupBy("vec_id").agg(six(F.avg(F.col("v").isNotNull().cast("int")), "coverage"), six(F.avg(F.when(F.col("row_no") < 21, F.col("v"))), "left_mean"), six(F.avg(F.when(F.col("row_no").between(21, 41), F.col("v"))), "right_mean"))


@add("q_resample", "with x as (select vec_id, embedding::double[] as v, 63 / 15.0 as step from embeddings), i as (select vec_id, v, unnest(generate_series(0, 15)) as k, step from x), p as (select vec_id, k, v[floor(k * step)::int + 1] as a, v[least(floor(k * step)::int + 1, 63) + 1] as b, k * step - floor(k * step) as f from i) select vec_id, k, round(a + (b - a) * f, 5) as x from p")
def q_resample(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode(resample(F.col("embedding").cast("array<double>"), 16)).alias("k", "x"))
    return x.select("vec_id", F.col("k").cast("long").alias("k"), F.round("x", 5).alias("x"))


NEAR = "label int, b_label int, a long, b long, cost double"


def nearest_in_blocks(spark: SparkSession, d: str, scored, schema: str, k: int) -> DataFrame:
    """The k nearest of all other vectors to every stated query, with their rank; of equal ones the lesser id. Of each pair of parts k are kept, so the rows to rank are k for a query and part."""
    w = W.partitionBy("a").orderBy("cost", "b")
    return scored_in_blocks(spark, d, scored, schema).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).withColumn("cost", F.round("cost", 6))


@add("q_dtw_pairs")
def q_dtw_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of all other vectors to each stated query by banded time warping, as 16 frames of 4 numbers; the mirrored form counts if it is nearer."""
    return nearest_in_blocks(spark, d, nearest_by_warping(4, 5, 10), NEAR, 5)


@add("q_subseq_dtw")
def q_subseq_dtw(spark: SparkSession, d: str) -> DataFrame:
    """The five of all other vectors in which the middle third of each stated query fits best, and where."""
    return nearest_in_blocks(spark, d, nearest_by_part(4, 5, 5, 6), "label int, b_label int, a long, b long, start long, end long, cost double", 5)


def retrieval_report(near: DataFrame, slices: DataFrame) -> DataFrame:
    """n, top1, top5 and mrr (of the first five) by slice. near: the nearest of each query, a, label, b_label, rank; slices: label, slice."""
    hits = near.groupBy("a", "label").agg(F.min(F.when(F.col("label") == F.col("b_label"), F.col("rank"))).alias("r")).join(F.broadcast(slices), "label")
    share = lambda k: F.avg(F.coalesce(F.col("r") <= k, F.lit(False)).cast("int"))
    return hits.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), six(share(1), "top1"), six(share(5), "top5"), six(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), "mrr"))


def label_slices(spark: SparkSession, d: str) -> DataFrame:
    """label, slice: all labels, those with several examples, and those of one."""
    n = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.select("label", F.explode(F.array(F.lit("all"), F.when(F.col("n") > 1, "multi-example").otherwise("single"))).alias("slice"))


@add("q_dtw_eval")
def q_dtw_eval(spark: SparkSession, d: str) -> DataFrame:
    """Leave one out by banded time warping against all vectors, mirrored forms too: hits among the nearest five, by slice."""
    return retrieval_report(nearest_in_blocks(spark, d, nearest_by_warping(4, 5, 10), NEAR, 5), label_slices(spark, d))


SWEEP = ((3, False), (10, False), (10, True))


@add("q_dtw_sweep")
def q_dtw_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Several configurations of the warping (band, mirrored or not), ranked by their share of hits among five."""
    runs = [retrieval_report(nearest_in_blocks(spark, d, nearest_by_warping(4, 5, band, mirror), NEAR, 5), label_slices(spark, d)).filter("slice = 'all'").select(F.lit(band).alias("band"), F.lit(mirror).alias("mirrored"), "n", "top1", "top5", "mrr") for band, mirror in SWEEP]
    return reduce(lambda a, b: a.unionByName(b), runs).orderBy(F.desc("top5"), F.desc("mrr"), "band", "mirrored")


@add("q_best_reference")
def q_best_reference(spark: SparkSession, d: str) -> DataFrame:
    """Where the label is known beforehand, the best of its references to each stated query."""
    return nearest_in_blocks(spark, d, nearest_by_warping(4, 1, 10, same=True), NEAR, 1).select("label", "a", "b", "cost")


@add("q_confusions", f"with {_EMB} select ql as label, ol as taken_for, count(*) as n from r where rn = 1 and ol <> ql group by 1, 2")
def q_confusions(spark: SparkSession, d: str) -> DataFrame:
    """Which label the most similar vector has where it is the wrong one."""
    near = nearest_in_blocks(spark, d, nearest_by_cosine(1), NEAR, 1).filter("label <> b_label")
    return near.groupBy("label", F.col("b_label").alias("taken_for")).agg(F.count(F.lit(1)).alias("n"))


@add("q_token_align")
def q_token_align(spark: SparkSession, d: str) -> DataFrame:
    """Words of a document aligned with those of the document without every seventh word: how many are matched."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", words(F.lower("text")).alias("w"))
    own = docs.withColumn("o", F.filter("w", lambda x, i: (i % 7) != 3)).withColumn("at", token_align_column()("w", "o"))
    return own.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.filter("at", lambda x: x >= 0)).cast("long").alias("n_matched"))


@add("q_lag_estimate", f"""with {ASR}, {CLIPS}, h as (select video, idx, end_sec, lead(start) over (partition by video order by start, idx) as nx from heard where start is not null and end_sec is not null), p as (select distinct video, end_sec as t from h where nx - end_sec > 0.6), c as (select distinct video, coalesce(word_start, video_start) as t from clips),
m as (select p.video, p.t, min(c.t) as ct from p join c on c.video = p.video and c.t > p.t and c.t - p.t <= 15 group by 1, 2) select count(*) as n, round(median(ct - t), 6) as lag, round(quantile_cont(ct - t, 0.75) / 2 - quantile_cont(ct - t, 0.25) / 2, 6) as spread, count(distinct (video, ct)) as n_onsets from m""")
def q_lag_estimate(spark: SparkSession, d: str) -> DataFrame:
    """How long after the end of a clause the next clip starts: median and spread."""
    h = heard(spark, d).filter("start is not null and end_sec is not null").select("video", "idx", "start", "end_sec")
    p = lag_in_cells(h, ["video"], ["start", "idx"], ["end_sec"], 600.0).filter("start - prev.end_sec > 0.6").select("video", F.col("prev.end_sec").alias("t")).distinct()
    c = clips(spark, d).select("video", F.coalesce("word_start", "video_start").alias("ct"), "file")
    m = next_within(p, c, ["video"], "t", "ct", ["file"], 600.0, 15.0).filter("match is not null").select("video", "t", F.col("match.t").alias("ct"))
    q = F.percentile(F.col("ct") - F.col("t"), [0.25, 0.5, 0.75])
    return m.agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.countDistinct("video", "ct").alias("n_onsets")).select("n", six(F.col("q")[1], "lag"), six(F.col("q")[2] / 2 - F.col("q")[0] / 2, "spread"), "n_onsets")


@add("q_baseline_errors", f"with {CLIPS}, {ASR}, h as (select distinct video, start as t from heard where start is not null), x as (select file, video, coalesce(word_start, video_start) as t, (video_start + coalesce(word_end, video_start + 1)) / 2 as mid from clips), m as (select file, min(abs(h.t - x.t)) as err, any_value(abs(mid - x.t)) as base from x join h on h.video = x.video where abs(h.t - x.t) <= 30 group by 1) select count(*) as n, round(avg(err), 6) as mean_err, round(avg(base), 6) as mean_midpoint, round(avg((err <= 1)::int), 6) as within_1, round(avg((err <= 3)::int), 6) as within_3 from m")
def q_baseline_errors(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance of clips from the nearest heard word against that from the clip's middle."""
    h = heard(spark, d).select("video", F.col("start").alias("ht"), "idx")
    x = clips(spark, d).select("file", "video", F.coalesce("word_start", "video_start").alias("t"), F.expr("(video_start + coalesce(word_end, video_start + 1)) / 2").alias("mid"))
    m = nearest(x, h, ["video"], "t", "ht", ["idx"], 600.0, 30.0).filter("match is not null").select(F.abs(F.col("match.t") - F.col("t")).alias("err"), F.abs(F.col("mid") - F.col("t")).alias("base"))
    share = lambda k: F.avg((F.col("err") <= k).cast("int"))
    return m.agg(F.count(F.lit(1)).alias("n"), six(F.avg("err"), "mean_err"), six(F.avg("base"), "mean_midpoint"), six(share(1), "within_1"), six(share(3), "within_3"))
