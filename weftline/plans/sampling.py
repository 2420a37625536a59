"""Strata, quotas, seeded samples, sets, splits and padded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.operators.lookup import beside
from weftline.catalog import table
from weftline.functions.vectors import pad
from weftline.operators.merging import vocabulary
from weftline.operators.sampling import cap, quota_fill, resampled, round_robin, seeded
from weftline.plans.common import CLIPS, EV, REV, clips, events, review
from weftline.plans.registry import CORE

add = CORE.add


@add("q_round_robin", f"with {CLIPS}, s as (select *, row_number() over (partition by word, video order by video_start, file) as rn, count(*) over (partition by word, video) as size from clips), t as (select *, row_number() over (partition by word order by rn, size desc, video) as pick from s) select word, video, file, pick from t where pick <= 7")
def q_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Up to seven clips a word, one of each video in turn."""
    return round_robin(clips(spark, d).select("word", "video", "file", "video_start"), "word", "video", ["video_start", "file"], 7).select("word", "video", "file", F.col("pick").cast("long").alias("pick"))


@add("q_cap_per_group", f"with {CLIPS} select word, file from (select word, file, row_number() over (partition by word order by video_start, file) as rn from clips) where rn <= 3")
def q_cap_per_group(spark: SparkSession, d: str) -> DataFrame:
    return cap(clips(spark, d).select("word", "file", "video_start"), ["word"], ["video_start", "file"], 3).select("word", "file")


@add("q_seeded_sample", f"with {CLIPS}, k as (select word, file, row_number() over (partition by word order by md5('17:' || file), file) as rn from clips) select word, file from k where rn <= 4")
def q_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """Four clips of each word in the order of a seeded hash."""
    return seeded(clips(spark, d).select("word", "file"), ["word"], "file", 4, 17)


@add("q_candidate_size", f"with {CLIPS}, f as (select word, min(file) as first from clips group by 1), m as (select c.word, file, first, rep from clips c join f using (word), (select unnest(generate_series(1, 20)) as rep)), k as (select *, row_number() over (partition by word, rep order by (file = first)::int desc, md5('5:' || rep || ':' || file), file) as rn from m) select word, count(distinct file) as n_reached, count_if(file = first)::bigint as n_first, count(*) as n from k where rn <= 3 group by 1")
def q_candidate_size(spark: SparkSession, d: str) -> DataFrame:
    """Twenty subsets of three clips of each word, its first clip always among them, and how many clips the subsets reach."""
    c = clips(spark, d).select("word", "file")
    firsts = c.groupBy("word").agg(F.min("file").alias("first"))
    own = c.join(firsts, "word")
    r = resampled(own, "word", "file", F.col("file") == F.col("first"), 3, 20, 5)
    return r.groupBy("word").agg(F.countDistinct("file").alias("n_reached"), F.count_if(F.col("file") == F.col("first")).alias("n_first"), F.count(F.lit(1)).alias("n"))


@add("q_quota_fill", f"with {CLIPS}, w as (select word, count(*) as n from clips group by 1), m as (select *, case when n >= 12 then 0 else 1 end as p from w), k as (select *, row_number() over (partition by p order by word) - 1 as i, sum(1 - p) over () as a, sum(p) over () as b from m), s as (select *, case when p = 0 then 0 when i % greatest(1, b // greatest(1, 200 - a)) <> 0 then 1 else 0 end as q from k) select word, n from s order by p, q, i limit 200")
def q_quota_fill(spark: SparkSession, d: str) -> DataFrame:
    """200 words: the frequent ones, topped up evenly along the alphabet."""
    w = clips(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return quota_fill(w, F.col("n") >= 12, ["word"], 200).select("word", "n")


@add("q_set_ops", f"with {CLIPS}, {REV}, a as (select distinct word from clips), b as (select distinct word from rev where word is not null) select 'both' as side, word from a where word in (select word from b) union all select 'only_clips', word from a where word not in (select word from b) union all select 'only_review', word from b where word not in (select word from a)")
def q_set_ops(spark: SparkSession, d: str) -> DataFrame:
    a, b = clips(spark, d).select("word"), review(spark, d).select("word").filter("word is not null")
    tag = lambda df, s: df.select(F.lit(s).alias("side"), "word")
    return tag(a.intersect(b), "both").unionByName(tag(a.distinct().exceptAll(b.distinct()), "only_clips")).unionByName(tag(b.distinct().exceptAll(a.distinct()), "only_review"))


@add("q_vocabulary", f"with {CLIPS} select word, row_number() over (order by word) - 1 as id, n from (select word, count(*) as n from clips group by 1 having count(*) >= 5)")
def q_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary(clips(spark, d), "word", 5)


@add("q_loso", f"with {REV}, v as (select distinct source from rev), r as (select source, count(*) as n from rev where verdict = 'y' group by 1), t as (select sum(n) as total from r) select v.source as held_out, coalesce(r.n, 0)::bigint as n_test, (total - coalesce(r.n, 0))::bigint as n_train from v left join r using (source), t")
def q_loso(spark: SparkSession, d: str) -> DataFrame:
    """Leave one source out: rows in the test and the training part of every split, from one aggregate."""
    r = review(spark, d)
    n = r.groupBy("source").agg(F.count_if(F.col("verdict") == "y").alias("n_test"))
    total = n.agg(F.sum("n_test").alias("total"))
    return beside(n, total).select(F.col("source").alias("held_out"), "n_test", (F.col("total") - F.col("n_test")).alias("n_train"))


@add("q_pad_batch", f"with {EV}, s as (select user_id, bin // 24 as day, list(value order by us, event_id) as vals from ev group by 1, 2), m as (select max(len(vals)) as width from s) select user_id, day, len(vals)::bigint as length, list_resize(vals, width, 0.0) as padded from s, m")
def q_pad_batch(spark: SparkSession, d: str) -> DataFrame:
    """Values of a user's day, padded with 0 to the length of the longest."""
    s = events(spark, d).groupBy("user_id", F.floor(F.col("bin") / 24).alias("day")).agg(F.array_sort(F.collect_list(F.struct("us", "event_id", "value"))).alias("v"))
    s = s.select("user_id", "day", F.transform("v", lambda x: x["value"]).alias("vals"))
    width = s.agg(F.max(F.size("vals")).alias("width"))
    return beside(s, width).select("user_id", "day", F.size("vals").cast("long").alias("length"), pad(F.col("vals"), F.col("width")).alias("padded"))


@add("q_candidates_reasons", f"with {CLIPS} select case when length(word) < 4 then 'short' when match_kind = 'no_match' then 'no_match' when word_end is null then 'no_end' when match_kind like 'ambiguous%' then 'ambiguous' else 'kept' end as reason, count(*) as n from clips group by 1")
def q_candidates_reasons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("match_kind")
    reason = F.when(F.length("word") < 4, "short").when(k == "no_match", "no_match").when(F.col("word_end").isNull(), "no_end").when(F.startswith(k, F.lit("ambiguous")), "ambiguous").otherwise("kept")
    return clips(spark, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@add("q_verdict_route", f"with {REV}, r as (select source, row_no, file, word, case verdict when 'y' then 'gold' when 'neg' then 'gold_negated' when 'n' then 'implicit' else 'skip' end as route, row_number() over (partition by file, case verdict when 'y' then 'gold' when 'neg' then 'gold_negated' when 'n' then 'implicit' else 'skip' end order by source, row_no) as rn from rev) select route, file, case when route = 'gold_negated' then word || ':neg' else word end as label from r where rn = 1 and route <> 'skip'")
def q_verdict_route(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts to their targets, one row per file and target: the first."""
    v = F.col("verdict")
    route = F.when(v == "y", "gold").when(v == "neg", "gold_negated").when(v == "n", "implicit").otherwise("skip")
    r = review(spark, d).withColumn("route", route).filter("route <> 'skip'").groupBy("file", "route").agg(F.min_by("word", F.struct("source", "row_no")).alias("word"))
    return r.select("route", "file", F.when(F.col("route") == "gold_negated", F.concat("word", F.lit(":neg"))).otherwise(F.col("word")).alias("label"))


@add("q_known_parts", "select p_brand, count(*) as n from part where p_size between 10 and 20 and p_name not like '%widget%' group by 1")
def q_known_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_size between 10 and 20 and p_name not like '%widget%'").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
