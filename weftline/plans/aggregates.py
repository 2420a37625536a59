"""Scans, filters and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from weftline.catalog import table
from weftline.operators.lookup import beside, lookup_join
from weftline.operators.merging import first_wins
from weftline.operators.sequences import islands, numbered
from weftline.plans.common import ASR, CLIPS, EV, HOUR, MAN, REV, SEG, clips, events, heard, manifest, review, segments, six
from weftline.plans.registry import CORE

add = CORE.add


@add("q_scan_pushdown", "select l_orderkey, l_partkey, l_extendedprice from lineitem where l_shipdate < timestamp '1996-01-01' and l_quantity >= 30 and l_returnflag = 'R'")
def q_scan_pushdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter("l_shipdate < timestamp_ntz'1996-01-01 00:00:00' and l_quantity >= 30 and l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_extendedprice")


@add("q_eligibility_hours", f"""with {SEG}, m as (select version, end_sec - start_sec as dur, coalesce(hand_coverage >= 0.6 and end_sec - start_sec >= 2, false) as ok from seg where end_sec > start_sec)
select version, count(*) as n, count(*) filter (where ok) as n_kept, sum(cast(round(dur * 1000) as bigint))::bigint as ms_before, coalesce(sum(case when ok then cast(round(dur * 1000) as bigint) end), 0)::bigint as ms_after from m group by 1""")
def q_eligibility_hours(spark: SparkSession, d: str) -> DataFrame:
    m = segments(spark, d).filter("end_sec > start_sec").select("version", (F.col("end_sec") - F.col("start_sec")).alias("dur"), F.expr("coalesce(hand_coverage >= 0.6 and end_sec - start_sec >= 2, false)").alias("ok"))
    ms = F.round(F.col("dur") * 1000).cast("long")
    return m.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_kept"), F.sum(ms).alias("ms_before"), F.coalesce(F.sum(F.when(F.col("ok"), ms)), F.lit(0)).alias("ms_after"))


# Ordered: the first keyword found in a title names the class.
PLACES = (("Santa Murelia", "norte"), ("Atlixquena", "centro"), ("Zacualpeque", "sur"), ("Puerto Olvano", "golfo"))
_CASE = " ".join(f"when title like '%{k}%' then '{v}'" for k, v in PLACES)


@add("q_region_case", f"with {MAN} select coalesce(nullif(lower(trim(region, ' ')), ''), case {_CASE} else 'none' end) as region, case when trim(coalesce(fps, ''), ' ') = '' then 'none' when fps like '%/%' then 'fraction' else 'number' end as source, count(*) as n from man group by 1, 2")
def q_region_case(spark: SparkSession, d: str) -> DataFrame:
    chain = None
    for k, v in PLACES:
        chain = (F.when if chain is None else chain.when)(F.contains("title", F.lit(k)), v)
    region = F.coalesce(F.nullif(F.lower(F.trim("region")), F.lit("")), chain.otherwise("none"))
    source = F.when(F.trim(F.coalesce("fps", F.lit(""))) == "", "none").when(F.contains("fps", F.lit("/")), "fraction").otherwise("number")
    return manifest(spark, d).groupBy(region.alias("region"), source.alias("source")).agg(F.count(F.lit(1)).alias("n"))


@add("q_id_shape", "select id, regexp_full_match(id, '[A-Za-z0-9_-]{11}') as is_id, coalesce(regexp_full_match(n_segs, '[+-]?[0-9]+'), false) as is_int, count(*) as n from manifest group by 1, 2, 3")
def q_id_shape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest").groupBy("id", F.col("id").rlike(r"\A[A-Za-z0-9_-]{11}\z").alias("is_id"), F.coalesce(F.col("n_segs").rlike(r"\A[+-]?[0-9]+\z"), F.lit(False)).alias("is_int")).agg(F.count(F.lit(1)).alias("n"))


@add("q_topk_count", f"with {ASR} select lower(trim(word, ' ')) as w, count(*) as n from heard where length(trim(word, ' ')) >= 4 group by 1 order by n desc, w limit 50")
def q_topk_count(spark: SparkSession, d: str) -> DataFrame:
    w = F.lower(F.trim("word"))
    return heard(spark, d).filter(F.length(F.trim("word")) >= 4).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(50)


@add("q_distinct_per_group", f"with {CLIPS} select word, count(*) as n_total, count(*) filter (where match_kind = 'ok') as n_ok, count(*) filter (where match_kind = 'no_match') as n_none, count(distinct video) as n_videos, count(distinct video || ':' || cast(floor(video_start) as bigint)) as n_places from clips group by 1")
def q_distinct_per_group(spark: SparkSession, d: str) -> DataFrame:
    place = F.concat("video", F.lit(":"), F.floor("video_start").cast("string"))
    k = F.col("match_kind")
    return clips(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(k == "ok").alias("n_ok"), F.count_if(k == "no_match").alias("n_none"), F.countDistinct("video").alias("n_videos"), F.countDistinct(place).alias("n_places"))


FLAGS = {"short": "n_frames < 40", "coverage": "coalesce(hand_coverage, 0) < 0.6", "turned": "end_frame <= start_frame", "missing": "start_frame is null or end_frame is null"}


@add("q_quality_rollup", f"""with {SEG}, fl as (select version, file, unnest(list_filter([{', '.join(f"case when {c} then '{k}' end" for k, c in FLAGS.items())}], lambda x: x is not null)) as flag from seg)
select coalesce(version, '(all)') as version, coalesce(flag, '(all)') as flag, count(*) as n from fl group by grouping sets ((version, flag), (version), (flag), ())""")
def q_quality_rollup(spark: SparkSession, d: str) -> DataFrame:
    flags = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in FLAGS.items()]))
    rows = segments(spark, d).select("version", F.explode(flags).alias("flag"))
    return rows.cube("version", "flag").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("version", F.lit("(all)")).alias("version"), F.coalesce("flag", F.lit("(all)")).alias("flag"), "n")


@add("q_percentiles", "select event_type, round(quantile_cont(value, 0.05), 6) as p5, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.75), 6) as p75, round(quantile_cont(value, 0.95), 6) as p95, round((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 2, 6) as spread from events group by 1")
def q_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = events(spark, d).groupBy("event_type").agg(F.percentile("value", [0.05, 0.25, 0.5, 0.75, 0.95]).alias("p"))
    return p.select("event_type", *[six(F.col("p")[i], n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95"))], six((F.col("p")[3] - F.col("p")[1]) / 2, "spread"))


@add("q_descriptive", f"with {CLIPS} select match_kind, count(word_start) as n, round(avg(word_start - video_start), 6) as mean, round(median(word_start - video_start), 6) as med, round(min(word_start - video_start), 6) as least, round(max(word_start - video_start), 6) as most, round(stddev_samp(word_start - video_start), 6) as sd, round(stddev_pop(word_start - video_start), 6) as sd_pop, round(avg(cast(abs(word_start - video_start) < 0.5 as int)), 6) as near from clips group by 1")
def q_descriptive(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("word_start") - F.col("video_start")
    return clips(spark, d).groupBy("match_kind").agg(F.count("word_start").alias("n"), six(F.avg(x), "mean"), six(F.median(x), "med"), six(F.min(x), "least"), six(F.max(x), "most"), six(F.stddev_samp(x), "sd"), six(F.stddev_pop(x), "sd_pop"), six(F.avg((F.abs(x) < 0.5).cast("int")), "near"))


@add("q_coverage", f"""with {SEG}, {EV}, v as (select version, count(*) as n, round(avg(cast(hand_coverage is null as int)), 6) as missing_coverage, round(avg(cast(start_sec is null or end_sec is null as int)), 6) as missing_seconds from seg group by 1)
select version, n, missing_coverage, missing_seconds, (select round(count(distinct (user_id, bin)) / (count(distinct user_id) * (max(bin) - min(bin) + 1.0)), 6) from ev) as bins_with_events from v""")
def q_coverage(spark: SparkSession, d: str) -> DataFrame:
    miss = lambda c, n: six(F.avg(F.expr(f"cast({c} as int)")), n)
    v = segments(spark, d).groupBy("version").agg(F.count(F.lit(1)).alias("n"), miss("hand_coverage is null", "missing_coverage"), miss("start_sec is null or end_sec is null", "missing_seconds"))
    share = events(spark, d).agg(six(F.countDistinct("user_id", "bin") / (F.countDistinct("user_id") * (F.max("bin") - F.min("bin") + 1.0)), "bins_with_events"))
    return beside(v, share)


@add("q_bin_grid", f"with {EV}, g as (select u.user_id, b.bin from (select distinct user_id from ev) u, (select unnest(generate_series((select min(bin) from ev), (select max(bin) from ev), 24)) as bin) b), a as (select user_id, (bin - (select min(bin) from ev)) // 24 * 24 + (select min(bin) from ev) as bin, sum(value) as s, count(*) as n from ev group by 1, 2) select g.user_id, g.bin, round(coalesce(s / n, 0), 6) as mean_value, coalesce(n, 0) as n from g left join a using (user_id, bin)")
def q_bin_grid(spark: SparkSession, d: str) -> DataFrame:
    """A dense grid of days: the grid is generated per user from the feed's first and last hour, so no join makes it."""
    ev = events(spark, d)
    ends = ev.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    own = beside(ev, ends).withColumn("day", F.col("lo") + F.floor((F.col("bin") - F.col("lo")) / 24).cast("long") * 24)
    a = own.groupBy("user_id", F.col("day").alias("bin")).agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    grid = beside(ev.select("user_id").distinct(), ends).select("user_id", F.explode(F.sequence("lo", "hi", F.lit(24))).alias("bin"))
    return grid.join(a, ["user_id", "bin"], "left").select("user_id", "bin", six(F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)), "mean_value"), F.coalesce("n", F.lit(0)).alias("n"))


@add("q_occupancy", f"with {ASR}, b as (select distinct video, unnest(generate_series(cast(floor(start / 0.25) as bigint), cast(floor(end_sec / 0.25) as bigint))) as bin from heard where start >= 0 and end_sec >= start) select video, count(*) as n_bins, min(bin) as first_bin, max(bin) as last_bin from b group by 1")
def q_occupancy(spark: SparkSession, d: str) -> DataFrame:
    bins = F.explode(F.sequence(F.floor(F.col("start") / 0.25).cast("long"), F.floor(F.col("end_sec") / 0.25).cast("long")))
    return heard(spark, d).filter("start >= 0 and end_sec >= start").select("video", bins.alias("bin")).distinct().groupBy("video").agg(F.count(F.lit(1)).alias("n_bins"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"))


@add("q_deciles", f"with {EV}, r as (select event_type, value, row_number() over (partition by event_type order by us, event_id) - 1 as i, count(*) over (partition by event_type) as n from ev), k as (select *, (i * 10 + 9) // n as x from r), b as (select event_type, value, least(9, ((i + 1) * 10 - 1) // n) as decile from r) select event_type, decile, count(*) as n, round(median(value), 6) as med from b group by 1, 2")
def q_deciles(spark: SparkSession, d: str) -> DataFrame:
    """Medians of ten positional parts whose bounds are k * n // 10."""
    e = events(spark, d).select("event_type", "us", "event_id", "value")
    n = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    r = lookup_join(numbered(e, ["event_type"], ["us", "event_id"], float(HOUR), "i").withColumn("i", F.col("i") - 1), n, ["event_type"])
    dec = F.least(F.lit(9), F.floor(((F.col("i") + 1) * 10 - 1) / F.col("n"))).cast("long")
    return r.groupBy("event_type", dec.alias("decile")).agg(F.count(F.lit(1)).alias("n"), six(F.median("value"), "med"))


SIX_HOURS = 6 * HOUR
_ISL = f"""{EV}, brk as (select *, case when us - lag(us) over (partition by user_id order by us, event_id) > {SIX_HOURS} then 1 else 0 end as b from ev),
grp as (select *, sum(b) over (partition by user_id order by us, event_id rows unbounded preceding) as g from brk), runs as (select user_id, g, min(us) as start_at, max(us) as end_at, count(*) as n from grp group by 1, 2)"""


@add("q_keep_largest", f"with {_ISL} select user_id, start_at, end_at, n from (select *, row_number() over (partition by user_id order by n desc, start_at) as rn from runs) where rn = 1")
def q_keep_largest(spark: SparkSession, d: str) -> DataFrame:
    runs = islands(events(spark, d), ["user_id"], "us", ["event_id"], SIX_HOURS, HOUR * 240)
    return first_wins(runs.withColumn("o", -F.col("n")), ["user_id"], ["o", "start_at"]).select("user_id", "start_at", "end_at", "n")


@add("q_verdicts_per_source", f"with {REV} select source, coalesce(nullif(trim(verdict, ' '), ''), '(unmarked)') as verdict, count(*) as n, count(*) filter (where trim(coalesce(signer, ''), ' ') = '') as n_unsigned from rev group by 1, 2")
def q_verdicts_per_source(spark: SparkSession, d: str) -> DataFrame:
    v = F.coalesce(F.nullif(F.trim("verdict"), F.lit("")), F.lit("(unmarked)"))
    return review(spark, d).groupBy("source", v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce("signer", F.lit(""))) == "").alias("n_unsigned"))


@add("q_review_progress", f"with {REV} select source, count(*) as n_rows, count(*) filter (where verdict in ('y', 'n', 'neg')) as n_reviewed, count(*) filter (where verdict = 'y' and trim(coalesce(signer, ''), ' ') = '') as n_missing_signer, min(case when coalesce(verdict, '') = '' then row_no end) as next_row from rev group by 1")
def q_review_progress(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("verdict")
    return review(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(v.isin("y", "n", "neg")).alias("n_reviewed"), F.count_if((v == "y") & (F.trim(F.coalesce("signer", F.lit(""))) == "")).alias("n_missing_signer"), F.min(F.when(F.coalesce(v, F.lit("")) == "", F.col("row_no"))).alias("next_row"))


@add("q_label_checks", f"with {CLIPS} select word, count(*) as n, count(*) > 1 as repeated, length(word) < 2 or length(word) > 60 as odd_length, not regexp_matches(word, '[a-zA-Z]') as no_letter from clips group by 1, 4, 5")
def q_label_checks(spark: SparkSession, d: str) -> DataFrame:
    g = clips(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return g.select("word", "n", (F.col("n") > 1).alias("repeated"), ((F.length("word") < 2) | (F.length("word") > 60)).alias("odd_length"), (~F.col("word").rlike("[a-zA-Z]")).alias("no_letter"))


@add("q_signing_ratio", f"""with {SEG}, {ASR}, s as (select video, sum(end_sec - start_sec) as signing from seg where end_sec > start_sec and version = 'segments' group by 1), h as (select video, sum(end_sec - start) as speech from heard where end_sec >= start and start >= 0 group by 1)
select count(*) as n_videos, round(sum(signing) / sum(speech), 6) as ratio from s join h using (video)""")
def q_signing_ratio(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).filter("end_sec > start_sec and version = 'segments'").groupBy("video").agg(F.sum(F.expr("end_sec - start_sec")).alias("signing"))
    h = heard(spark, d).filter("end_sec >= start and start >= 0").groupBy("video").agg(F.sum(F.expr("end_sec - start")).alias("speech"))
    return s.join(h, "video").agg(F.count(F.lit(1)).alias("n_videos"), six(F.sum("signing") / F.sum("speech"), "ratio"))


@add("q_revenue_by_nation", """select n_name, r_name, l_returnflag, count(*) as n, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18, 4))) as double) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where o_orderdate >= timestamp '1996-01-01' group by 1, 2, 3""")
def q_revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """A star: the small dimensions are looked up, the two large tables meet on their key."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    buyers = lookup_join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), places, ["c_nationkey"], "inner").withColumnRenamed("c_custkey", "o_custkey")
    o = lookup_join(table(spark, d, "orders").filter("o_orderdate >= timestamp_ntz'1996-01-01 00:00:00'").select("o_orderkey", "o_custkey"), buyers, ["o_custkey"], "inner")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return li.join(o, "o_orderkey").groupBy("n_name", "r_name", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r").cast("decimal(18,4)")).cast("double").alias("revenue"))
