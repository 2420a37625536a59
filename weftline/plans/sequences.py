"""Windows and ordered sequences: islands, runs, rolling statistics, onsets, bursts, interpolation, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from weftline.operators.lookup import beside, distinct_rows, lookup_join
from weftline.functions.text import words
from weftline.operators import sequences as S
from weftline.operators.coverage import periods_and_gaps
from weftline.catalog import table
from weftline.plans.aggregates import _ISL, SIX_HOURS
from weftline.plans.common import ASR, EV, HOUR, SEG, events, heard, segments, six
from weftline.plans.registry import CORE

add = CORE.add
CELL = 240 * HOUR


@add("q_islands", f"with {_ISL}, e as (select min(us) as lo, max(us) as hi from ev) select user_id, greatest(start_at - {HOUR}, lo) as start_at, least(end_at + {HOUR}, hi) as end_at, n from runs, e where n >= 3")
def q_islands(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with gaps of six hours at most and three events at least, padded by an hour and clamped to the feed."""
    ev = events(spark, d)
    runs = S.islands(ev, ["user_id"], "us", ["event_id"], SIX_HOURS, CELL, 3, (HOUR, HOUR))
    ends = ev.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    return beside(runs, ends).select("user_id", F.greatest("start_at", "lo").alias("start_at"), F.least("end_at", "hi").alias("end_at"), "n")


_STILL = f"{EV}, g as (select user_id, bin, avg(value) < 20 as still from ev group by 1, 2), r as (select *, row_number() over (partition by user_id order by bin) - row_number() over (partition by user_id, still order by bin) as k from g), runs as (select user_id, still, min(bin) as from_bin, max(bin) as to_bin, count(*) as n from r group by user_id, still, k)"


def still_bins(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id", "bin").agg((F.avg("value") < 20).alias("still"))


@add("q_bool_runs", f"with {_STILL} select user_id, still, from_bin, to_bin, n from runs")
def q_bool_runs(spark: SparkSession, d: str) -> DataFrame:
    return S.runs_of(still_bins(spark, d), ["user_id"], "bin", "still").select("user_id", "still", F.col("from").alias("from_bin"), F.col("to").alias("to_bin"), "n")


@add("q_longest_still", f"with {_STILL} select user_id, coalesce(max(case when still then n end), 0)::bigint as longest from runs group by 1")
def q_longest_still(spark: SparkSession, d: str) -> DataFrame:
    return S.longest_run(still_bins(spark, d), ["user_id"], "bin", "still", True)


@add("q_trim", f"with {EV}, s as (select user_id, min(bin) - 12 as a, max(bin) + 12 as b from ev where event_type = 'purchase' group by 1) select event_id, ev.user_id from ev join s on s.user_id = ev.user_id and bin between a and b")
def q_trim(spark: SparkSession, d: str) -> DataFrame:
    return S.trim(events(spark, d).withColumn("on", F.col("event_type") == "purchase"), ["user_id"], "bin", "on", 12).select("event_id", "user_id")


@add("q_overlap_check", f"with {SEG}, p as (select video, version, file, start_frame, lag(end_frame) over (partition by video, version order by start_frame, file) as prev_end from seg where start_frame is not null and end_frame is not null) select video, version, file, start_frame, prev_end from p where start_frame < prev_end")
def q_overlap_check(spark: SparkSession, d: str) -> DataFrame:
    """Segments that start before the one before them ends (adjacent rows only)."""
    s = segments(spark, d).filter("start_frame is not null and end_frame is not null").select("video", "version", "file", "start_frame", "end_frame")
    return S.lag_in_cells(s, ["video", "version"], ["start_frame", "file"], ["end_frame"], 1 << 14).filter("start_frame < prev.end_frame").select("video", "version", "file", "start_frame", F.col("prev.end_frame").alias("prev_end"))


@add("q_monotonic", f"with {ASR}, p as (select video, idx, start, lag(start) over (partition by video order by idx) as prev_start from heard) select video, idx, start, prev_start from p where start < prev_start - 1e-6")
def q_monotonic(spark: SparkSession, d: str) -> DataFrame:
    """Words that start before the word before them in list order."""
    h = heard(spark, d).select("video", "idx", "start")
    return S.lag_in_cells(h, ["video"], ["idx"], ["start"], 4096).filter("start < prev.start - 1e-6").select("video", "idx", "start", F.col("prev.start").alias("prev_start"))


@add("q_pause_events", f"with {ASR}, p as (select video, idx, end_sec, lead(start) over (partition by video order by start, idx) as next_start from heard where start is not null and end_sec is not null) select video, idx, end_sec, next_start from p where next_start - end_sec > 0.6")
def q_pause_events(spark: SparkSession, d: str) -> DataFrame:
    """Words followed by a pause of more than 0.6 s. Seen from the word after the pause."""
    h = heard(spark, d).filter("start is not null and end_sec is not null").select("video", "idx", "start", "end_sec")
    p = S.lag_in_cells(h, ["video"], ["start", "idx"], ["idx", "end_sec"], 600.0)
    return p.filter("start - prev.end_sec > 0.6").select("video", F.col("prev.idx").alias("idx"), F.col("prev.end_sec").alias("end_sec"), F.col("start").alias("next_start"))


@add("q_velocity", f"with {EV} select event_id, round(value - coalesce(lag(value) over (partition by user_id order by us, event_id), value), 6) as v from ev")
def q_velocity(spark: SparkSession, d: str) -> DataFrame:
    p = S.lag_in_cells(events(spark, d).select("event_id", "user_id", "us", "value"), ["user_id"], ["us", "event_id"], ["value"], CELL)
    return p.select("event_id", six(F.col("value") - F.coalesce("prev.value", "value"), "v"))


@add("q_rolling", f"""with {EV}, k as (select *, case when event_id % 3 > 0 then value end as known from ev) select event_id, round(avg(value) over (w rows between 5 preceding and 5 following), 6) as roll_mean, round(stddev_pop(value) over (w rows between 5 preceding and 5 following), 6) as roll_std, round(sum(value) over (w rows between 2 preceding and 1 following) / 4, 6) as ma,
round(case when count(known) over (w rows between 2 preceding and 2 following) >= 3 then avg(known) over (w rows between 2 preceding and 2 following) end, 6) as avg_known from k window w as (partition by user_id order by us, event_id)""")
def q_rolling(spark: SparkSession, d: str) -> DataFrame:
    k, o = ["user_id"], ["us", "event_id"]
    ev = events(spark, d).withColumn("known", F.when(F.col("event_id") % 3 > 0, F.col("value")))
    x = S.in_frames(ev, k, o, S.rolling("value", 5) | S.moving_average("value", 4) | S.average_of_known("known", 2, 3), CELL)
    return x.select("event_id", *[six(F.col(c), c) for c in ("roll_mean", "roll_std", "ma", "avg_known")])


@add("q_robust_z", f"with {EV}, m as (select *, median(value) over (partition by user_id) as med, count(value) over (partition by user_id) as n from ev), k as (select *, median(abs(value - med)) over (partition by user_id) as mad from m) select event_id, round(case when n < 3 then null when mad < 1e-9 then 0 else (value - med) / (1.4826 * mad) end, 6) as z from k")
def q_robust_z(spark: SparkSession, d: str) -> DataFrame:
    return S.robust_z(events(spark, d).select("event_id", "user_id", "value"), ["user_id"], "value").select("event_id", six(F.col("z"), "z"))


_BINS = f"{EV}, g as (select user_id, bin // 6 as b6, avg(value) as v from ev group by 1, 2), w as (select *, avg(v) over (partition by user_id order by b6 rows between 10 preceding and 10 following) as rm, stddev_pop(v) over (partition by user_id order by b6 rows between 10 preceding and 10 following) as rs from g), u as (select *, v > 45 as up, v > rm + 0.3 * rs as rup, lag(v > 45) over q as pu, lag(v > rm + 0.3 * rs) over q as pru, count(*) over (q rows between 2 preceding and 1 preceding) as nb, bool_and(v < 40) over (q rows between 2 preceding and 1 preceding) as calm, bool_and(v < rm) over (q rows between 2 preceding and 1 preceding) as rcalm from w window q as (partition by user_id order by b6))"


@add("q_onsets", f"with {_BINS} select 'global' as kind, user_id, b6 from u where up and not coalesce(pu, false) and nb = 2 and calm union all select 'rolling', user_id, b6 from u where rup and not coalesce(pru, false) and nb = 2 and rcalm")
def q_onsets(spark: SparkSession, d: str) -> DataFrame:
    """Rises after a lull of two bins, by fixed thresholds and by those of the surrounding bins."""
    g = events(spark, d).groupBy("user_id", F.floor(F.col("bin") / 6).alias("b6")).agg(F.avg("value").alias("v"))
    fixed = S.onsets(g, ["user_id"], "b6", "v", F.lit(45.0), F.lit(40.0), 2).select(F.lit("global").alias("kind"), "user_id", "b6")
    own = S.in_frames(g, ["user_id"], ["b6"], S.rolling("v", 10))
    local = S.onsets(own, ["user_id"], "b6", "v", F.col("roll_mean") + 0.3 * F.col("roll_std"), F.col("roll_mean"), 2).select(F.lit("rolling").alias("kind"), "user_id", "b6")
    return fixed.unionByName(local)


@add("q_bursts", f"""with {EV}, f as (select user_id, bin from ev group by 1, 2 having avg(value) > 20), b as (select *, case when bin - lag(bin) over (partition by user_id order by bin) > 6 then 1 else 0 end as k from f), g as (select *, sum(k) over (partition by user_id order by bin rows unbounded preceding) as gr from b),
r as (select user_id, min(bin) as a, max(bin) as z from g group by user_id, gr having max(bin) - min(bin) + 1 >= 6), p as (select *, max(z) over (partition by user_id order by a, z rows between unbounded preceding and 1 preceding) as pz from r), q as (select *, sum(case when a - pz > 10 then 1 else 0 end) over (partition by user_id order by a, z rows unbounded preceding) as gg from p) select user_id, min(a) as onset, max(z) as "offset" from q group by user_id, gg""")
def q_bursts(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).groupBy("user_id", "bin").agg((F.avg("value") > 20).alias("active"))
    return S.bursts(g, ["user_id"], "bin", "active", 5, 6, 10)


MONTH = 30 * 24 * HOUR
_IV = f"o as (select o_custkey, epoch_us(o_orderdate) as a, epoch_us(o_orderdate) + {MONTH} as b from orders), pb as (select *, max(b) over (partition by o_custkey order by a, b rows between unbounded preceding and 1 preceding) as p from o), gr as (select *, sum(case when p is null or a > p then 1 else 0 end) over (partition by o_custkey order by a, b rows unbounded preceding) as g from pb), m as (select o_custkey, min(a) as a, max(b) as b from gr group by o_custkey, g)"


def order_months(spark: SparkSession, d: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)")
    return table(spark, d, "orders").select("o_custkey", us.alias("a"), (us + MONTH).alias("b"))


@add("q_merge_intervals", f"with {_IV} select o_custkey, a, b from m")
def q_merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(order_months(spark, d), ["o_custkey"], "a", "b", 12 * MONTH).filter("kind = 'period'").drop("kind")


@add("q_complement", f"with {_IV}, l as (select o_custkey, lag(b) over (partition by o_custkey order by a) as gap_start, a as gap_end from m), ends as (select min(epoch_us(o_orderdate)) as lo, max(epoch_us(o_orderdate)) + {MONTH} as hi from orders), x as (select o_custkey, gap_start, gap_end from l where gap_start is not null union all select o_custkey, lo, min(a) from m, ends group by 1, 2 union all select o_custkey, max(b), hi from m, ends group by 1, 3) select * from x where gap_end - gap_start >= {24 * HOUR}")
def q_complement(spark: SparkSession, d: str) -> DataFrame:
    """The time a customer has no order running, of a day at least, from the first to the last order of all: head and tail included."""
    both = periods_and_gaps(order_months(spark, d), ["o_custkey"], "a", "b", 12 * MONTH)
    ends = order_months(spark, d).agg(F.min("a").alias("lo"), F.max("b").alias("hi"))
    outer = beside(both.filter("kind = 'period'").groupBy("o_custkey").agg(F.min("a").alias("a"), F.max("b").alias("b")), ends)
    gaps = both.filter("kind = 'gap'").select("o_custkey", F.col("a").alias("gap_start"), F.col("b").alias("gap_end"))
    x = gaps.unionByName(outer.select("o_custkey", F.col("lo").alias("gap_start"), F.col("a").alias("gap_end"))).unionByName(outer.select("o_custkey", F.col("b").alias("gap_start"), F.col("hi").alias("gap_end")))
    return x.filter(F.col("gap_end") - F.col("gap_start") >= 24 * HOUR)


@add("q_interp", f"""with {ASR}, k as (select video, idx, start, last_value(start ignore nulls) over a as s0, first_value(start ignore nulls) over b as s1, last_value(case when start is not null then idx end ignore nulls) over a as i0, first_value(case when start is not null then idx end ignore nulls) over b as i1, last_value(word ignore nulls) over a as carried from heard window a as (partition by video order by idx rows unbounded preceding), b as (partition by video order by idx rows between current row and unbounded following))
select video, idx, carried, round(coalesce(start, s0 + (s1 - s0) * (idx - i0) / nullif(i1 - i0, 0), s0, s1), 6) as start from k""")
def q_interp(spark: SparkSession, d: str) -> DataFrame:
    """Missing starts on the line between the known ones by index, and the last known word carried forward."""
    h = distinct_rows(S.in_cells(table(spark, d, "asr"), ["video"], "idx"), ["video", "__cell", "idx"])
    h = S.beside_known(h, ["video"], "idx", ["start", "word"])
    return h.select("video", "idx", F.col("word_before.v").alias("carried"), six(S.on_the_line("idx", "start"), "start"))


@add("q_sentences", f"with {ASR}, c as (select *, coalesce(sum(case when regexp_matches(word, '[.!?…][»\"]* *$') then 1 else 0 end) over (partition by video order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as sentence from heard) select video, sentence, count(*) as n_words, min(start) as start, max(end_sec) as end_sec from c group by 1, 2")
def q_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Words grouped into sentences, each closed after terminal punctuation."""
    c = S.groups_closed_by(heard(spark, d), ["video"], "idx", F.col("word").rlike('[.!?…][»"]* *$'), "sentence")
    return c.groupBy("video", F.col("sentence").cast("long").alias("sentence")).agg(F.count(F.lit(1)).alias("n_words"), F.min("start").alias("start"), F.max("end_sec").alias("end_sec"))


_ENDS = "lambda x: regexp_matches(x, '[.!?…]\\s*$')"


@add("q_context", f"""with {ASR}, c as (select video, idx, word, coalesce(list(word) over (partition by video order by idx rows between 15 preceding and 1 preceding), []) as b, list(word) over (partition by video order by idx rows between current row and 15 following) as a from heard where word is not null),
h as (select *, list_position(list_transform(list_reverse(b), {_ENDS}), true) as pb, list_position(list_transform(a[1:15], {_ENDS}), true) as pa from c where lower(trim(word, ' .,;:!?¿¡')) = 'agua'), n as (select *, case when coalesce(pb, 0) = 0 then len(b) else pb - 1 end as l, case when coalesce(pa, 0) = 0 then least(15, len(a) - 1) else pa - 1 end as r from h),
m as (select *, case when l + r < 3 then least(12, len(b)) else l end as l2, case when l + r < 3 then least(12, len(a) - 1) else r end as r2 from n)
select video, idx, array_to_string(list_transform(b[len(b) - l2 + 1:] || ['**' || trim(word, ' ') || '**'] || a[2:r2 + 1], lambda x: trim(x, ' ')), ' ') as context from m""")
def q_context(spark: SparkSession, d: str) -> DataFrame:
    """The sentence around each hit, the hit marked: up to 15 words to each side, to the sentence's edge; 12 where that gives less than four words."""
    h = heard(spark, d).filter("word is not null").select("video", "idx", "word")
    return S.contexts(h, ["video"], ["idx"], "word", F.lower(F.expr("trim(BOTH ' .,;:!?¿¡' FROM word)")) == "agua", 15, 12, 4, "context", 4096).select("video", "idx", "context")


@add("q_lookback_flag", f"with {ASR}, f as (select video, idx, word, coalesce(bool_or(lower(trim(word, ' .,;:!?¿¡')) in ('no', 'sin', 'nunca')) over (partition by video order by idx rows between 2 preceding and 1 preceding), false) as negated from heard) select lower(trim(word, ' .,;:!?¿¡')) as w, count(*) as n, count(*) filter (where negated) as n_negated from f where word is not null group by 1 having count(*) filter (where negated) > 0")
def q_lookback_flag(spark: SparkSession, d: str) -> DataFrame:
    """Words negated by one of the two words before them."""
    w = F.lower(F.expr("trim(BOTH ' .,;:!?¿¡' FROM word)"))
    h = heard(spark, d).withColumn("w", w).withColumn("neg", F.col("w").isin("no", "sin", "nunca"))
    rows, w, own = S.in_row_blocks(h.select("video", "idx", "word", "w", "neg"), ["video"], ["idx"], 4096, 2, 0)
    h = rows.withColumn("negated", F.coalesce(F.max("neg").over(w.rowsBetween(-2, -1)), F.lit(False))).filter(own & F.col("word").isNotNull())
    return h.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.count_if("negated").alias("n_negated")).filter("n_negated > 0")


@add("q_thin_minsep", f"with recursive {EV}, o as (select user_id, us, event_id, row_number() over (partition by user_id order by us, event_id) as rn from ev), r as (select user_id, rn, us, event_id, us as last, true as kept from o where rn = 1 union all select o.user_id, o.rn, o.us, o.event_id, case when o.us - r.last >= {SIX_HOURS} then o.us else r.last end, o.us - r.last >= {SIX_HOURS} from r join o on o.user_id = r.user_id and o.rn = r.rn + 1) select user_id, event_id, us from r where kept")
def q_thin_minsep(spark: SparkSession, d: str) -> DataFrame:
    """Events at least six hours after the last kept one."""
    return S.thin(events(spark, d).select("user_id", "event_id", "us"), ["user_id"], "us", "event_id", SIX_HOURS)


@add("q_stride_sample", f"with {EV}, r as (select event_type, event_id, row_number() over (partition by event_type order by event_id) as rn from ev) select event_type, event_id from r where (rn - 1) % 7 = 0")
def q_stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.stride(events(spark, d).select("event_type", "event_id"), ["event_type"], ["event_id"], 7)


@add("q_sliding_median", f"with {EV} select event_id, round(median(value) over w, 6) as med, round(quantile_cont(value, 0.75) over w - quantile_cont(value, 0.25) over w, 6) as iqr from ev window w as (partition by user_id order by us, event_id rows between current row and 19 following) qualify count(*) over w = 20")
def q_sliding_median(spark: SparkSession, d: str) -> DataFrame:
    """Median and interquartile range of each event and the 19 after it; incomplete windows are dropped."""
    e, w, own = S.in_row_blocks(events(spark, d).select("event_id", "user_id", "us", "value"), ["user_id"], ["us", "event_id"], CELL, 0, 19)
    x = e.withColumn("v", F.collect_list("value").over(w)).filter(own & (F.size("v") == 20)).withColumn("s", F.array_sort("v"))
    at = lambda q: F.get("s", F.lit(int(q * 19))) + (F.get("s", F.lit(int(q * 19) + 1)) - F.get("s", F.lit(int(q * 19)))) * (q * 19 - int(q * 19))
    return x.select("event_id", six(at(0.5), "med"), six(at(0.75) - at(0.25), "iqr"))


@add("q_density", f"with {EV} select event_id, count(*) over (partition by event_type order by us range between {HOUR} preceding and {HOUR} following) as n_near from ev")
def q_density(spark: SparkSession, d: str) -> DataFrame:
    return S.density(events(spark, d).select("event_id", "event_type", "us"), ["event_type"], "us", HOUR).select("event_id", "n_near")


@add("q_extrema", f"with {EV}, a as (select user_id, us, event_id, sign(value - lag(value) over (partition by user_id order by us, event_id)) as s from ev), b as (select *, lag(s) over (partition by user_id order by us, event_id) as p from a where s <> 0) select u.user_id, coalesce(sum(case when p is not null and s <> p then 1 end), 0)::bigint as n_extrema from (select distinct user_id from ev) u left join b using (user_id) group by 1")
def q_extrema(spark: SparkSession, d: str) -> DataFrame:
    return S.extrema(events(spark, d).select("user_id", "us", "event_id", "value"), ["user_id"], ["us", "event_id"], "value", CELL)


@add("q_word_positions", f"with {ASR}, t as (select video, idx, row_number() over (partition by video order by idx) - 1 as i, count(*) over (partition by video) as n from heard where length(trim(word, ' .,;:!?¿¡')) >= 4) select video, idx, round(case when n > 1 then i / (n - 1.0) else 0 end, 6) as position from t")
def q_word_positions(spark: SparkSession, d: str) -> DataFrame:
    """Place of each content word in its video, from 0 to 1."""
    h = heard(spark, d).filter(F.length(F.expr("trim(BOTH ' .,;:!?¿¡' FROM word)")) >= 4)
    n = h.groupBy("video").agg(F.count(F.lit(1)).alias("n"))
    placed = lookup_join(S.numbered(h.select("video", "idx"), ["video"], ["idx"], 4096, "i"), n, ["video"])
    return placed.select("video", "idx", six(F.when(F.col("n") > 1, (F.col("i") - 1) / (F.col("n") - 1)).otherwise(F.lit(0.0)), "position"))


@add("q_z_score", f"with {EV}, g as (select user_id, bin // 24 as day, sum(value) as v from ev group by 1, 2), s as (select *, avg(v) over (partition by user_id) as m, stddev_pop(v) over (partition by user_id) as sd from g) select user_id, day, round(case when sd > 1e-9 then (v - m) / sd else v - m end, 6) as z from s")
def q_z_score(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).groupBy("user_id", F.floor(F.col("bin") / 24).alias("day")).agg(F.sum("value").alias("v"))
    return S.z_score(g, "v", ["user_id"]).select("user_id", "day", six(F.col("z"), "z"))


@add("q_document_sentences", "with t as (select doc_id, unnest(regexp_extract_all(text, '[^.!?…]+[.!?…]?')) as s from documents where text is not null) select doc_id, count(*) as n_sentences, sum(len(regexp_extract_all(s, '[\\p{L}\\p{N}_]+')))::bigint as n_words from t group by 1")
def q_document_sentences(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[^.!?…]+[.!?…]?"), F.lit(0))).alias("s"))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.size(words(F.col("s")))).alias("n_words"))
