"""Joins: two-way differences, audits, versions, as-of, nearest, containment, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.catalog import table
from weftline.operators.coverage import periods_and_gaps
from weftline.operators.lookup import beside, lookup_join
from weftline.operators.merging import first_wins, merge_fields, prefer_version, two_way, upsert
from weftline.operators.sequences import running_sum
from weftline.operators.temporal import asof_before, in_interval, nearest, next_within, overlapping
from weftline.plans.common import ASR, CLIPS, EV, HOUR, MAN, REV, SEG, clips, events, heard, manifest, review, segments
from weftline.plans.registry import CORE
from weftline.session import cut

add = CORE.add


@add("q_orphans", """select o_orderkey as k, 'without_items' as side from orders where o_orderkey not in (select l_orderkey from lineitem) union all select distinct l_orderkey, 'without_order' from lineitem where l_orderkey not in (select o_orderkey from orders)""")
def q_orphans(spark: SparkSession, d: str) -> DataFrame:
    return two_way(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k", ("without_items", "without_order"))


@add("q_clip_orphans", f"with {CLIPS}, {REV}, r as (select distinct file from rev) select file, 'unreviewed' as side from clips where file not in (select file from r) union all select file, 'without_clip' from r where file not in (select file from clips)")
def q_clip_orphans(spark: SparkSession, d: str) -> DataFrame:
    return two_way(clips(spark, d), review(spark, d), "file", ("unreviewed", "without_clip"))


@add("q_manifest_audit", f"with {MAN}, {SEG}, a as (select video, count(*) as actual from seg where version = 'segments' group by 1) select id, try_cast(n_segs as bigint) as claimed, actual from man join a on a.video = man.id where regexp_full_match(n_segs, '[0-9]+') and try_cast(n_segs as bigint) <> actual")
def q_manifest_audit(spark: SparkSession, d: str) -> DataFrame:
    """Videos whose manifest claims another number of segments than there are."""
    actual = segments(spark, d).filter("version = 'segments'").groupBy(F.col("video").alias("id")).agg(F.count(F.lit(1)).alias("actual"))
    claimed = manifest(spark, d).filter(r"n_segs rlike '^[0-9]+$'").select("id", F.col("n_segs").try_cast("long").alias("claimed"))
    return claimed.join(actual, "id").filter("claimed <> actual").select("id", "claimed", "actual")


@add("q_version_diff", f"""with {SEG}, a as (select * from seg where version = 'segments'), b as (select * from seg where version = 'segments_revalidated')
select video, count(*) filter (where b.file is null) as only_in_a, count(*) filter (where a.file is null) as only_in_b, count(*) filter (where a.file is not null and b.file is not null and (a.start_frame is distinct from b.start_frame or a.end_frame is distinct from b.end_frame)) as n_disagree from a full join b using (video, file) group by 1""")
def q_version_diff(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    a = s.filter("version = 'segments'").select("video", "file", F.struct("start_frame", "end_frame").alias("a"))
    b = s.filter("version = 'segments_revalidated'").select("video", "file", F.struct("start_frame", "end_frame").alias("b"))
    x, y = F.col("a"), F.col("b")
    return a.join(b, ["video", "file"], "full_outer").groupBy("video").agg(F.count_if(y.isNull()).alias("only_in_a"), F.count_if(x.isNull()).alias("only_in_b"), F.count_if(x.isNotNull() & y.isNotNull() & ~x.eqNullSafe(y)).alias("n_disagree"))


@add("q_strictest_version", f"with {SEG}, r as (select *, case version when 'segments' then 1 when 'segments_revalidated' then 2 else 3 end as k from seg), m as (select *, max(k) over (partition by video) as top from r) select video, version, count(*) as n, count(*) filter (where hand_coverage is null) as n_unknown from m where k = top group by 1, 2")
def q_strictest_version(spark: SparkSession, d: str) -> DataFrame:
    s = prefer_version(segments(spark, d), ["video"], "version", ["segments", "segments_revalidated", "segments_and_gate"])
    return s.groupBy("video", "version").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hand_coverage").isNull()).alias("n_unknown"))


_OLD = "old as (select file, min(signer) as signer, min(verdict) as verdict from rev where row_no % 2 = 0 group by 1), new as (select file, max(signer) as signer, max(verdict) as verdict from rev where row_no % 2 = 1 group by 1)"


@add("q_precedence_merge", f"with {REV}, {_OLD} select file, coalesce(nullif(new.signer, ''), nullif(old.signer, '')) as signer, coalesce(nullif(new.verdict, ''), nullif(old.verdict, '')) as verdict from new full join old using (file)")
def q_precedence_merge(spark: SparkSession, d: str) -> DataFrame:
    r = review(spark, d)
    old = r.filter("row_no % 2 = 0").groupBy("file").agg(F.min("signer").alias("signer"), F.min("verdict").alias("verdict"))
    new = r.filter("row_no % 2 = 1").groupBy("file").agg(F.max("signer").alias("signer"), F.max("verdict").alias("verdict"))
    return merge_fields(new, old, "file", ["signer", "verdict"])


@add("q_upsert", f"with {MAN}, upd as (select id, '' as region, title || ' (v2)' as title from man where try_cast(case when regexp_full_match(n_segs, '[0-9]+') then n_segs end as bigint) > 5) select id, case when upd.id is null then man.region else coalesce(nullif(upd.region, ''), man.region) end as region, coalesce(upd.title, man.title) as title from man left join upd using (id)")
def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = manifest(spark, d).select("id", "region", "title")
    new = manifest(spark, d).filter(r"try_cast(case when n_segs rlike '\\A[0-9]+\\z' then n_segs end as bigint) > 5").select("id", F.lit("").alias("region"), F.concat("title", F.lit(" (v2)")).alias("title"))
    return upsert(new, old, "id", ["region"]).select("id", "region", "title")


@add("q_first_wins_dim", "with p as (select p_brand, p_partkey as first_part, p_name, row_number() over (partition by p_brand order by p_partkey) as rn from part) select l_linenumber, p_brand, p_name, count(*) as n from lineitem join p on first_part = l_partkey where rn = 1 group by 1, 2, 3")
def q_first_wins_dim(spark: SparkSession, d: str) -> DataFrame:
    dim = first_wins(table(spark, d, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], ["p_partkey"])
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_linenumber")
    return lookup_join(li, dim, ["p_partkey"], "inner").groupBy("l_linenumber", "p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"))


@add("q_coalesce_join", f"with {CLIPS}, {ASR}, f as (select word, count(*) as n from heard group by 1) select c.file, coalesce(a.n, b.n) as n_heard, case when a.n is not null then 'surface' when b.n is not null then 'word' end as matched_by from clips c left join f a on a.word = c.surface left join f b on b.word = c.word")
def q_coalesce_join(spark: SparkSession, d: str) -> DataFrame:
    """Look a clip up by its surface, else by its word."""
    freq = heard(spark, d).filter("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    c = lookup_join(clips(spark, d).select("file", "surface", "word"), freq.select(F.col("word").alias("surface"), F.col("n").alias("ns")), ["surface"])
    c = lookup_join(c, freq.select("word", F.col("n").alias("nw")), ["word"])
    return c.select("file", F.coalesce("ns", "nw").alias("n_heard"), F.when(F.col("ns").isNotNull(), "surface").when(F.col("nw").isNotNull(), "word").alias("matched_by"))


FAMILIES = {"casa": ("casa", "casas", "casita"), "agua": ("agua", "aguas"), "salud": ("salud", "saludable"), "trabajo": ("trabajo", "trabajos", "trabajar"), "niño": ("niño", "niña", "niños")}
_ACC = "translate(lower({0}), 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunaeiouun')"
_FORMS = ", ".join(f"('{k}', '{f}')" for k, fs in FAMILIES.items() for f in fs)


@add("q_form_family", f"""with {ASR}, forms as (select distinct k as family, {_ACC.format('f')} as form from (values {_FORMS}) t(k, f)), w as (select video, {_ACC.format("trim(word, ' .,;:!?¿¡')")} as form from heard) select family, form, count(*) as n, count(distinct video) as n_videos from w join forms using (form) group by 1, 2""")
def q_form_family(spark: SparkSession, d: str) -> DataFrame:
    fold = lambda c: F.translate(F.lower(c), "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunaeiouun")
    forms = spark.createDataFrame([(k, f) for k, fs in FAMILIES.items() for f in fs], "family string, f string").select("family", fold(F.col("f")).alias("form")).distinct()
    w = heard(spark, d).select("video", fold(F.expr("trim(BOTH ' .,;:!?¿¡' FROM word)")).alias("form"))
    return w.join(F.broadcast(forms), "form").groupBy("family", "form").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("video").alias("n_videos"))


_TWO = f"{EV}, p as (select * from ev where event_type = 'purchase'), c as (select user_id, us as t, min(event_id) as other from ev where event_type = 'click' group by 1, 2)"
DAY_CELL, SIX_HOURS = 24 * HOUR, 6 * HOUR


def _pair(spark: SparkSession, d: str, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    ev = events(spark, d).select("event_id", "user_id", "us", "event_type")
    return ev.filter(F.col("event_type") == a).drop("event_type"), ev.filter(F.col("event_type") == b).select("user_id", F.col("us").alias("at"), F.col("event_id").alias("other"))


@add("q_asof_back", f"with {_TWO} select p.event_id, p.user_id, c.other, p.us - c.t as us_since from p asof left join c on p.user_id = c.user_id and p.us >= c.t")
def q_asof_back(spark: SparkSession, d: str) -> DataFrame:
    p, c = _pair(spark, d, "purchase", "click")
    return asof_before(p, c, ["user_id"], "us", "at", ["other"], DAY_CELL).select("event_id", "user_id", "match.other", (F.col("us") - F.col("match.t")).alias("us_since"))


_NEXT = f"{EV}, v as (select * from ev where event_type = 'view'), nx as (select v.event_id, v.user_id, v.us, min(b.us) as nt from v left join ev b on b.user_id = v.user_id and b.event_type = 'purchase' and b.us > v.us and b.us - v.us <= {SIX_HOURS} group by 1, 2, 3)"


@add("q_asof_forward_bounded", f"with {_NEXT}, r as (select user_id, nt, count(*) as reuse from nx where nt is not null group by 1, 2) select (select count(*) from nx) as n, (select count(nt) from nx) as n_matched, (select median(nt - us)::double from nx) as med_us, max(reuse) as max_reuse, round(avg(reuse), 6) as mean_reuse from r")
def q_asof_forward_bounded(spark: SparkSession, d: str) -> DataFrame:
    v, b = _pair(spark, d, "view", "purchase")
    m = next_within(v, b, ["user_id"], "us", "at", ["other"], DAY_CELL, SIX_HOURS)
    reuse = m.filter("match is not null").groupBy("user_id", F.col("match.t").alias("t")).agg(F.count(F.lit(1)).alias("reuse")).agg(F.max("reuse").alias("max_reuse"), F.round(F.avg("reuse"), 6).alias("mean_reuse"))
    return beside(m.agg(F.count(F.lit(1)).alias("n"), F.count("match").alias("n_matched"), F.median(F.col("match.t") - F.col("us")).alias("med_us")), reuse)


@add("q_gap_reject", f"""with {_NEXT}, clicks as (select user_id, us as a, us + {2 * HOUR} as b from ev where event_type = 'click'),
pb as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as p from clicks), gr as (select *, sum(case when p is null or a > p then 1 else 0 end) over (partition by user_id order by a, b rows unbounded preceding) as g from pb), cov as (select user_id, min(a) as a, max(b) as b from gr group by user_id, g),
cv as (select event_id, coalesce(sum(case when a is not null then least(b, nt) - greatest(a, us) end), 0) as covered from nx left join cov on cov.user_id = nx.user_id and cov.a < nt and cov.b > us where nt is not null group by 1)
select nx.event_id, nt - us as delay, (nt - us - covered)::bigint as uncovered, nt - us - covered <= {2 * HOUR} as accepted from nx join cv using (event_id)""")
def q_gap_reject(spark: SparkSession, d: str) -> DataFrame:
    """A following event counts only if at most two hours between the two are uncovered by activity."""
    v, b = _pair(spark, d, "view", "purchase")
    m = next_within(v, b, ["user_id"], "us", "at", ["other"], DAY_CELL, SIX_HOURS).filter("match is not null").select("event_id", "user_id", "us", F.col("match.t").alias("nt"))
    clicks = events(spark, d).filter("event_type = 'click'").select("user_id", F.col("us").alias("a"), (F.col("us") + 2 * HOUR).alias("b"))
    cov = periods_and_gaps(clicks, ["user_id"], "a", "b", 64 * HOUR).filter("kind = 'period'").drop("kind")
    inside = overlapping(m, cov, ["user_id"], ("us", "nt"), ("a", "b"), SIX_HOURS).groupBy("event_id").agg(F.sum("overlap").alias("covered"))
    x = m.join(inside, "event_id", "left").withColumn("uncovered", F.col("nt") - F.col("us") - F.coalesce("covered", F.lit(0)))
    return x.select("event_id", (F.col("nt") - F.col("us")).alias("delay"), "uncovered", (F.col("uncovered") <= 2 * HOUR).alias("accepted"))


@add("q_point_in_interval", f"with {SEG}, {ASR}, s as (select video, start_sec, end_sec from seg where version = 'segments' and start_sec <= end_sec) select h.video, h.idx from heard h where exists (select 1 from s where s.video = h.video and (h.start + h.end_sec) / 2 between s.start_sec and s.end_sec)")
def q_point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    """Words whose middle lies in a segment."""
    s = segments(spark, d).filter("version = 'segments'").select("video", "start_sec", "end_sec")
    h = heard(spark, d).filter("start is not null and end_sec is not null").select("video", "idx", ((F.col("start") + F.col("end_sec")) / 2).alias("mid"))
    return in_interval(h, s, ["video"], "mid", "start_sec", "end_sec", 8.0, "left_semi").select("video", "idx")


@add("q_containment", f"with {SEG}, {CLIPS}, s as (select video, file as seg, start_sec, end_sec from seg where version = 'segments' and start_sec <= end_sec), c as (select file, video, word_start, word_end from clips where word_end >= word_start), m as (select c.file, s.seg, row_number() over (partition by c.file order by s.start_sec, s.seg) as rn from c join s on s.video = c.video and s.start_sec <= c.word_start and c.word_end <= s.end_sec) select file, seg from m where rn = 1")
def q_containment(spark: SparkSession, d: str) -> DataFrame:
    """The first segment that holds a whole word."""
    s = segments(spark, d).filter("version = 'segments'").select("video", F.col("file").alias("seg"), "start_sec", "end_sec")
    c = clips(spark, d).filter("word_end >= word_start").select("file", "video", "word_start", "word_end")
    m = in_interval(c, s, ["video"], "word_start", "start_sec", "end_sec", 8.0).filter("word_end <= end_sec")
    return m.groupBy("file").agg(F.min(F.struct("start_sec", "seg")).alias("m")).select("file", "m.seg")


@add("q_nearest", f"with {EV}, p as (select * from ev where event_type = 'purchase'), e as (select user_id, us as t, min(event_id) as other from ev where event_type = 'error' group by 1, 2), c as (select p.event_id, e.other, abs(e.t - p.us) as dist, row_number() over (partition by p.event_id order by abs(e.t - p.us), e.t) as rn from p join e on e.user_id = p.user_id) select event_id, other, dist from c where rn = 1")
def q_nearest(spark: SparkSession, d: str) -> DataFrame:
    p, e = _pair(spark, d, "purchase", "error")
    return nearest(p, e, ["user_id"], "us", "at", ["other"], DAY_CELL).filter("match is not null").select("event_id", "match.other", F.abs(F.col("match.t") - F.col("us")).alias("dist"))


@add("q_ambiguous_window", f"with {CLIPS}, {ASR}, h as (select video, idx, start, lower(trim(word, ' .,;:!?¿¡')) as w from heard where start is not null), m as (select c.file, count(h.idx) as n, min(h.start) as first_start from clips c left join h on h.video = c.video and h.w = lower(c.surface) and h.start between c.video_start - 0.5 and c.video_start + 4.0 group by 1) select file, case when n = 0 then 'no_match' when n = 1 then 'ok' else 'ambiguous_x' || n end as kind, first_start from m")
def q_ambiguous_window(spark: SparkSession, d: str) -> DataFrame:
    """A surface heard from 0.5 s before to 4 s after a clip's start: the earliest, and how many there are."""
    h = heard(spark, d).filter("start is not null").select("video", "idx", "start", F.lower(F.expr("trim(BOTH ' .,;:!?¿¡' FROM word)")).alias("w"))
    c = clips(spark, d).select("file", "video", F.lower("surface").alias("w"), (F.col("video_start") - 0.5).alias("a"), (F.col("video_start") + 4.0).alias("b"))
    m = in_interval(h, c, ["video", "w"], "start", "a", "b", 5.0).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"))
    kind = F.when(F.col("n").isNull(), "no_match").when(F.col("n") == 1, "ok").otherwise(F.concat(F.lit("ambiguous_x"), F.col("n").cast("string")))
    return clips(spark, d).select("file").join(m, "file", "left").select("file", kind.alias("kind"), "first_start")


@add("q_max_overlap", f"with {SEG}, a as (select video, file, start_frame as a0, end_frame as a1 from seg where version = 'segments' and start_frame < end_frame), b as (select video, file as other, start_frame as b0, end_frame as b1 from seg where version = 'segments_and_gate' and start_frame < end_frame), p as (select a.video, a.file, b.other, least(a1, b1) - greatest(a0, b0) as overlap, abs(b0 - a0) as off from a join b on a.video = b.video and a0 < b1 and b0 < a1) select video, file, other, overlap from (select *, row_number() over (partition by video, file order by overlap desc, off, other) as rn from p) where rn = 1")
def q_max_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    a = s.filter("version = 'segments'").select("video", "file", F.col("start_frame").alias("a0"), F.col("end_frame").alias("a1"))
    b = s.filter("version = 'segments_and_gate'").select("video", F.col("file").alias("other"), F.col("start_frame").alias("b0"), F.col("end_frame").alias("b1"))
    p = overlapping(a, b, ["video"], ("a0", "a1"), ("b0", "b1"), 256)
    best = p.groupBy("video", "file").agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.abs(F.col("b0") - F.col("a0")).alias("off"), "other")).alias("m"))
    return best.select("video", "file", "m.other", (-F.col("m.o")).alias("overlap"))


@add("q_fuzzy_intervals", f"with {SEG}, a as (select video, file, start_sec, end_sec from seg where version = 'segments' and start_sec is not null), b as (select video, file as other, start_sec as s2, end_sec as e2 from seg where version = 'segments_revalidated' and start_sec is not null) select a.video, a.file, b.other from a join b on a.video = b.video and abs(start_sec - s2) < 0.5 and abs(end_sec - e2) < 0.5")
def q_fuzzy_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Segments of two versions that start and end within half a second of each other."""
    s = segments(spark, d).filter("start_sec is not null")
    at = F.floor(F.col("start_sec") / 0.5).cast("long")
    a = s.filter("version = 'segments'").select("video", "file", "start_sec", "end_sec", F.explode(F.sequence(at - 1, at + 1)).alias("b"))
    b = s.filter("version = 'segments_revalidated'").select("video", F.col("file").alias("other"), F.col("start_sec").alias("s2"), F.col("end_sec").alias("e2"), at.alias("b"))
    return a.join(b, ["video", "b"]).filter("abs(start_sec - s2) < 0.5 and abs(end_sec - e2) < 0.5").select("video", "file", "other")


@add("q_range_bucket_join", "select o_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice from orders join lineitem on l_orderkey = o_orderkey and l_shipdate between o_orderdate and o_orderdate + interval 60 day")
def q_range_bucket_join(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders").select("o_orderkey", "o_orderdate"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return o.join(li, (F.col("o_orderkey") == F.col("l_orderkey")) & F.expr("l_shipdate between o_orderdate and o_orderdate + interval 60 day")).select("o_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice")


@add("q_self_pairs", f"with {CLIPS} select a.file, a.word, count(b.file) as n_links, count(case when a.video <> b.video then 1 end) as n_across from clips a left join clips b on a.word = b.word and a.file <> b.file where a.word is not null group by 1, 2")
def q_self_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every clip with its class, the word, and how many other clips it pairs with, in all and in other videos. The pairs themselves aren't written out: they are all pairs of a class, so the class says them.

    Counted per (word, video) before anything is joined, and the small counts are joined back.
    """
    a = clips(spark, d).filter("word is not null").select("file", "word", "video")
    by_video = cut(a.groupBy("word", "video").agg(F.count(F.lit(1)).alias("in_video")))
    by_word = by_video.groupBy("word").agg(F.sum("in_video").alias("in_all"), F.sum(F.when(F.col("video").isNotNull(), F.col("in_video"))).alias("in_videos"))
    told = lookup_join(lookup_join(a, by_word, ["word"]), by_video, ["word", "video"], written=True)
    return told.select("file", "word", (F.col("in_all") - 1).alias("n_links"), F.when(F.col("video").isNull(), 0).otherwise(F.col("in_videos") - F.col("in_video")).cast("long").alias("n_across"))


@add("q_multi_source_words", f"with {CLIPS}, w as (select word from clips group by 1 having count(distinct video) >= 2 and count(*) > 2) select word, count(*) as n from clips semi join w using (word) group by 1")
def q_multi_source_words(spark: SparkSession, d: str) -> DataFrame:
    return clips(spark, d).groupBy("word").agg(F.countDistinct("video").alias("v"), F.count(F.lit(1)).alias("n")).filter("v >= 2 and n > 2").select("word", "n")


@add("q_char_offsets", f"with {EV}, s as (select user_id, us, event_id from ev), a as (select *, (event_id * 7) % 50 as probe from s), st as (select user_id, row_number() over (partition by user_id order by us, event_id) - 1 as pos, us from s) select a.event_id, st.us as word_us from a join st on st.user_id = a.user_id and st.pos = a.probe // 5")
def q_char_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The word an offset falls into: the last word that starts at or before it."""
    ev = events(spark, d).select("user_id", "us", "event_id").withColumn("one", F.lit(5))
    starts = running_sum(ev, ["user_id"], ["us", "event_id"], "one", DAY_CELL, "upto").select("user_id", (F.col("upto") - 5).alias("offset"), F.col("us").alias("word_us"))
    probes = ev.select("event_id", "user_id", ((F.col("event_id") * 7) % 50).alias("probe"))
    own = asof_before(probes, starts, ["user_id"], "probe", "offset", ["word_us"], 1024)
    return own.filter("match is not null and probe - match.t < 5").select("event_id", "match.word_us")
