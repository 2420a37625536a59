"""Recovering times and records: fallbacks, verified moments, relative order, spans and their bins, registries and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from weftline.catalog import table
from weftline.functions import predicates as P, text as T
from weftline.operators.coverage import periods_and_gaps
from weftline.operators.lookup import beside, lookup_join
from weftline.operators.merging import first_wins, insert_new, latest
from weftline.operators.sampling import cap
from weftline.operators.temporal import in_interval, nearest, neighbours
from weftline.plans.common import ASR, CLIPS, MAN, REV, SEG, clips, heard, manifest, review, segments, six
from weftline.plans.joins import FAMILIES
from weftline.plans.registry import CORE
from weftline.plans.texts import _BARE, _FOLD
from weftline.sources import readers, sinks

add = CORE.add
_NUMBER = r"^ *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+) *$"


def number(c):
    """A plain decimal number, or null."""
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))


def number_sql(c: str) -> str:
    return f"case when regexp_matches({c}, '{_NUMBER}') then try_cast(trim({c}, ' ') as double) end"


@add("q_identical_cue", f"""with {CLIPS}, {ASR}, c as (select file, video, {_FOLD.format('surface')} as k, coalesce(word_start, video_start) as t from clips), h as (select video, {_FOLD.format('word')} as k, start as t, min(idx) as idx from heard where start is not null group by 1, 2, 3),
j as (select c.file, h.idx, row_number() over (partition by c.file order by abs(h.t - c.t), h.t) as rn from c join h using (video, k) where c.t is not null) select file, idx from j where rn = 1""")
def q_identical_cue(spark: SparkSession, d: str) -> DataFrame:
    """For every clip the heard word of its video with the same folded text that is nearest in time."""
    c = clips(spark, d).select("file", "video", T.fold_key(F.col("surface")).alias("k"), F.coalesce("word_start", "video_start").alias("t"))
    h = heard(spark, d).select("video", T.fold_key(F.col("word")).alias("k"), F.col("start").alias("ht"), "idx").filter("video is not null and k is not null")
    return nearest(c.filter("t is not null and video is not null and k is not null"), h, ["video", "k"], "t", "ht", ["idx"], 600.0).filter("match is not null").select("file", F.col("match.idx").alias("idx"))


@add("q_time_base", f"""with {REV}, {CLIPS} select source, r.row_no, case when c.video_start > 0 then 'clip' else 'sheet' end as base, case when c.video_start > 0 then c.video_start else {number_sql('r.video_start')} end as t
from rev r left join clips c using (file) where case when c.video_start > 0 then c.video_start else {number_sql('r.video_start')} end is not null""")
def q_time_base(spark: SparkSession, d: str) -> DataFrame:
    """The start of each review's clip: as measured where the clip is known, else as the sheet says; rows with neither are left out."""
    c = clips(spark, d).filter("file is not null").select("file", F.col("video_start").alias("measured"))
    r = lookup_join(review(spark, d).select("source", "row_no", "file", "video_start"), c, ["file"])
    known = F.col("measured") > 0
    out = r.select("source", "row_no", F.when(known, "clip").otherwise("sheet").alias("base"), F.when(known, F.col("measured")).otherwise(number(F.col("video_start"))).alias("t"))
    return out.filter("t is not null")


_VER = f"ver as (select source, row_no, regexp_extract(file, '(.{{11}})\\.mp4$', 1) as video, left({_FOLD.format('word')}, 4) as k, {number_sql('sign_start')} as t from rev where verdict = 'y' and coalesce(sign_start, '') <> '')"


@add("q_verified_points", f"""with {REV}, {ASR}, {_VER}, h as (select video, left({_FOLD.format('word')}, 4) as k, start as s, min(idx) as idx from heard where start is not null group by 1, 2, 3),
j as (select source, row_no, idx, row_number() over (partition by source, row_no order by abs(s - (t - 2.33)), s) as rn from ver join h using (video, k) where k <> '' and s between t - 20 and t + 20) select source, row_no, idx from j where rn = 1""")
def q_verified_points(spark: SparkSession, d: str) -> DataFrame:
    """Verified moments with the heard word of the same beginning, within 20 s, that is nearest to 2.33 s before."""
    start = lambda c: F.left(T.fold_key(F.col(c)), F.lit(4))
    r = review(spark, d).withColumn("video", F.regexp_extract("file", r"(.{11})\.mp4$", 1)).filter((F.col("video") != "") & P.verified(F.col("video")))
    v = r.select("source", "row_no", "video", start("word").alias("k"), number(F.col("sign_start")).alias("t")).filter("t is not null and k <> ''").withColumn("c", F.col("t") - 2.33)
    h = heard(spark, d).select("video", start("word").alias("k"), F.col("start").alias("s"), "idx").filter("k <> ''")
    n = neighbours(v, h, ["video", "k"], "c", "s", ["idx"], 600.0)
    near = lambda x: F.when(F.col(f"{x}.t").between(F.col("t") - 20, F.col("t") + 20), F.struct(F.abs(F.col(f"{x}.t") - F.col("c")).alias("d"), F.col(f"{x}.t").alias("s"), F.col(f"{x}.idx").alias("idx")))
    return n.withColumn("m", F.array_min(F.array_compact(F.array(near("before"), near("after"))))).filter("m is not null").select("source", "row_no", "m.idx")


_SPAN = f"{SEG}, {ASR}, s as (select video, file, start_sec, end_sec from seg where version = 'segments' and start_sec <= end_sec), w as (select s.video, s.file, idx, start, end_sec_1 as e from s join (select video, idx, start, end_sec as end_sec_1 from heard) h on h.video = s.video and h.start >= s.start_sec and h.start < s.end_sec), r as (select *, row_number() over (partition by video, file order by start, idx) - 1 as i, count(*) over (partition by video, file) as n from w)"


def words_in_spans(spark: SparkSession, d: str) -> DataFrame:
    """Words that start within a segment: video, file, idx, start, e, i (their place from 0) and n."""
    s = segments(spark, d).filter("version = 'segments' and start_sec <= end_sec").select("video", "file", "start_sec", "end_sec")
    h = heard(spark, d).filter("start is not null and not isnan(start)").select("video", "idx", "start", F.col("end_sec").alias("e"))
    w = in_interval(h, s, ["video"], "start", "start_sec", "end_sec", 30.0).filter("start < end_sec")
    by = W.partitionBy("video", "file")
    return w.withColumn("i", F.row_number().over(by.orderBy("start", "idx")) - 1).withColumn("n", F.count(F.lit(1)).over(by))


@add("q_span_bins", f"with {_SPAN} select video, file, (i // cast(ceil(n / 4.0) as bigint)) as bin, count(*) as n_words, round(avg(e - start), 6) as mean_length from r group by 1, 2, 3")
def q_span_bins(spark: SparkSession, d: str) -> DataFrame:
    """Words inside a segment in up to four bins of equal count, and their mean length."""
    w = words_in_spans(spark, d).withColumn("bin", F.floor(F.col("i") / F.ceil(F.col("n") / 4.0)).cast("long"))
    return w.groupBy("video", "file", "bin").agg(F.count(F.lit(1)).alias("n_words"), six(F.avg(F.col("e") - F.col("start")), "mean_length"))


@add("q_k_smallest", f"with {CLIPS}, g as (select word, abs(word_start - video_start) as g, row_number() over (partition by word order by abs(word_start - video_start), file) as rn from clips where word_start is not null and video_start is not null) select word, round(avg(g), 6) as mean_two from g where rn <= 2 group by 1")
def q_k_smallest(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the two smallest distances of a word's clips from their video's start of the word."""
    g = clips(spark, d).filter("word_start is not null and video_start is not null").select("word", "file", F.abs(F.col("word_start") - F.col("video_start")).alias("g"))
    return cap(g, ["word"], ["g", "file"], 2).groupBy("word").agg(six(F.avg("g"), "mean_two"))


_ORDER = f"{_SPAN}, {CLIPS}, b as (select r.video, r.file as seg, c.file, c.t from (select distinct video, file from r) r join (select video as v, file as f, start_sec as s0, end_sec as s1 from s) x on x.v = r.video and x.f = r.file join (select file, video, coalesce(word_start, video_start) as t from clips) c on c.video = r.video and c.t >= s0 and c.t < s1), br as (select *, (row_number() over (partition by video, seg order by t, file) - 0.5) / count(*) over (partition by video, seg) as pos from b), wr as (select video, file as seg, idx, (i + 0.5) / n as pos from r), o as (select br.video, br.seg, br.file, wr.idx, br.pos, wr.pos as other, row_number() over (partition by br.video, br.seg, br.file order by round(abs(wr.pos - br.pos), 9), wr.pos) as rn from br join wr using (video, seg)), near as (select * from o where rn = 1)"


def by_order(spark: SparkSession, d: str) -> DataFrame:
    """Clips inside a segment with the heard word whose relative place in the segment is nearest: video, seg, file, pos, idx, other."""
    w = words_in_spans(spark, d).select("video", F.col("file").alias("seg"), "idx", ((F.col("i") + 0.5) / F.col("n")).alias("wpos"))
    s = segments(spark, d).filter("version = 'segments' and start_sec <= end_sec").select("video", F.col("file").alias("seg"), "start_sec", "end_sec")
    c = clips(spark, d).select("video", "file", F.coalesce("word_start", "video_start").alias("t")).filter("t is not null")
    b = in_interval(c, s, ["video"], "t", "start_sec", "end_sec", 30.0).filter("t < end_sec")
    by = W.partitionBy("video", "seg")
    b = b.withColumn("pos", (F.row_number().over(by.orderBy("t", "file")) - 0.5) / F.count(F.lit(1)).over(by))
    n = neighbours(b, w, ["video", "seg"], "pos", "wpos", ["idx"], 1.0)
    far = lambda x: F.struct(F.round(F.abs(F.col(f"{x}.t") - F.col("pos")), 9).alias("d"), F.col(f"{x}.t").alias("t"), F.col(f"{x}.idx").alias("idx"))
    m = F.array_min(F.array_compact(F.array(F.when(F.col("before").isNotNull(), far("before")), F.when(F.col("after").isNotNull(), far("after")))))
    return n.withColumn("m", m).filter("m is not null").select("video", "seg", "file", "pos", "m.idx", F.col("m.t").alias("other"))


@add("q_order_proximity", f"with {_ORDER} select video, seg, file, idx from near")
def q_order_proximity(spark: SparkSession, d: str) -> DataFrame:
    return by_order(spark, d).select("video", "seg", "file", "idx")


@add("q_quartile_agreement", f"with {_ORDER} select count(*) as n, round(avg((floor(pos / 0.25) = floor(other / 0.25))::int), 6) as same_quartile, round(avg(abs(pos - other)), 6) as mean_error from near")
def q_quartile_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often both places lie in the same quarter of the segment, and their mean distance."""
    quarter = lambda c: F.floor(F.col(c) / 0.25)
    return by_order(spark, d).agg(F.count(F.lit(1)).alias("n"), six(F.avg((quarter("pos") == quarter("other")).cast("int")), "same_quartile"), six(F.avg(F.abs(F.col("pos") - F.col("other"))), "mean_error"))


# A small dictionary of forms, the lemma of each and its part of speech; a real one is an input table.
LEMMAS = [(f, k, "VERB" if f.endswith("ar") else "ADJ" if f.endswith("able") else "NOUN") for k, fs in FAMILIES.items() for f in fs] + [("los", "el", "DET"), ("para", "para", "ADP"), ("una", "un", "DET")]


@add("q_lemmas", f"with {ASR}, dim as (select distinct {_FOLD.format('f')} as f, l, p from (values {', '.join(map(str, LEMMAS))}) t(f, l, p)), k as (select {_FOLD.format('word')} as f from heard where word is not null) select coalesce(l, k.f) as lemma, coalesce(p, 'X') as pos, coalesce(p in ('NOUN', 'VERB', 'ADJ'), false) as content, count(*) as n from k left join dim on dim.f = k.f group by 1, 2, 3")
def q_lemmas(spark: SparkSession, d: str) -> DataFrame:
    """Heard words by lemma and part of speech; a word the dictionary doesn't have is its own lemma. content: nouns, verbs and adjectives."""
    dim = spark.createDataFrame(LEMMAS, "f string, l string, p string").select(T.fold_key(F.col("f")).alias("f"), "l", "p").distinct()
    k = heard(spark, d).filter("word is not null").groupBy(T.fold_key(F.col("word")).alias("f")).agg(F.count(F.lit(1)).alias("c"))
    both = lookup_join(k, dim, ["f"])
    return both.groupBy(F.coalesce("l", "f").alias("lemma"), F.coalesce("p", F.lit("X")).alias("pos"), F.coalesce(F.col("p").isin("NOUN", "VERB", "ADJ"), F.lit(False)).alias("content")).agg(F.sum("c").alias("n"))


ALLOWED, DENIED, EXCLUDED = (0, 1, 2, 3, 5, 8, 13, 21), (2, 13), (1, 40, 77, 1002)


@add("q_allow_deny", f"select c_nationkey, count(*) as n from customer where c_nationkey in {ALLOWED} and c_nationkey not in {DENIED} and c_custkey not in {EXCLUDED} group by 1")
def q_allow_deny(spark: SparkSession, d: str) -> DataFrame:
    """Rows of allowed sources that aren't denied, without a list of excluded ids."""
    c = table(spark, d, "customer").filter(P.allowed(F.col("c_nationkey"), ALLOWED, DENIED) & ~F.col("c_custkey").isin(*EXCLUDED))
    return c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@add("q_every_nth", "select label, vec_id, vec_id // 5 as sampled from embeddings where vec_id % 5 = 0")
def q_every_nth(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth frame of a scan, which is what the operator is for, with its number among the sampled ones."""
    return readers.every_nth(table(spark, d, "embeddings"), "vec_id", 5).select("label", "vec_id", F.col("sampled"))


@add("q_dates", f"select o_orderkey, cast(o_orderdate as date) as day from orders")
def q_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates written with a Spanish month's name, read back."""
    months = F.array(*map(F.lit, T.MONTHS))
    said = F.concat_ws(" de ", F.dayofmonth("o_orderdate").cast("string"), F.element_at(months, F.month("o_orderdate")), F.year("o_orderdate").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", T.spoken_date(said).alias("day"))


@add("q_word_bank", f"with {CLIPS}, {REV}, b as (select word, file, row_number() over (partition by word order by file) as rn, count(*) over (partition by word) as n from clips where word in (select word from rev where verdict = 'y')) select word, n, file, rn as place from b where rn <= 3")
def q_word_bank(spark: SparkSession, d: str) -> DataFrame:
    """Of the words that were verified, how many clips there are, and the first three as references."""
    wanted = review(spark, d).filter("verdict = 'y'").select("word").distinct()
    b = clips(spark, d).select("word", "file").join(wanted, "word", "left_semi")
    refs = cap(b, ["word"], ["file"], 3).withColumn("place", F.row_number().over(W.partitionBy("word").orderBy("file")).cast("long"))
    return lookup_join(refs, b.groupBy("word").agg(F.count(F.lit(1)).alias("n")), ["word"]).select("word", "n", "file", "place")


@add("q_latest_document", "select video, count(*) as n, max_by(doc_id, (published_at, doc_id)) as doc_id from (select distinct * from documents) where video is not null and published_at is not null group by 1")
def q_latest_document(spark: SparkSession, d: str) -> DataFrame:
    """Per video how many documents there are and the last of them."""
    own = table(spark, d, "documents").select("doc_id", "video", "published_at").distinct().filter("video is not null and published_at is not null")
    return lookup_join(latest(own, ["video"], ["published_at", "doc_id"]), own.groupBy("video").agg(F.count(F.lit(1)).alias("n")), ["video"]).select("video", "n", "doc_id")


@add("q_signers", f"with {REV} select {_FOLD.format('signer')} as storage_key, count(*) as n, min(loaded_at) as first_at from rev where trim(coalesce(signer, ''), ' ') <> '' group by 1")
def q_signers(spark: SparkSession, d: str) -> DataFrame:
    """Everybody who signs, by a key fit for storage, and when each first appears."""
    r = review(spark, d).filter("trim(coalesce(signer, '')) <> ''")
    return r.groupBy(T.fold_key(F.col("signer")).alias("storage_key")).agg(F.count(F.lit(1)).alias("n"), F.min("loaded_at").alias("first_at"))


@add("q_probe_sheet", f"with {REV}, {CLIPS}, ref as (select word, min(file) as ref from clips group by 1) select source, row_no, coalesce('clips/' || ref, '') as ref_clip from rev left join ref using (word)")
def q_probe_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Review rows with the reference clip of their word, an empty text where there is none."""
    ref = clips(spark, d).filter("word is not null").groupBy("word").agg(F.min("file").alias("ref"))
    return lookup_join(review(spark, d).select("source", "row_no", "word"), ref, ["word"]).select("source", "row_no", F.coalesce(F.concat(F.lit("clips/"), "ref"), F.lit("")).alias("ref_clip"))


@add("q_query_plan", f"with {CLIPS}, c as (select word, count(*) as n, min(file) as file from clips where word is not null group by 1), r as (select *, row_number() over (order by n desc, word) as rn from c) select lpad(rn::varchar, 2, '0') || '_' || word as id, file, (select count(*) from r where rn <= 26) = 26 as complete from r where rn <= 26")
def q_query_plan(spark: SparkSession, d: str) -> DataFrame:
    """The 26 words with most clips, numbered, and whether there are as many."""
    c = clips(spark, d).filter("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file"))
    top = c.orderBy(F.desc("n"), "word").limit(26)
    ranked = top.withColumn("rn", F.row_number().over(W.orderBy(F.desc("n"), "word")))
    return beside(ranked, top.agg((F.count(F.lit(1)) == 26).alias("complete"))).select(F.concat(F.lpad(F.col("rn").cast("string"), 2, "0"), F.lit("_"), "word").alias("id"), "file", "complete")


@add("q_first_file", f"with {REV} select word, min(file) as file from rev where word is not null and file is not null group by 1")
def q_first_file(spark: SparkSession, d: str) -> DataFrame:
    """Of several files with one id the first by path."""
    f = review(spark, d).filter("word is not null and file is not null").select("word", F.col("file").alias("path")).distinct()
    return readers.first_by_id(f, "word").select("word", F.col("path").alias("file"))


@add("q_insert_new", f"with {MAN}, s as (select distinct video as id from segments) select id, region from man union all select id, 'new' from s where id not in (select id from man) and id is not null")
def q_insert_new(spark: SparkSession, d: str) -> DataFrame:
    """The manifest with a row for every video of the segments that it lacks; a second time adds nothing."""
    new = segments(spark, d).filter("video is not null").select(F.col("video").alias("id"), F.lit("new").alias("region"))
    return insert_new(new, manifest(spark, d).select("id", "region"), "id", ["region"])


@add("q_todo", f"with {CLIPS}, {REV} select file, word from clips where file not in (select file from rev where file is not null)")
def q_todo(spark: SparkSession, d: str) -> DataFrame:
    """Clips that nobody reviewed yet: the resume rule."""
    return readers.todo(clips(spark, d).select("file", "word"), review(spark, d).filter("file is not null"), "file")


@add("q_templates", "select c_custkey, choice, case choice when 0 then 'https://a.example/' || strftime(day, '%Y/%m') || '.html' else 'https://b.example/' || strftime(day, '%d-%m-%Y') end as url from (select o_custkey as c_custkey, max(o_orderdate)::date as day from orders group by 1), (values (0), (1)) t(choice)")
def q_templates(spark: SparkSession, d: str) -> DataFrame:
    """Candidate addresses of a day's page, in the order they are tried."""
    days = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("date").alias("day"))
    return P.expand_templates(days, ["https://a.example/{yyyy}/{mm}.html", "https://b.example/{dd}-{mm}-{yyyy}"], "day").select("c_custkey", "choice", "url")


@add("q_longest_text", "with t as (select distinct source, doc_id, len(string_split_regex(trim(text, ' '), '[ \\n\\t\\r]+')) as n from documents where text is not null) select source, max(n)::bigint as n_words from t where source is not null group by 1")
def q_longest_text(spark: SparkSession, d: str) -> DataFrame:
    """Of a source's texts the one with most words: how many those are."""
    own = table(spark, d, "documents").filter("text is not null and source is not null").select("source", F.trim("text").alias("text"))
    best = P.longest_text(own.withColumn("text", F.regexp_replace("text", r"[ \n\t\r]+", " ")), ["source"], "text")
    return best.select("source", F.size(F.split("text", r" +")).cast("long").alias("n_words"))


@add("q_shifted_cues", f"with {ASR} select video, idx, greatest(0, start - 0.4) as start, greatest(0, end_sec - 0.2) as end_sec from heard where start is not null and end_sec is not null")
def q_shifted_cues(spark: SparkSession, d: str) -> DataFrame:
    """Cues shifted back, never below zero, starts and ends by their own amount."""
    return sinks.shifted(heard(spark, d).filter("start is not null and end_sec is not null"), "start", "end_sec", -0.4, -0.2).select("video", "idx", "start", "end_sec")


@add("q_slices", f"with {CLIPS} select count(*) as n, count_if(coalesce(word_start, -1) between 0 and 600)::bigint as n_inside from clips")
def q_slices(spark: SparkSession, d: str) -> DataFrame:
    """How many clips lie in the first ten minutes."""
    return clips(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(P.in_slice(F.coalesce("word_start", F.lit(-1.0)), F.lit(600.0))).alias("n_inside"))


@add("q_blocked", f"with {ASR} select video, count(*) as n, count_if(contains({_FOLD.format('word')}, 'agua') or contains({_FOLD.format('word')}, 'salud'))::bigint as n_blocked from heard where word is not null group by 1")
def q_blocked(spark: SparkSession, d: str) -> DataFrame:
    """How many heard words hold a phrase of the block list."""
    phrases = F.array(F.lit("Agua"), F.lit("salud"), F.lit(" "))
    return heard(spark, d).filter("word is not null").groupBy("video").agg(F.count(F.lit(1)).alias("n"), F.count_if(P.blocked(T.fold_key(F.col("word")), phrases)).alias("n_blocked"))


_BARE_SQL = f"regexp_replace(lower({_BARE.format('word')}), '^[.,;:!?¿¡\"''()]+|[.,;:!?¿¡\"''()]+$', '', 'g')"


@add("q_bare_words", f"with {ASR} select {_BARE_SQL} as bare, count(*) as n from heard where word is not null group by 1")
def q_bare_words(spark: SparkSession, d: str) -> DataFrame:
    """Heard words without accents and without punctuation at their ends."""
    return heard(spark, d).filter("word is not null").groupBy(T.bare(F.col("word")).alias("bare")).agg(F.count(F.lit(1)).alias("n"))


@add("q_squeezed", f"with {REV} select regexp_replace(lower(trim(signer, ' ')), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g') as k, count(*) as n from rev where signer is not null group by 1")
def q_squeezed(spark: SparkSession, d: str) -> DataFrame:
    return review(spark, d).filter("signer is not null").groupBy(T.squeeze(F.col("signer")).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@add("q_between", "select doc_id, case when position('La ' in text) > 0 then case when position('.' in substr(text, position('La ' in text))) > 0 then split_part(substr(text, position('La ' in text)), '.', 1) else substr(text, position('La ' in text)) end when position('.' in text) > 0 then split_part(text, '.', 1) else text end as part from (select distinct doc_id, text from documents) where text is not null")
def q_between(spark: SparkSession, d: str) -> DataFrame:
    """The text from one mark to the next of another."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", "text").distinct().select("doc_id", T.between(F.col("text"), "La ", "\\.").alias("part"))


@add("q_file_times", f"with {CLIPS}, n as (select file, floor(video_start / 60)::bigint as m, floor(video_start)::bigint % 60 as s from clips where video_start >= 0) select file, (m * 60 + s)::double as t from n")
def q_file_times(spark: SparkSession, d: str) -> DataFrame:
    """Times written into a file's name, read back."""
    m, s = F.floor(F.col("video_start") / 60), F.floor("video_start") % 60
    named = clips(spark, d).filter("video_start >= 0").select("file", F.concat(F.lit("a_mm"), m.cast("string"), F.lit("s"), s.cast("string"), F.lit(".mp4")).alias("name"))
    return named.select("file", T.file_time(F.col("name")).alias("t"))


@add("q_gap_invariant", f"""with {SEG}, {ASR}, s as (select video, start_sec as a, end_sec as b from seg where version = 'segments' and start_sec < end_sec), m as (select *, max(b) over (partition by video order by a, b rows between unbounded preceding and 1 preceding) as pe from s), g as (select video, pe as g0, a as g1 from m where a > pe),
dr as (select distinct h.video, h.idx, h.start as t from heard h where start is not null and video in (select video from s) and not exists (select 1 from s where s.video = h.video and h.start between a and b)), e as (select video, min(a) as lo, max(b) as hi from s group by 1),
x as (select dr.video, count(*) as n_dropped, count_if(exists (select 1 from g where g.video = dr.video and t > g0 and t < g1))::bigint as n_in_gap, count_if(t < lo or t > hi)::bigint as n_outside from dr join e using (video) group by 1) select *, case when n_dropped = n_in_gap + n_outside then 'OK' else 'DO NOT USE' end as verdict from x""")
def q_gap_invariant(spark: SparkSession, d: str) -> DataFrame:
    """Words that lie in no segment must lie in a gap between segments or beyond them, else the filter can't be trusted."""
    s = segments(spark, d).filter("version = 'segments' and start_sec < end_sec").select("video", "start_sec", "end_sec")
    found = periods_and_gaps(s, ["video"], "start_sec", "end_sec", 600.0)
    ends = s.groupBy("video").agg(F.min("start_sec").alias("lo"), F.max("end_sec").alias("hi"))
    h = lookup_join(heard(spark, d).filter("start is not null and not isnan(start)").select("video", "idx", F.col("start").alias("t")), ends, ["video"], "inner")
    inside = in_interval(h, s, ["video"], "t", "start_sec", "end_sec", 30.0, "left_semi").select("video", "idx")
    dropped = h.join(inside.distinct(), ["video", "idx"], "left_anti")
    gaps = found.filter("kind = 'gap'").select("video", F.col("start_sec").alias("g0"), F.col("end_sec").alias("g1"))
    in_gap = in_interval(dropped, gaps, ["video"], "t", "g0", "g1", 600.0).filter("t > g0 and t < g1").select("video", "idx").distinct().withColumn("gap", F.lit(1))
    x = dropped.join(in_gap, ["video", "idx"], "left").groupBy("video").agg(F.count(F.lit(1)).alias("n_dropped"), F.count("gap").alias("n_in_gap"), F.count_if(F.expr("t < lo or t > hi")).alias("n_outside"))
    return x.withColumn("verdict", F.when(F.col("n_dropped") == F.col("n_in_gap") + F.col("n_outside"), "OK").otherwise("DO NOT USE"))


@add("q_first_dimension", f"with {SEG} select video, count(*) as n, min(version) as version from seg where video is not null group by 1")
def q_first_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Per video the first version of its segments, and how many rows there are."""
    s = segments(spark, d).filter("video is not null").select("video", "version", "file")
    return lookup_join(first_wins(s, ["video"], ["version", "file"]).select("video", "version"), s.groupBy("video").agg(F.count(F.lit(1)).alias("n")), ["video"]).select("video", "n", "version")
