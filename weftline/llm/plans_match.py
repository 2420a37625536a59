"""Queries that match records (problems 4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.catalog import table
from weftline.llm.names import link_spellings, linked_pairs
from weftline.llm.nearest import nearest_within
from weftline.llm.registry import LLM
from weftline.plans.sheets import JUDGED_SQL, loaded

WORD_TOLERANCE, SIGN_TOLERANCE = 0.150, 3.000

P4_SQL = f"""
{JUDGED_SQL},
clips as (select distinct video, coalesce(word_start, video_start) as t, file from word_times),
heard as (select distinct video, start as t, cast(idx as varchar) as k from asr where start is not null),
signs as (select source || ':' || row_no as lk, regexp_extract(file, '(.{{11}})\\.mp4$', 1) as video, sv as t from judged where reason is null and not sb and source in (select source from review)),
cand as (
  select 'word' as leg, c.file as left_key, h.k as right_key, abs(h.t - c.t) as d, h.t from clips c join heard h on h.video = c.video and h.t between c.t - 0.1501 and c.t + 0.1501 where abs(h.t - c.t) <= 0.150 + 1e-9
  union all
  select 'sign', s.lk, c.file, abs(c.t - s.t), c.t from signs s join clips c on c.video = s.video and c.t between s.t - 3.1 and s.t + 3.1 where abs(c.t - s.t) <= 3.0 + 1e-9)
select leg, left_key, right_key from (select *, row_number() over (partition by leg, left_key order by d, t, right_key) as rn from cand) where rn = 1
"""


@LLM.add("p4_found", P4_SQL)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each clip with its heard word, and each signed moment with its clip."""
    clips = table(spark, folder, "word_times").select(F.col("video").alias("entity"), F.coalesce(F.nanvl("word_start", F.lit(None)), "video_start").alias("time"), F.col("file").alias("key"))
    heard = table(spark, folder, "asr").select(F.col("video").alias("entity"), F.col("start").alias("time"), F.col("idx").cast("string").alias("key"))
    signs = loaded(spark, folder, ("review",)).filter("sign_start is not null")
    signs = signs.select(F.regexp_extract("file", r"(.{11})\.mp4$", 1).alias("entity"), F.col("sign_start").alias("time"), F.concat_ws(":", "source", F.col("row_no").cast("string")).alias("key"))
    words = nearest_within(clips, heard, WORD_TOLERANCE).select(F.lit("word").alias("leg"), "left_key", "right_key")
    return words.unionByName(nearest_within(signs, clips, SIGN_TOLERANCE).select(F.lit("sign").alias("leg"), "left_key", "right_key"))


@LLM.add("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of spellings of one interpreter."""
    linked = link_spellings(table(spark, folder, "review"), "signer")
    return linked_pairs(linked).select(F.col("x").alias("signer_a"), F.col("y").alias("signer_b"))


@LLM.add("p5_people")
def p5_people(spark: SparkSession, folder: str) -> DataFrame:
    """The spellings of each interpreter with the one used most, and how often each is used."""
    used = table(spark, folder, "review").select("source", "row_no", F.col("signer").alias("spelling")).distinct().groupBy("spelling").count()
    linked = link_spellings(table(spark, folder, "review"), "signer").join(used, "spelling")
    main = linked.groupBy("person").agg(F.max(F.struct("count", "spelling")).alias("m"))
    return linked.join(main, "person").select(F.col("m.spelling").alias("interpreter"), "spelling", F.col("count").alias("n"))
