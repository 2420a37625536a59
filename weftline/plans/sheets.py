"""Review sheets: records that can't be loaded, with their reasons, and all others as typed rows (problem 1)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.catalog import table
from weftline.operators.lookup import distinct_rows
from weftline.operators.rejects import Domain, decimal_less, is_blank, is_decimal, parse_lines, with_reason
from weftline.plans.registry import CORE

SHEET = ("file", "word", "video_start", "verdict", "signer", "sign_start", "sign_end")
VERDICTS = ("y", "n", "neg", "")
DOMAINS = (
    Domain("verdict", "verdict", lambda c: c.isin(*VERDICTS)),
    Domain("sign_start", "timing", lambda c: is_blank(c) | (is_decimal(c) & ~decimal_less(c, F.lit("0")))),
    Domain("sign_end", "timing", lambda c: is_blank(c) | is_decimal(c)),
)


def judged(spark: SparkSession, folder: str, tables: Sequence[str] = ("review", "review_lines")) -> DataFrame:
    """Every record of the tables once: source, row_no, the sheet's columns as strings, and reason (null: it can be loaded)."""
    parts = []
    if "review" in tables:
        review = distinct_rows(table(spark, folder, "review").select("source", "row_no", *SHEET), ["source", "row_no"]).withColumn("form", F.lit(None).cast("string"))
        parts.append(review)
    if "review_lines" in tables:
        lines = parse_lines(distinct_rows(table(spark, folder, "review_lines").select("source", "row_no", "line"), ["source", "row_no"]), "line", SHEET).drop("line")
        parts.append(lines)
    both = reduce(lambda a, b: a.unionByName(b), parts)
    blank_start, blank_end = is_blank(F.col("sign_start")), is_blank(F.col("sign_end"))
    pair = (blank_start != blank_end) | (~blank_start & ~blank_end & ~decimal_less(F.col("sign_start"), F.col("sign_end")))
    return with_reason(both, DOMAINS, structural=F.col("form"), across=[("timing", pair)]).drop("form")


def loaded(spark: SparkSession, folder: str, tables: Sequence[str] = ("review", "review_lines")) -> DataFrame:
    """The records that can be loaded, typed. A null verdict stays null, an empty one empty; blank times are null."""
    number = lambda c: F.when(~is_blank(F.col(c)), F.trim(c).try_cast("double")).alias(c)
    return judged(spark, folder, tables).filter("reason is null").select("source", "row_no", "file", "word", F.trim("video_start").try_cast("double").alias("video_start"), "verdict", "signer", number("sign_start"), number("sign_end"))


_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
JUDGED_SQL = rf"""
with raw as (select distinct source, row_no, regexp_replace(line, '\r\z', '') as t from review_lines),
recs as (select * from raw where t is not null and not regexp_full_match(t, ' *') and replace(t, '"', '') <> 'file,word,video_start,verdict,signer,sign_start,sign_end'),
cells as (select source, row_no, t, regexp_full_match(t, '(?s){_FIELD}(?:,{_FIELD})*') as well, regexp_extract_all(',' || t, '(?s),({_FIELD})', 1) as f from recs),
lines as (select source, row_no, case when not well then 'quoting' when len(f) <> 7 then 'columns' end as form, list_transform(f, lambda x: case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end) as f from cells),
both_of as (
  select distinct source, row_no, null as form, file, word, video_start, verdict, signer, sign_start as s, sign_end as e from review
  union all
  select source, row_no, form, case when form is null then f[1] end, case when form is null then f[2] end, case when form is null then f[3] end, case when form is null then f[4] end, case when form is null then f[5] end, case when form is null then f[6] end, case when form is null then f[7] end from lines),
kinds as (select *, coalesce(regexp_full_match(s, ' *'), true) as sb, coalesce(regexp_full_match(e, ' *'), true) as eb,
  case when regexp_full_match(s, ' *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+) *') then try_cast(trim(s) as double) end as sv,
  case when regexp_full_match(e, ' *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+) *') then try_cast(trim(e) as double) end as ev from both_of),
judged as (select *, case when form is not null then form when verdict not in ('y', 'n', 'neg', '') then 'verdict'
  when (sb and eb) or coalesce(sv >= 0 and ev > sv, false) then null else 'timing' end as reason from kinds)
"""


@CORE.add("p1_found", JUDGED_SQL + "select source, row_no, reason from judged where reason is not null")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark, folder).filter("reason is not null").select("source", "row_no", "reason")


@CORE.add("p1_loaded", JUDGED_SQL + "select source, row_no, file, word, try_cast(trim(video_start) as double) as video_start, verdict, signer, case when not sb then sv end as sign_start, case when not eb then ev end as sign_end from judged where reason is null")
def p1_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return loaded(spark, folder)
