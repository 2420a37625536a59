"""Views of the tables that several queries share, in Spark and in the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.catalog import table
from weftline.operators.lookup import distinct_rows

HOUR = 3_600_000_000


def events(spark: SparkSession, folder: str) -> DataFrame:
    """events with us, its time in microseconds, and bin, its hour."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return table(spark, folder, "events").withColumn("us", us).withColumn("bin", F.floor(F.col("us") / HOUR).cast("long"))


EV = "ev as (select *, epoch_us(ts) as us, epoch_us(ts) // 3600000000 as bin from events)"


def segments(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_rows(table(spark, folder, "segments"), ["video", "version", "file"])


SEG = "seg as (select distinct * from segments)"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per video id: the least by all columns."""
    return distinct_rows(table(spark, folder, "manifest").filter(r"id rlike '^[A-Za-z0-9_-]{11}$'"), ["id"])


MAN = "man as (select * exclude(rn) from (select *, row_number() over (partition by id order by n_segs nulls first, region nulls first, fps nulls first, title nulls first, url nulls first) as rn from manifest where regexp_full_match(id, '[A-Za-z0-9_-]{11}')) where rn = 1)"


def heard(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_rows(table(spark, folder, "asr"), ["video", "idx"])


ASR = "heard as (select distinct * from asr)"


def clips(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_rows(table(spark, folder, "word_times"), ["file"])


CLIPS = "clips as (select distinct * from word_times)"


def review(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_rows(table(spark, folder, "review"), ["source", "row_no"])


REV = "rev as (select distinct * from review)"


def six(c, name: str):
    """A measure rounded to 6 places, as both engines give it alike."""
    return F.round(c, 6).alias(name)
