"""Queries through files in the shared folder: written by the sinks, read again by the scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from weftline.catalog import table
from weftline.plans.common import ASR, MAN, SEG, heard, manifest, segments
from weftline.plans.registry import CORE
from weftline.session import checkpoint_dir
from weftline.sources import readers, sinks

add = CORE.add


def place(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@add("q_csv_roundtrip", f"with {MAN} select id, nullif(region, '') as region, title from man")
def q_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A sheet written and read again as strings; empty and null are one."""
    at = place(spark)
    sinks.write_sheet(manifest(spark, d), at, ["id", "region", "title"])
    return readers.sheet(spark, at, ["id", "region", "title"])


@add("q_json_documents", f"with {SEG} select video, row_number() over (partition by video, version order by file) - 1 as idx, version, file, start_frame from seg")
def q_json_documents(spark: SparkSession, d: str) -> DataFrame:
    """A JSON document per video and version, and its list exploded with the place of each item."""
    docs = sinks.json_document(segments(spark, d), ["video", "version"], "file", ["file", "start_frame"], "segments")
    at = place(spark)
    docs.select(F.col("document").alias("value")).write.text(at)
    schema = T.StructType.fromDDL("video string, version string, segments array<struct<file: string, start_frame: bigint>>")
    read = spark.read.schema(schema).json(at)
    return read.select("video", "version", F.posexplode("segments").alias("idx", "s")).select("video", F.col("idx").cast("long").alias("idx"), "version", "s.file", "s.start_frame")


@add("q_vtt_cues", f"with {ASR}, h as (select video, idx, cast(round(start * 1000) as bigint) / 1000.0 as start, cast(round(end_sec * 1000) as bigint) / 1000.0 as end_sec, array_to_string(list_filter(list_transform(string_split_regex(word, '[\\r\\n]+'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), ' ') as w from heard where start >= 0 and end_sec >= 0), k as (select * from h where w <> '') select video, row_number() over (partition by video order by idx) - 1 as idx, start::double as start, end_sec::double as end_sec, w as text from k")
def q_vtt_cues(spark: SparkSession, d: str) -> DataFrame:
    """Words as subtitles, a text per video, and parsed again: whole words, trimmed, without blank ones."""
    said = heard(spark, d).filter("start >= 0 and end_sec >= 0").filter("trim(BOTH ' \t\r\n' FROM word) <> ''")
    h = said.select("video", "idx", "start", "end_sec", F.trim("word").alias("w"))
    vtt = sinks.subtitles(h, "video", "idx", "start", "end_sec", "w")
    c = readers.cues(vtt, "video", "document")
    return c.select("video", F.col("idx").cast("long").alias("idx"), F.round("start", 3).alias("start"), F.round("end_sec", 3).alias("end_sec"), "text")


_TAG = r"^\s*([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ .]+):\s*"


@add("q_transcript_words", f"""with l as (select distinct doc_id, text from documents where source = 'estenografica' and text is not null), n as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from l),
s as (select *, last_value(nullif(regexp_extract(line, '{_TAG}', 1), '') ignore nulls) over (partition by doc_id order by n rows unbounded preceding) as speaker from n), w as (select doc_id, speaker, unnest(list_filter(string_split_regex(regexp_replace(line, '{_TAG}', ''), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')) as word from s)
select coalesce(speaker, '(none)') as speaker, count(*) as n, count(distinct doc_id) as n_documents from w group by 1""")
def q_transcript_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of the transcripts with their speaker: how many of each."""
    t = readers.transcript(table(spark, d, "documents").filter("source = 'estenografica' and text is not null").select("doc_id", "text").distinct(), "doc_id", "text")
    return t.groupBy(F.coalesce("speaker", F.lit("(none)")).alias("speaker")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_documents"))


@add("q_chunks", f"with {SEG}, s as (select video, version, file, end_sec - start_sec as dur from seg where end_sec > start_sec), c as (select *, unnest(generate_series(0, cast(greatest(1, ceil(dur / 2.0)) as bigint) - 1)) as chunk from s) select video, version, file, chunk, round(chunk * 2.0::double, 3) as \"offset\", round(least(2.0::double, dur - chunk * 2.0::double), 6) as length from c")
def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).filter("end_sec > start_sec").select("video", "version", "file", F.expr("end_sec - start_sec").alias("dur"))
    return readers.chunks(s, "dur", 2.0).select("video", "version", "file", F.col("chunk").cast("long").alias("chunk"), F.round("offset", 3).alias("offset"), F.round("length", 6).alias("length"))


@add("q_file_inventory")
def q_file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The Parquet files of the data folder by kind."""
    return readers.inventory(spark, d, "*.parquet").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sha256").alias("n_distinct"), F.sum("bytes").alias("bytes"))
