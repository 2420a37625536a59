"""Files written and read again: lines of JSON, tiers, arrays, literals in pages, appended and replaced tables; and checks of what can't be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from weftline.catalog import table
from weftline.plans.common import ASR, CLIPS, MAN, SEG, clips, heard, manifest, segments
from weftline.plans.files import place
from weftline.plans.landmarks import _PTS, points
from weftline.plans.registry import CORE
from weftline.sources import readers, sinks

add = CORE.add


@add("q_json_lines", f"with {SEG} select video, version, file, start_frame, hand_coverage from seg")
def q_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Segments as lines of JSON, and read again by a stated schema."""
    at = place(spark)
    sinks.write_json_lines(segments(spark, d).select("video", "version", "file", "start_frame", "hand_coverage"), at)
    return readers.json_lines(spark, at, T.StructType.fromDDL("video string, version string, file string, start_frame bigint, hand_coverage double"))


@add("q_tensor_parts", f"with {_PTS} select video, frame, row_no::int as row_no, x, y from p where video in ('1', '3', '5')")
def q_tensor_parts(spark: SparkSession, d: str) -> DataFrame:
    """Landmarks in one folder a video, and some videos read again: only their folders are."""
    at = place(spark)
    sinks.write_parts(points(spark, d), at, ["video"])
    return readers.parts(spark, at, {"video": ["1", "3", "5"]}).select(F.col("video").cast("string").alias("video"), "frame", F.col("row_no").cast("int").alias("row_no"), "x", "y")


@add("q_xml_rows", f"with {CLIPS} select word, count(*) as n from clips where regexp_full_match(word, '[a-zA-ZáéíóúñüÁÉÍÓÚÑÜ]+') group by 1")
def q_xml_rows(spark: SparkSession, d: str) -> DataFrame:
    """Counts of words as elements of XML, and read again. Words of letters, as XML can't hold every sign."""
    at = place(spark)
    c = clips(spark, d).filter(r"word rlike '\\A[a-zA-ZáéíóúñüÁÉÍÓÚÑÜ]+\\z'").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_xml(c, at, "words", "w")
    return spark.read.format("xml").option("rowTag", "w").schema("word string, n bigint").load(at)


@add("q_page_literals", "select source, count(*) as n from documents where source is not null group by 1")
def q_page_literals(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a literal in a page's script, a page for each source."""
    docs = table(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    item = F.to_json(F.array(F.struct("source", "n")))
    pages = docs.select(F.concat(F.lit("<html><script>const other = [1];\nconst ROWS = "), item, F.lit(";</script></html>")).alias("page"))
    return readers.html_rows(pages, "page", "ROWS", "source: string, n: bigint")


@add("q_page_links", "select doc_id, '/d/' || doc_id as first_link, 2::bigint as n_links from (select distinct doc_id from documents)")
def q_page_links(spark: SparkSession, d: str) -> DataFrame:
    """Distinct targets of a page's links, in order."""
    ids = table(spark, d, "documents").select("doc_id").distinct()
    a = lambda t: F.concat(F.lit('<a href="'), t, F.lit('">x</a>'))
    own = F.concat(F.lit("/d/"), F.col("doc_id").cast("string"))
    page = F.concat(a(own), a(F.concat(own, F.lit("#top"))), a(F.lit("/about")), a(own))
    return ids.withColumn("links", readers.links(page)).select("doc_id", F.get("links", F.lit(0)).alias("first_link"), F.size("links").cast("long").alias("n_links"))


@add("q_append_once", f"with {CLIPS} select file, word from clips where file is not null")
def q_append_once(spark: SparkSession, d: str) -> DataFrame:
    """Rows appended in two overlapping runs are there once: a broken run is begun again without harm."""
    at, c = place(spark), clips(spark, d).filter("file is not null").select("file", "word")
    sinks.write_new(c.filter("file < 'm'"), at, "file")
    sinks.write_new(c, at, "file")
    return spark.read.parquet(at)


@add("q_replace_upserted", f"with {MAN} select id, coalesce(nullif(region, ''), 'unknown') as region from man")
def q_replace_upserted(spark: SparkSession, d: str) -> DataFrame:
    """A stored table upserted into a new version beside the old."""
    at, m = place(spark), manifest(spark, d).select("id", "region")
    m.write.parquet(at)
    fresh = m.filter("coalesce(region, '') = ''").select("id", F.lit("unknown").alias("region"))
    return spark.read.parquet(sinks.replace_upserted(fresh, at, "id", ["region"]))


@add("q_first_lines", f"with {ASR} select video, count(*) as n from heard where start >= 0 and end_sec >= 0 and regexp_full_match(word, '[a-zA-Z]+') group by 1")
def q_first_lines(spark: SparkSession, d: str) -> DataFrame:
    """Cues of two lines of which only the first is taken."""
    h = heard(spark, d).filter("start >= 0 and end_sec >= 0").filter(r"word rlike '\\A[a-zA-Z]+\\z'").withColumn("two", F.concat("word", F.lit("\nsecond")))
    c = readers.cues(sinks.subtitles(h, "video", "idx", "start", "end_sec", "two"), "video", "document", first_line_only=True)
    return c.filter("text <> 'second' and not contains(text, ' ')").groupBy("video").agg(F.count(F.lit(1)).alias("n"))


@add("q_unreadable", "with t as (select distinct doc_id, text from documents where source = 'qc_log' and text is not null) select doc_id, not json_valid(text) as unreadable from t")
def q_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """Check logs that aren't whole JSON texts."""
    t = table(spark, d, "documents").filter("source = 'qc_log' and text is not null").select("doc_id", "text").distinct()
    return t.select("doc_id", F.try_parse_json("text").isNull().alias("unreadable"))
