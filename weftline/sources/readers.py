"""Scans: sheets, nested JSON, subtitles, transcripts, XML tiers, tensors, file inventories. NaN becomes null here and only here."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from weftline.functions.text import seconds_of

COMPLETED = ("file", "word", "video_start", "verdict", "signer", "sign_start", "sign_end")
CANDIDATE = ("file", "word", "video_start", "context", "verdict", "dict_youtube_id", "ref_clip")


def sheet(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with a header, every column a string; quotes doubled, line breaks within quotes kept. With `columns` they are taken by name, and missing ones are null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path, inferSchema=False)
    if columns is None:
        return df
    return df.select(*[F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def sheet_kind(columns: Sequence[str]) -> str:
    """'completed', 'candidate' or 'unknown', by the columns a sheet has at least."""
    have = set(columns)
    return "completed" if set(COMPLETED) <= have else "candidate" if set(CANDIDATE) <= have else "unknown"


def json_documents(spark: SparkSession, path: str | list[str], items: str, schema: T.StructType) -> DataFrame:
    """One JSON document a file, its list `items` exploded with the place in the list as idx; the file's name as source."""
    docs = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("source", F.element_at(F.split(F.input_file_name(), "/"), -1))
    rest = [f.name for f in schema.fields if f.name != items]
    return docs.select("source", *rest, F.posexplode(items).alias("idx", "item")).select("source", *rest, "idx", "item.*")


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


TIMING = r"^(\d{2,}:\d{2}:\d{2}[.,]\d{3})\s+-->\s+(\d{2,}:\d{2}:\d{2}[.,]\d{3})"


def cues(texts: DataFrame, key: str, text: str, first_line_only: bool = False) -> DataFrame:
    """Cues of subtitle texts: key, idx, start, end_sec, text. Lines of a cue are joined by a blank (or only the first taken); cue numbers and cues without text are dropped."""
    blocks = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"\n[ \t]*\n+")
    b = texts.select(key, F.posexplode(blocks).alias("__i", "__b")).select(key, "__i", F.filter(F.split("__b", "\n"), lambda x: F.trim(x) != "").alias("__l"))
    b = b.withColumn("__at", F.array_position(F.transform("__l", lambda x: x.rlike(TIMING)), True)).filter(F.col("__at") > 0)
    head = F.get("__l", (F.col("__at") - 1).cast("int"))
    body = F.expr("slice(__l, int(__at) + 1, size(__l))")
    said = F.get(body, F.lit(0)) if first_line_only else F.array_join(body, " ")
    out = b.select(key, "__i", seconds_of(F.regexp_extract(head, TIMING, 1)).alias("start"), seconds_of(F.regexp_extract(head, TIMING, 2)).alias("end_sec"), F.trim(said).alias("text")).filter("text <> ''")
    return out.withColumn("idx", F.row_number().over(W.partitionBy(key).orderBy("__i")) - 1).select(key, "idx", "start", "end_sec", "text")


def read_cues(spark: SparkSession, path: str | list[str], first_line_only: bool = False) -> DataFrame:
    t = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("run"), "value")
    return cues(t, "run", "value", first_line_only)


def transcript(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Words of speaker-tagged transcripts: key, idx, word, speaker. A tag `NAME:` at a line's start holds until the next and is no word."""
    tag = r"^\s*([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ .]+):\s*"
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("__n", "__line"))
    spoken = lines.withColumn("speaker", F.last(F.nullif(F.regexp_extract("__line", tag, 1), F.lit("")), True).over(W.partitionBy(key).orderBy("__n").rowsBetween(W.unboundedPreceding, 0)))
    w = spoken.select(key, "__n", "speaker", F.posexplode(F.filter(F.split(F.regexp_replace("__line", tag, ""), r"\s+"), lambda x: x != "")).alias("__k", "word"))
    return w.withColumn("idx", F.row_number().over(W.partitionBy(key).orderBy("__n", "__k")) - 1).select(key, "idx", "word", "speaker")


def xml_tiers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Annotations of a tier file: tier, start, end_sec, value; times are looked up in the file's slots (milliseconds)."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source")
    slots = spark.read.format("xml").option("rowTag", "TIME_SLOT").schema("_TIME_SLOT_ID string, _TIME_VALUE long").load(path).select(name, F.col("_TIME_SLOT_ID").alias("id"), (F.col("_TIME_VALUE") / 1000.0).alias("t"))
    kind = "_TIER_ID string, ANNOTATION array<struct<ALIGNABLE_ANNOTATION: struct<_TIME_SLOT_REF1: string, _TIME_SLOT_REF2: string, ANNOTATION_VALUE: string>>>"
    tiers = spark.read.format("xml").option("rowTag", "TIER").schema(kind).load(path).select(name, F.col("_TIER_ID").alias("tier"), F.explode("ANNOTATION.ALIGNABLE_ANNOTATION").alias("a"))
    own = tiers.select("source", "tier", F.col("a._TIME_SLOT_REF1").alias("r1"), F.col("a._TIME_SLOT_REF2").alias("r2"), F.col("a.ANNOTATION_VALUE").alias("value"))
    a = own.join(slots.select("source", F.col("id").alias("r1"), F.col("t").alias("start")), ["source", "r1"])
    return a.join(slots.select("source", F.col("id").alias("r2"), F.col("t").alias("end_sec")), ["source", "r2"]).select("source", "tier", "start", "end_sec", "value")


def inventory(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """path, name, kind, bytes, modified, sha256 of files at any depth; hidden ones are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.rlike(r"(?i)\.(npz|npy)$"), "array").when(name.rlike(r"(?i)\.(mp4|mkv|webm)$"), "video").when(name.rlike(r"(?i)\.json$"), "json").when(name.rlike(r"(?i)\.csv$"), "sheet").otherwise("other")
    return files.filter(~name.startswith(".")).select("path", name.alias("name"), kind.alias("kind"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def first_by_id(files: DataFrame, ident: str) -> DataFrame:
    """Of several files with one id the first by path."""
    return files.groupBy(ident).agg(F.min_by(F.struct(*[c for c in files.columns if c != ident]), "path").alias("__f")).select(ident, "__f.*")


def tensors(spark: SparkSession, path: str | list[str], key: str = "landmarks") -> DataFrame:
    """Landmark arrays of .npz (under `key`) and .npy files in long form: source, frame, row_no, x, y, z; what is missing (NaN) is null. A file that can't be read gives one row with readable = false."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[zy]").option("recursiveFileLookup", True).load(path).select("path", "content")

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"]):
                source = path.rsplit("/", 1)[-1]
                try:
                    got = np.load(io.BytesIO(content), allow_pickle=False)
                    a = np.asarray(got[key] if hasattr(got, "files") else got, np.float64)
                    t, r, _ = a.shape
                except Exception:  # noqa: BLE001
                    yield pd.DataFrame({"source": [source], "readable": [False], "frame": [None], "row_no": [None], "x": [None], "y": [None], "z": [None]})
                    continue
                yield pd.DataFrame({"source": source, "readable": True, "frame": np.repeat(np.arange(t), r), "row_no": np.tile(np.arange(r), t), "x": a[:, :, 0].ravel(), "y": a[:, :, 1].ravel(), "z": a[:, :, 2].ravel()})

    long = files.mapInPandas(rows, "source string, readable boolean, frame long, row_no int, x double, y double, z double")
    return long.select("source", "readable", "frame", "row_no", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("x", "y", "z")])


def html_rows(texts: DataFrame, text: str, name: str, schema: str) -> DataFrame:
    """Rows of a JavaScript literal `const NAME = [...]` in an HTML text."""
    raw = F.regexp_extract(text, rf"(?s)const\s+{name}\s*=\s*(\[.*?\])\s*;", 1)
    return texts.select(F.explode(F.from_json(raw, f"array<struct<{schema}>>")).alias("r")).select("r.*")


def todo(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't done yet: the resume rule of every crawl and extraction."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def links(html: Column) -> Column:
    """Distinct targets of a page's links, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"#?]+)"'), F.lit(1)))


def chunks(df: DataFrame, duration: str, size: float) -> DataFrame:
    """A row per piece of at most `size` seconds: chunk, offset, length. Times within a piece plus its offset are absolute again."""
    n = F.greatest(F.lit(1), F.ceil(F.col(duration) / size)).cast("int")
    own = df.filter(F.col(duration) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    return own.withColumn("offset", F.col("chunk") * F.lit(size)).withColumn("length", F.least(F.lit(size), F.col(duration) - F.col("chunk") * F.lit(size)))


def every_nth(frames: DataFrame, frame: str, n: int) -> DataFrame:
    """Every n-th frame of a scan, from frame 0, with `sampled`, its number among them."""
    return frames.filter(F.col(frame) % n == 0).withColumn("sampled", (F.col(frame) / n).cast("long"))


def parts(spark: SparkSession, path: str, keys: dict[str, Sequence[str]]) -> DataFrame:
    """Rows of a table in folders by key; only the folders of the wanted keys are read."""
    df = spark.read.parquet(path)
    for k, wanted in keys.items():
        df = df.filter(F.col(k).cast("string").isin(*wanted))
    return df
