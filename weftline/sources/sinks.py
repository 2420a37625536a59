"""Sinks: sheets, JSON documents, subtitles, resumable and staged writes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from weftline.functions.text import clock
from weftline.operators.merging import upsert


def write_sheet(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A CSV with a header and the columns in this order; quotes are doubled, null is empty."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def json_document(df: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], name: str) -> DataFrame:
    """A JSON document per key with its rows as an ordered list: keys, document."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*fields).alias("v"))))
    return df.groupBy(*keys).agg(items.alias("__i")).select(*keys, F.to_json(F.struct(*keys, F.transform("__i", lambda x: x["v"]).alias(name))).alias("document"))


def subtitles(df: DataFrame, key: str, order: str, start: str, end: str, text: str) -> DataFrame:
    """A subtitle text per key, its cues numbered and in order; times below zero are zero. Blank lines within a text, which would end its cue, are left out."""
    brk = r"[ \t]*[\r\n][ \t\r\n]*"
    said = F.regexp_replace(F.regexp_replace(F.col(text), rf"\A{brk}|{brk}\z", ""), brk, "\n")
    cue = F.concat_ws("\n", F.concat(clock(F.col(start)), F.lit(" --> "), clock(F.col(end))), said)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cue.alias("c")))), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["c"]))
    return df.groupBy(key).agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(lines, "\n\n"), F.lit("\n")).alias("document"))


def shifted(df: DataFrame, start: str, end: str, by: float, end_by: float | None = None) -> DataFrame:
    """Cues shifted in time, not below zero."""
    return df.withColumn(start, F.greatest(F.lit(0.0), F.col(start) + by)).withColumn(end, F.greatest(F.lit(0.0), F.col(end) + (by if end_by is None else end_by)))


def write_text(df: DataFrame, key: str, document: str, path: str) -> None:
    """One folder per key with its document as text."""
    df.select(key, F.col(document).alias("value")).write.mode("overwrite").partitionBy(key).option("lineSep", "\u0000").text(path)


def write_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key isn't there yet; a second run adds nothing."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
        df = df.join(done, key, "left_anti")
    except Exception as x:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(x):
            raise
    df.write.mode("append").parquet(path)


def replace_upserted(df: DataFrame, path: str, key: str, keep_if_blank: Sequence[str] = ()) -> str:
    """Upsert a Parquet table: the new version is written beside the old and its path returned; the old stays readable."""
    old = df.sparkSession.read.parquet(path)
    fresh = f"{path.rstrip('/')}-{uuid.uuid4().hex[:8]}"
    upsert(df, old, key, keep_if_blank).write.parquet(fresh)
    return fresh


def write_xml(df: DataFrame, path: str, root: str, row: str) -> None:
    df.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).save(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A JSON text a row; null fields are left out."""
    df.write.mode("overwrite").json(path)


def write_parts(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Compressed columns in one folder a key; a key's rows come together, dealt into several files by a hash where they are many."""
    df.repartition(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.mode("overwrite").option("maxRecordsPerFile", 1 << 20).partitionBy(*keys).parquet(path)
