"""Queries on words and documents (problems 3, 6, 7, 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.catalog import table
from weftline.llm.lookalikes import canonical_forms, changed_forms
from weftline.llm.packing import CAPACITY, pack
from weftline.llm.registry import LLM
from weftline.llm.tokenizer import encode
from weftline.llm.truncation import cut_texts
from weftline.operators.lookup import single_rows
from weftline.session import cut


def words(spark: SparkSession, folder: str) -> DataFrame:
    """fld, video, rec, word of every heard and every matched word; repeated rows as they are."""
    heard = table(spark, folder, "asr").select(F.lit("asr").alias("fld"), "video", F.col("idx").cast("string").alias("rec"), "word")
    matched = table(spark, folder, "word_times").select(F.lit("word_times").alias("fld"), "video", F.col("file").alias("rec"), F.col("surface").alias("word"))
    return heard.unionByName(matched)


@LLM.add("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The rows whose word isn't in its canonical form."""
    every = words(spark, folder)
    forms = cut(changed_forms(every, "word"))
    suspects = every.filter(F.col("word").rlike(r"[^ -~]"))
    return canonical_forms(suspects, "word", "canonical", forms).filter("canonical <> word").select("fld", "video", "rec").distinct()


@LLM.add("p3_words")
def p3_words(spark: SparkSession, folder: str) -> DataFrame:
    """How often each canonical word is heard or matched, and in how many stored spellings."""
    return canonical_forms(words(spark, folder).filter("word is not null"), "word", "canonical").groupBy("canonical", "word").count().groupBy("canonical").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_spellings"))


@LLM.add("p6_ids")
def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of each document's text, one row per document."""
    own = single_rows(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    return encode(own, "text", "ids", keep=["doc_id"])


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents").select("doc_id", "text"), "text", "n_tokens", keep=["doc_id"], counts=True)


@LLM.add("p7_packed")
def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each document, or of each piece of one that exceeds the capacity of 2,048 tokens."""
    return pack(sizes(spark, folder), "doc_id", "n_tokens", CAPACITY)


@LLM.add("p7_fill")
def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How many containers there are and how many of them the program filled, the tokens in them, the share of unused space, and the least number of containers by size alone."""
    used = pack(sizes(spark, folder), "doc_id", "n_tokens", CAPACITY).groupBy("container", "planned").agg(F.sum("size").alias("used"))
    totals = used.agg(F.count(F.lit(1)).alias("n_containers"), F.count_if("planned").alias("n_planned"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    return totals.withColumn("n_least", F.ceil(F.col("n_tokens") / CAPACITY)).withColumn("unused", 1 - F.col("n_tokens") / (F.col("n_containers") * CAPACITY))


@LLM.add("p8_found")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents whose text was cut."""
    return cut_texts(table(spark, folder, "documents"), "doc_id", "source", "text").select("doc_id").distinct()


@LLM.add("p8_rates")
def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: documents, how many were cut by the field and in transfer, and the share of them."""
    docs = table(spark, folder, "documents")
    found = cut_texts(docs, "doc_id", "source", "text").groupBy("source").agg(F.count_if(F.col("why") == "field").alias("n_field"), F.count_if(F.col("why") != "field").alias("n_transfer"))
    every = docs.groupBy("source").agg(F.countDistinct("doc_id").alias("n_documents"))
    both = every.join(found.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").fillna(0, ["n_field", "n_transfer"])
    return both.withColumn("share_cut", (F.col("n_field") + F.col("n_transfer")) / F.col("n_documents"))
