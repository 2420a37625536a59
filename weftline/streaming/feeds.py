"""Streams over a folder of Parquet files, and their results as tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.session import checkpoint_dir


def feed(spark: SparkSession, folder: str, name: str, time: str, delay: str) -> DataFrame:
    """A table as a stream with a watermark. Times without a zone are read as instants, as a watermark needs them."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    stream = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there now and return its rows, from Parquet files in the shared folder."""
    spark = stream.sparkSession
    where = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{where}/state").option("path", f"{where}/rows").outputMode("append").trigger(availableNow=True).start()
    else:
        def save(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{where}/rows")

        q = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{where}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")
