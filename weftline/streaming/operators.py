"""Streaming operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(stream: DataFrame, time: str, size: str, keys: list[str], value: str) -> DataFrame:
    """Count and sum per key and window."""
    return stream.groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(stream: DataFrame, time: str, size: str, step: str, keys: list[str]) -> DataFrame:
    """Count per key and overlapping window."""
    return stream.groupBy(F.window(time, size, step), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str]) -> DataFrame:
    """Sessions per key that end after a pause of `gap`."""
    return stream.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_within(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return stream.dropDuplicatesWithinWatermark(keys)


def absence(stream: DataFrame, key: str, time: str, present: str, threshold: int, tie: str) -> DataFrame:
    """A row whenever a key was absent for `threshold` successive rows; the count then starts anew: key, at, n.

    State per key is one counter; rows of a batch are taken in the order of time, those of one time by `tie`.
    """

    def count(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values([time, tie])
        found = []
        for at, here in zip(rows[time], rows[present]):
            run = 0 if here else run + 1
            if run >= threshold:
                found.append((k[0], at, run))
                run = 0
        state.update((run,))
        yield pd.DataFrame(found, columns=["key", "at", "n"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(count, f"key {kind}, at timestamp, n int", "run int", "append", GroupStateTimeout.NoTimeout)
