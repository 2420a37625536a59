"""Pair records of two tables that are nearest in time within a tolerance (problem 4).

Method: tolerance-width time buckets, a join on entity and same or adjacent bucket, a filter by difference, and the
minimum by (difference, time, key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.llm.blocks import CROWDED, PAIRS, join_in_blocks

#: Times are doubles; differences beyond the tolerance by no more than this still count.
SLACK = 1e-9


def nearest_within(left: DataFrame, right: DataFrame, tolerance: float, crowded: int = CROWDED, pairs_a_part: int = PAIRS) -> DataFrame:
    """left_key, right_key of each left record with a right record of its entity at most `tolerance` away, the nearest one.

    left: entity, time, key; right: the same. Repeated rows count once. Records with a null or NaN time or a null entity
    have no partner. Ties: the earlier right record, then the least key. Equal right times of an entity are reduced to
    one row before anything is joined. A left record looks at three buckets; crowded buckets are dealt into parts of
    about `pairs_a_part` pairs (join_in_blocks), and every pair is still looked at.
    """
    width = tolerance + 2 * SLACK
    sound = "entity is not null and time is not null and not isnan(time)"
    bucket = F.floor(F.col("time") / F.lit(width)).cast("long").alias("bucket")
    at = ["entity", "bucket"]
    own = left.filter(sound).select("entity", "time", F.col("key").alias("left_key"), bucket).distinct()
    points = right.filter(sound).select("entity", "time", "key", bucket).groupBy(*at, "time").agg(F.min("key").alias("right_key"))
    spread = own.withColumn("bucket", F.explode(F.expr("sequence(bucket - 1, bucket + 1)")))
    others = points.withColumnRenamed("time", "right_time")
    pairs = join_in_blocks(spread, others, at, "left_key", crowded, pairs_a_part)
    pairs = pairs.withColumn("d", F.abs(F.col("right_time") - F.col("time"))).filter(F.col("d") <= tolerance + SLACK)
    best = pairs.groupBy("left_key").agg(F.min(F.struct("d", "right_time", "right_key")).alias("m"))
    return best.select("left_key", F.col("m.right_key").alias("right_key"))
