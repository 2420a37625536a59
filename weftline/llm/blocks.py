"""Joins of records that meet in blocks, with blocks that are crowded dealt into parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from weftline.operators.lookup import lookup_join
from weftline.session import cut

#: A block with more right rows than CROWDED is counted; its left rows are dealt into parts of at most PAIRS pairs each.
CROWDED, PAIRS = 256, 1 << 22


def join_in_blocks(left: DataFrame, right: DataFrame, block: Sequence[str], ident: str, crowded: int = CROWDED, pairs_a_part: int = PAIRS) -> DataFrame:
    """left joined with right on the columns of `block`.

    Where many rows crowd into one block, its left rows are dealt into parts by a hash of `ident`, and its right rows are
    repeated for each part, so that no task has more than about `pairs_a_part` pairs of a block to look at; every pair is
    still looked at. Null blocks match nothing. The other columns must have different names.
    """
    at = list(block)
    many = cut(right.groupBy(*at).agg(F.count(F.lit(1)).alias("__right")).filter(F.col("__right") > crowded))
    if many.isEmpty():
        return left.join(right, at)
    loads = lookup_join(left.groupBy(*at).agg(F.count(F.lit(1)).alias("__left")), many, at, how="inner", written=True)
    parts = cut(loads.select(*at, F.ceil(F.col("__left") * F.col("__right") / pairs_a_part).cast("int").alias("__parts")).filter("__parts > 1"))
    n = F.coalesce("__parts", F.lit(1))
    dealt = lookup_join(left, parts, at, written=True).withColumn("__part", F.pmod(F.xxhash64(ident), n).cast("int")).drop("__parts")
    copied = lookup_join(right, parts, at, written=True).withColumn("__part", F.explode(F.sequence(F.lit(0), n - 1))).drop("__parts")
    return dealt.join(copied, [*at, "__part"]).drop("__part")
