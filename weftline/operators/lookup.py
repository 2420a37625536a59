"""Joins of a large side with a dictionary whose size is checked before it is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from weftline.session import cut

BROADCAST_BYTES = 8 << 20
SALTS = 16


def all_null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of the keys where null equals null."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def join_null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys where null equals null; the keys are a's."""
    renamed = b.withColumnsRenamed({k: f"__j{i}" for i, k in enumerate(keys)})
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__j{i}"))
    return a.join(renamed, cond, how).drop(*[f"__j{i}" for i in range(len(keys))])


def measured_bytes(df: DataFrame) -> int:
    """Bytes of df's values: strings by their length, arrays by 16 an element, all else 8 a column."""
    size = F.lit(16)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0)) + 8
        elif isinstance(f.dataType, T.ArrayType):
            size = size + 16 + 16 * F.greatest(F.size(f.name), F.lit(0))
        else:
            size = size + 8
    return df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("b")).first()["b"]


def lookup_join(rows: DataFrame, dictionary: DataFrame, keys: Sequence[str], how: str = "left", max_bytes: int = BROADCAST_BYTES, salts: int = SALTS, written: bool = False) -> DataFrame:
    """Join rows with a dictionary that has one row per key.

    The dictionary is written to the shared folder once (unless it is `written` already) and measured. Up to max_bytes it is broadcast, so that rows
    never shuffle. Beyond, rows are spread over `salts` parts of each key and the dictionary is repeated that often:
    a key that holds a third of all rows is then spread over that many tasks. Null keys match nothing. Only the
    dictionary's columns beside the keys are added; they replace columns of rows that have the same names.
    """
    keys = list(keys)
    added = [c for c in dictionary.columns if c not in keys]
    rows = rows.drop(*added)
    small = dictionary if written else cut(dictionary)
    if measured_bytes(small) <= max_bytes:
        return rows.join(F.broadcast(small), keys, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return spread.join(salted, [*keys, "__salt"], how).drop("__salt")


def distinct_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: repeated rows count once. Of rows that share a key but differ, the least by all columns stays, so the result doesn't depend on the order of rows."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def single_rows(df: DataFrame, keys: Sequence[str], max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """distinct_rows for wide rows of which few repeat: only rows whose key is repeated are shuffled, all others stay where they are.

    The keys alone are counted first; the repeated ones are written, measured and broadcast. With too many of them for a
    broadcast all rows go the way of distinct_rows. Null keys are a key of their own.
    """
    keys = list(keys)
    twice = cut(df.groupBy(*keys).count().filter("count > 1").select(*keys, F.lit(True).alias("__twice")))
    size = measured_bytes(twice)
    if not size:
        return df
    if size > max_bytes:
        return distinct_rows(df, keys)
    marked = join_null_safe(df, F.broadcast(twice), keys, "left")
    return marked.filter("__twice is null").drop("__twice").unionByName(distinct_rows(marked.filter("__twice").drop("__twice"), keys))


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a one-row aggregate beside each row, as scalar subqueries: no join."""
    return df.select("*", *[one.select(c).scalar().alias(c) for c in one.columns])
