"""Separate the rows that can't be loaded, with the reason, from the typed rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from weftline.operators.lookup import lookup_join
from weftline.session import cut

#: A field without any quote, or one enclosed whole in quotes with the inner ones doubled. Possessive, so that long fields need no stack.
FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"(?=,|\z)|[^",]*+(?=,|\z))'
WELL_QUOTED = rf"\A{FIELD}(?:,{FIELD})*+\z"
EACH_FIELD = rf",({FIELD})"
PLAIN_DECIMAL = r"\A *[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+) *\z"
BLANK = r"\A *\z"


def is_blank(c: Column) -> Column:
    """Null, empty or plain blanks only."""
    return c.isNull() | c.rlike(BLANK)


def is_decimal(c: Column) -> Column:
    """A plain decimal number: blanks around, a sign, digits 0-9 and one point at most, at least one digit."""
    return c.rlike(PLAIN_DECIMAL)


def decimal_less(a: Column, b: Column) -> Column:
    """a < b for plain decimal numbers; exact where both have up to 20 digits before and 18 behind the point, else as doubles."""
    x, y = (F.trim(c).try_cast("decimal(38,18)") for c in (a, b))
    return F.coalesce(x < y, F.trim(a).try_cast("double") < F.trim(b).try_cast("double"))


@dataclass(frozen=True)
class Domain:
    """The values a column may have. `accepts` is asked once per distinct value."""

    column: str
    reason: str
    accepts: Callable[[Column], Column]


def invalid_values(df: DataFrame, domains: Sequence[Domain]) -> DataFrame:
    """The dictionary of invalid values: fld, value, reason. Each distinct value of a column is judged once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d.column).alias("fld"), F.col(d.column).alias("value")) for d in domains]))
    values = df.select(pairs.alias("p")).select("p.*").filter("value is not null").distinct()
    reason = F.lit(None).cast("string")
    for d in domains:
        reason = F.when((F.col("fld") == d.column) & ~F.coalesce(d.accepts(F.col("value")), F.lit(False)), F.lit(d.reason)).otherwise(reason)
    return values.withColumn("reason", reason).filter("reason is not null")


def with_reason(df: DataFrame, domains: Sequence[Domain], structural: Column | None = None, across: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """df with a column `reason`: null for rows that can be loaded, else the first reason that applies.

    structural: a string column with the reason found in the row's form, or null. domains: in their order of precedence.
    across: (reason, condition) on several columns, judged after the domains. Null values are always accepted by a domain.
    """
    bad = cut(invalid_values(df if structural is None else df.filter(structural.isNull()), domains))
    first = [] if structural is None else [structural]
    out = df
    for i, d in enumerate(domains):
        own = bad.filter(F.col("fld") == d.column).select(F.col("value").alias(d.column), F.col("reason").alias(f"__bad{i}"))
        out = lookup_join(out, own, [d.column], written=True)
        first.append(F.col(f"__bad{i}"))
    first += [F.when(F.coalesce(cond, F.lit(False)), F.lit(r)) for r, cond in across]
    return out.withColumn("reason", F.coalesce(*first, F.lit(None).cast("string"))).drop(*[f"__bad{i}" for i in range(len(domains))]).select(*df.columns, "reason")


def parse_lines(df: DataFrame, line: str, columns: Sequence[str]) -> DataFrame:
    """Split raw comma-separated lines, one whole record each, into the columns and a column `form`: null, 'quoting' or 'columns'.

    A carriage return at the end is dropped. Header lines (the columns' names) and null, empty or blank lines are no
    records and give no row. Line breaks inside quotes are part of the field. Lines whose form is wrong have null columns.
    Input columns with the names of the result's are replaced.
    """
    columns = list(columns)
    text = F.regexp_replace(F.col(line), r"\r\z", "")
    own = df.withColumn("__t", text).filter(F.col("__t").isNotNull() & ~F.col("__t").rlike(BLANK) & (F.regexp_replace("__t", '"', "") != ",".join(columns)))
    well = F.col("__t").rlike(WELL_QUOTED)
    fields = F.when(well, F.regexp_extract_all(F.concat(F.lit(","), "__t"), F.lit(EACH_FIELD), F.lit(1)))
    own = own.withColumn("__f", fields)
    form = F.when(F.col("__f").isNull(), "quoting").when(F.size("__f") != len(columns), "columns")
    own = own.withColumn("form", form)
    for i, c in enumerate(columns):
        raw = F.col("__f")[i]
        plain = F.when(raw.startswith('"'), F.regexp_replace(F.substring(raw, F.lit(2), F.length(raw) - 2), '""', '"')).otherwise(raw)
        own = own.withColumn(c, F.when(F.col("form").isNull(), plain))
    return own.drop("__t", "__f")
