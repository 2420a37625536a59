"""Operators on ordered rows of a key: neighbours, islands, runs, rolling statistics, onsets, bursts, interpolation.

A key with a third of all rows is spread over tasks: what needs the row before or running totals works in cells of the
order column (lag_in_cells, running_sum), and what needs a frame of rows in blocks of rows with a margin (in_row_blocks).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, Window as W, functions as F

from weftline.operators.lookup import BROADCAST_BYTES, all_null_safe, join_null_safe, lookup_join, measured_bytes
from weftline.operators.temporal import neighbours
from weftline.session import cut

#: Width of the cells in which rows are numbered, in units of the order column; and rows of a block with whole frames.
CELL, ROWS = 1 << 16, 1 << 16


def lag_in_cells(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], cell: float, out: str = "prev") -> DataFrame:
    """Add `out`, a struct of `columns` of the row before in the order of its key; null at the first row.

    order[0] is a number; its range is cut into cells, each sorted on its own, and each cell's last row is carried to
    the next cell that has rows. Rows with a null or NaN order[0] come first. The order must be total for a defined result.
    """
    keys = list(keys)
    t = F.col(order[0]).cast("double")
    at = F.coalesce(F.floor(F.nanvl(t, F.lit(None)) / F.lit(cell)), F.lit(-(1 << 60))).cast("long")
    own = df.withColumn("__cell", at).withColumn("__row", F.struct(*columns)).withColumn("__ord", F.struct(*order))
    inner = W.partitionBy(*keys, "__cell").orderBy(*order)
    lasts = own.groupBy(*keys, "__cell").agg(F.max(F.struct("__ord", "__row")).alias("__last"))
    lasts = lasts.withColumn("__carry", F.lag("__last").over(W.partitionBy(*keys).orderBy("__cell"))["__row"]).drop("__last")
    own = own.withColumn("__in", F.lag("__row").over(inner))
    both = own.join(lasts, all_null_safe(own, lasts, [*keys, "__cell"]))
    return both.select(*[own[c] for c in df.columns if c != out], F.coalesce("__in", "__carry").alias(out))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, cell: float, out: str) -> DataFrame:
    """Add `out`, the sum of `value` over the rows of the key up to and with this one. A text order[0] is cut into cells by its first two characters instead."""
    keys = list(keys)
    if dict(df.dtypes)[order[0]] == "string":
        at = F.coalesce(F.substring(order[0], 1, 2), F.lit(""))
    else:
        at = F.coalesce(F.floor(F.nanvl(F.col(order[0]).cast("double"), F.lit(None)) / F.lit(cell)), F.lit(-(1 << 60))).cast("long")
    own = df.withColumn("__cell", at)
    totals = own.groupBy(*keys, "__cell").agg(F.sum(value).alias("__s"))
    totals = totals.withColumn("__off", F.coalesce(F.sum("__s").over(W.partitionBy(*keys).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    own = own.withColumn("__in", F.sum(value).over(W.partitionBy(*keys, "__cell").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    both = own.join(totals, all_null_safe(own, totals, [*keys, "__cell"]))
    return both.select(*[own[c] for c in df.columns if c != out], (F.col("__in") + F.col("__off")).alias(out))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], cell: float, out: str) -> DataFrame:
    """Add `out`, the row's place in the order of its key, from 1; counted in cells (running_sum)."""
    return running_sum(df.withColumn("__one", F.lit(1).cast("long")), keys, order, "__one", cell, out).drop("__one")


def in_row_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], cell: float, before: int, after: int, size: int = ROWS) -> tuple[DataFrame, Window, Column]:
    """Rows ready for a frame of `before` rows before and `after` behind: the rows, a window over the frame, and whether a row is in its own block.

    A key's rows are numbered and cut into blocks of `size`; the rows near a block's border are copied to the next, so
    that every frame is whole and no key is sorted in one task. Compute over the window, then keep the rows in their own
    block and drop __i and __block.
    """
    block = lambda c: F.floor(c / size)
    i = F.col("__i")
    rows = numbered(df, keys, order, cell, "__i").withColumn("__block", F.explode(F.sequence(block(F.greatest(i - after, F.lit(1))), block(i + before))))
    return rows, W.partitionBy(*keys, "__block").orderBy("__i").rowsBetween(-before, after), F.col("__block") == block(i)


def islands(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], gap: float, cell: float, least: int = 1, pad: tuple[float, float] = (0, 0), clamp: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Runs of rows whose successive times are at most `gap` apart, with at least `least` rows: keys, start_at, end_at, n. Padded by `pad` and clamped. Rows without a time are left out."""
    order = [time, *tie]
    own = df.filter(F.col(time).isNotNull()).select(*dict.fromkeys([*keys, *order]))
    own = lag_in_cells(own, keys, order, [time], cell).withColumn("__brk", F.when(F.col(time) - F.col(f"prev.{time}") > gap, 1).otherwise(0))
    own = running_sum(own, keys, order, "__brk", cell, "__grp")
    runs = own.groupBy(*keys, "__grp").agg(F.min(time).alias("start_at"), F.max(time).alias("end_at"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    a, b = F.col("start_at") - pad[0], F.col("end_at") + pad[1]
    a = a if clamp[0] is None else F.greatest(a, F.lit(clamp[0]))
    b = b if clamp[1] is None else F.least(b, F.lit(clamp[1]))
    return runs.select(*keys, a.alias("start_at"), b.alias("end_at"), "n")


def runs_of(df: DataFrame, keys: Sequence[str], order: str, flag: str) -> DataFrame:
    """Runs of equal `flag` in successive rows: keys, flag, from, to, n. By the difference of two ranks."""
    w = W.partitionBy(*keys).orderBy(order)
    g = F.row_number().over(w) - F.row_number().over(W.partitionBy(*keys, flag).orderBy(order))
    return df.withColumn("__g", g).groupBy(*keys, flag, "__g").agg(F.min(order).alias("from"), F.max(order).alias("to"), F.count(F.lit(1)).alias("n")).drop("__g")


def longest_run(df: DataFrame, keys: Sequence[str], order: str, flag: str, value: object) -> DataFrame:
    """The length of the longest run of rows whose flag has the value; 0 for keys without one."""
    return runs_of(df, keys, order, flag).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(flag) == F.lit(value), F.col("n"))), F.lit(0)).cast("long").alias("longest"))


def trim(df: DataFrame, keys: Sequence[str], order: str, flag: str, buffer: int) -> DataFrame:
    """The rows from the first to the last with a true flag, widened by `buffer`; keys without one have no rows."""
    span = df.filter(F.col(flag)).groupBy(*keys).agg((F.min(order) - buffer).alias("__a"), (F.max(order) + buffer).alias("__b"))
    return df.join(span, list(keys)).filter(F.col(order).between(F.col("__a"), F.col("__b"))).drop("__a", "__b")


#: A column over a frame: what it is, given the frame's window, and the rows before and behind that the frame has.
Framed = tuple[Callable[[Window], Column], int, int]


def in_frames(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, Framed], cell: float = CELL) -> DataFrame:
    """Add several columns over frames of rows; rows are numbered and blocked once for all of them."""
    rows, w, own = in_row_blocks(df, keys, order, cell, max(x[1] for x in columns.values()), max(x[2] for x in columns.values()))
    made = rows.withColumns({out: make(w.rowsBetween(-before, after)) for out, (make, before, after) in columns.items()})
    return made.filter(own).drop("__i", "__block")


def rolling(value: str, half: int) -> dict[str, Framed]:
    """Centred mean and population deviation over 2 * half + 1 rows, roll_mean and roll_std; the frame shrinks at the edges."""
    return {"roll_mean": (lambda w: F.avg(value).over(w), half, half), "roll_std": (lambda w: F.stddev_pop(value).over(w), half, half)}


def moving_average(value: str, width: int, out: str = "ma") -> dict[str, Framed]:
    """Moving average as of a 'same' convolution: zero beyond the edges, a fixed divisor, even widths lean back."""
    return {out: (lambda w: F.sum(value).over(w) / F.lit(width), width // 2, width - 1 - width // 2)}


def average_of_known(value: str, half: int, least: int, out: str = "avg_known") -> dict[str, Framed]:
    """Centred average of the values that aren't null; null where fewer than `least` are known."""
    return {out: (lambda w: F.when(F.count(value).over(w) >= least, F.avg(value).over(w)), half, half)}


def robust_z(df: DataFrame, keys: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """(value - median) / (1.4826 * MAD) per key; null with fewer than three values, 0 where the MAD is nearly 0."""
    keys = list(keys)
    with_m = join_null_safe(df, df.groupBy(*keys).agg(F.median(value).alias("__m"), F.count(value).alias("__n")), keys)
    both = join_null_safe(with_m, with_m.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("__m"))).alias("__d")), keys)
    z = F.when(F.col("__n") < 3, None).when(F.col("__d") < 1e-9, F.lit(0.0) * F.col(value)).otherwise((F.col(value) - F.col("__m")) / (1.4826 * F.col("__d")))
    return both.withColumn(out, z).drop("__m", "__n", "__d")


def z_score(df: DataFrame, value: str, keys: Sequence[str], out: str = "z") -> DataFrame:
    """(value - mean) / population deviation of the key; only centred where the deviation is nearly 0. Mean and deviation are combined before the shuffle and joined back."""
    keys = list(keys)
    told = lookup_join(df, df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__d")), keys)
    centred = F.col(value) - F.col("__m")
    return told.withColumn(out, F.when(F.col("__d") > 1e-9, centred / F.col("__d")).otherwise(centred)).drop("__m", "__d")


def onsets(df: DataFrame, keys: Sequence[str], order: str, value: str, high: Column, low: Column, lull: int, cell: float = CELL) -> DataFrame:
    """Rows at which value rises above `high` after `lull` rows all below `low`. Thresholds may differ by row: each row is held against its own."""
    marked = df.withColumn("__up", F.col(value) > high).withColumn("__low", F.col(value) < low)
    rows, w, own = in_row_blocks(marked, keys, [order], cell, max(lull, 1), 0)
    before, last = w.rowsBetween(-lull, -1), w.rowsBetween(-1, -1)
    calm = (F.count("__low").over(before) == lull) & F.bool_and("__low").over(before)
    on = F.col("__up") & ~F.coalesce(F.max("__up").over(last), F.lit(False)) & F.coalesce(calm, F.lit(False))
    return rows.withColumn("__on", on).filter(own & F.col("__on")).drop("__up", "__low", "__on", "__i", "__block")


def bursts(df: DataFrame, keys: Sequence[str], frame: str, active: str, tolerate: int, least: int, merge: int) -> DataFrame:
    """Bursts of active frames: pauses of up to `tolerate` frames don't end a burst, bursts shorter than `least` are dropped, and those at most `merge` frames apart are joined. keys, onset, offset."""
    runs = islands(df.filter(F.col(active)).withColumn("__f", F.col(frame)), keys, "__f", [], tolerate + 1, 1 << 20).filter(F.col("end_at") - F.col("start_at") + 1 >= least)
    w = W.partitionBy(*keys).orderBy("start_at", "end_at")
    ends = runs.withColumn("__e", F.max("end_at").over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("__brk", F.when(F.col("start_at") - F.col("__e") > merge, 1).otherwise(0))
    groups = ends.withColumn("__g", F.sum("__brk").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return groups.groupBy(*keys, "__g").agg(F.min("start_at").alias("onset"), F.max("end_at").alias("offset")).drop("__g")


def in_cells(df: DataFrame, keys: Sequence[str], index: str, cell: float = CELL) -> DataFrame:
    """df with __cell, the cell of its index, and each cell of a key in one partition; null where the index is null or NaN."""
    return df.withColumn("__cell", F.floor(F.nanvl(F.col(index).cast("double"), F.lit(None)) / F.lit(cell)).cast("long")).repartition(*keys, "__cell")


def beside_known(df: DataFrame, keys: Sequence[str], index: str, values: Sequence[str], cell: float = CELL) -> DataFrame:
    """Add for each of `values` the known ones next to a row by index: structs of t, the index, and v: <value>_before, at its own index or the last before, and <value>_after, at its own or the first after.

    Of rows at the same index the least known value counts; rows without an index get none. Both frames grow from the
    cell's end, so a cell is gone through once each way; cells' ends are carried on where a key has several cells. df
    may come from in_cells already.
    """
    keys, up_to = list(keys), (W.unboundedPreceding, W.currentRow)
    own = df if "__cell" in df.columns else in_cells(df, keys, index, cell)
    least = {v: F.min(v).over(W.partitionBy(*keys, "__cell", index)) for v in values}
    own = own.withColumns({f"__at_{v}": c for v, c in least.items()})
    at = {v: F.when(F.col("__cell").isNotNull() & F.col(f"__at_{v}").isNotNull(), F.struct(F.col(index).alias("t"), F.col(f"__at_{v}").alias("v"))) for v in values}

    ends = own.filter("__cell is not null").groupBy(*keys, "__cell").agg(*[f(at[v]).alias(f"__{f.__name__}_{v}") for v in values for f in (F.min, F.max)])
    w = W.partitionBy(*keys)
    before = {f"__b_{v}": F.last(f"__max_{v}", True).over(w.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)) for v in values}
    after = {f"__a_{v}": F.last(f"__min_{v}", True).over(w.orderBy(F.desc("__cell")).rowsBetween(W.unboundedPreceding, -1)) for v in values}
    ends = ends.withColumns(before | after).select(*keys, "__cell", *before, *after)
    ends = cut(ends.filter(" or ".join(f"`{c}` is not null" for c in (*before, *after))))

    w = W.partitionBy(*keys, "__cell")
    seen = own.withColumns({f"{v}_before": F.last(at[v], True).over(w.orderBy(index).rowsBetween(*up_to)) for v in values} | {f"{v}_after": F.last(at[v], True).over(w.orderBy(F.desc(index)).rowsBetween(*up_to)) for v in values})
    size = measured_bytes(ends.select(*keys, "__cell", *[F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in (*before, *after) for x in "tv"]))
    if size:
        seen = join_null_safe(seen, F.broadcast(ends) if size <= BROADCAST_BYTES else ends, [*keys, "__cell"], "left")
        seen = seen.withColumns({f"{v}_before": F.coalesce(f"{v}_before", f"__b_{v}") for v in values} | {f"{v}_after": F.coalesce(f"{v}_after", f"__a_{v}") for v in values}).drop(*before, *after)
    return seen.drop("__cell", *[f"__at_{v}" for v in values])


def on_the_line(index: str, value: str) -> Column:
    """After beside_known: the value, else that on the line between the known ones next to it by index; flat beyond the first and the last; null where none is known."""
    a, b = F.col(f"{value}_before"), F.col(f"{value}_after")
    return F.coalesce(value, a["v"] + (b["v"] - a["v"]) * (F.col(index) - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0)), a["v"], b["v"])


def interpolate(df: DataFrame, keys: Sequence[str], index: str, value: str, out: str, cell: float = CELL) -> DataFrame:
    """Fill null values on the line between the known ones next to them (on_the_line)."""
    return beside_known(df, keys, index, [value], cell).withColumn(out, on_the_line(index, value)).drop(f"{value}_before", f"{value}_after")


def carried(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, cell: float = CELL) -> DataFrame:
    """The last known value up to each row."""
    return beside_known(df, keys, order, [value], cell).withColumn(out, F.col(f"{value}_before.v")).drop(f"{value}_before", f"{value}_after")


def groups_closed_by(df: DataFrame, keys: Sequence[str], order: str, closes: Column, out: str, cell: float = CELL) -> DataFrame:
    """Number the groups of rows, from 0, each closed after a row for which `closes` holds. Closed groups are counted in cells."""
    own = df.withColumn("__c", F.coalesce(closes, F.lit(False)).cast("int"))
    return running_sum(own, keys, [order], "__c", cell, "__upto").withColumn(out, F.col("__upto") - F.col("__c")).drop("__c", "__upto")


def thin(df: DataFrame, keys: Sequence[str], time: str, tie: str, apart: float) -> DataFrame:
    """Keep a row if it is at least `apart` after the last kept one of its key; the first is kept. Adds nothing.

    Rows at least `apart` after the row before them are kept whatever was kept before. From these, every kept row leads to
    the next: the first row at least `apart` later. The kept rows are found by doubling: each round adds the rows that
    the ones found so far lead to and makes every lead twice as long, so a chain of n kept rows takes log n rounds, and
    no run of rows, however dense, comes together in one task. Rows without a time are left out.
    """
    keys, order, cell = list(keys), [time, tie], max(apart * 64, 1e-9)
    own = df.filter(F.col(time).isNotNull()).select(*keys, time, tie).distinct()
    own = lag_in_cells(own, keys, order, [time], cell)
    opens = F.coalesce(F.col(time) - F.col(f"prev.{time}") >= apart, F.lit(True))
    later = neighbours(own.withColumn("__open", opens).drop("prev").withColumn("__from", F.col(time) + apart), own.select(*keys, time, tie), keys, "__from", time, [tie], cell)
    to = F.when(F.col("before.t") == F.col("__from"), F.col("before")).otherwise(F.col("after"))
    leads = cut(later.select(*keys, time, tie, "__open", to.alias("__to")).select(*keys, time, tie, "__open", F.col("__to.t").alias("__t"), F.col(f"__to.{tie}").alias("__i")))
    kept, leads = leads.filter("__open").select(*keys, time, tie), leads.filter("__t is not null").select(*keys, time, tie, "__t", "__i")
    n = kept.count()
    while True:
        led = join_null_safe(leads, kept, [*keys, time, tie]).select(*keys, F.col("__t").alias(time), F.col("__i").alias(tie))
        kept = cut(kept.unionByName(led).distinct())
        more = kept.count()
        if more == n:
            return join_null_safe(df, kept, [*keys, time, tie], "left_semi")
        n = more
        beyond = leads.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(time).alias("__at"), F.col(tie).alias("__ai"), F.col("__t").alias("__t2"), F.col("__i").alias("__i2"))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        leads = cut(leads.join(beyond, same & (F.col("__t") == F.col("__at")) & F.col("__i").eqNullSafe(F.col("__ai"))).select(*keys, time, tie, F.col("__t2").alias("__t"), F.col("__i2").alias("__i")))


def contexts(df: DataFrame, keys: Sequence[str], order: Sequence[str], word: str, hit: Column, reach: int, fallback: int, least: int, out: str, cell: float = CELL) -> DataFrame:
    """Rows for which `hit` holds with `out`, the words around them, the row's own between **.

    To each side up to `reach` words, but not beyond a word that ends a sentence; where that gives fewer than `least`
    words in all, `fallback` words to each side. Words mustn't be null.
    """
    rows, w, own = in_row_blocks(df.withColumn("__hit", hit), keys, order, cell, reach, reach)
    ends = lambda x: x.rlike(r"[.!?…]\s*$")
    b, a = F.collect_list(word).over(w.rowsBetween(-reach, -1)), F.collect_list(word).over(w.rowsBetween(0, reach))
    near = rows.withColumn("__b", b).withColumn("__a", a).filter(own & F.col("__hit"))
    first = lambda c: F.array_position(F.transform(c, ends), True)
    pb, pa = first(F.reverse("__b")), first(F.slice("__a", 1, reach))
    near = near.withColumn("__l", F.when(pb > 0, pb - 1).otherwise(F.size("__b"))).withColumn("__r", F.when(pa > 0, pa - 1).otherwise(F.least(F.lit(reach), F.size("__a") - 1)))
    short = F.col("__l") + F.col("__r") + 1 < least
    left, right = F.when(short, F.least(F.lit(fallback), F.size("__b"))).otherwise(F.col("__l")), F.when(short, F.least(F.lit(fallback), F.size("__a") - 1)).otherwise(F.col("__r"))
    near = near.withColumns({"__l": left.cast("int"), "__r": right.cast("int")})
    said = F.concat(F.slice("__b", F.size("__b") - F.col("__l") + 1, F.col("__l")), F.array(F.concat(F.lit("**"), F.trim(word), F.lit("**"))), F.slice("__a", F.lit(2), F.col("__r")))
    return near.withColumn(out, F.array_join(F.transform(said, lambda x: F.trim(x)), " ")).select(*df.columns, out)


def stride(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: int, cell: float = CELL) -> DataFrame:
    """Every step-th row of a key, from the first."""
    return numbered(df, keys, order, cell, "__n").filter((F.col("__n") - 1) % step == 0).drop("__n")


def density(df: DataFrame, keys: Sequence[str], time: str, reach: float, out: str = "n_near") -> DataFrame:
    """How many rows of the key lie within `reach` of each row, itself included. Time is cut into cells of 16 reaches, and rows near a border are copied to the next cell."""
    at = lambda c: F.floor(c / F.lit(reach * 16)).cast("long")
    t = F.col(time)
    rows = df.withColumn("__cell", F.explode(F.sequence(at(t - reach), at(t + reach))))
    w = W.partitionBy(*keys, "__cell").orderBy(time).rangeBetween(-reach, reach)
    return rows.withColumn(out, F.count(F.lit(1)).over(w).cast("long")).filter(F.col("__cell") == at(t)).drop("__cell")


def extrema(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, cell: float = CELL) -> DataFrame:
    """How often the direction of a series changes; equal neighbours have none."""
    own = df.select(*dict.fromkeys([*keys, *order, value]))
    d = lag_in_cells(own, keys, order, [value], cell).withColumn("__d", F.signum(F.col(value) - F.col(f"prev.{value}"))).drop("prev").filter("__d <> 0")
    turns = lag_in_cells(d, keys, order, ["__d"], cell).withColumn("__t", (F.col("__d") != F.col("prev.__d")).cast("int"))
    return df.select(*keys).distinct().join(turns.groupBy(*keys).agg(F.coalesce(F.sum("__t"), F.lit(0)).alias("n_extrema")), list(keys), "left").fillna(0, ["n_extrema"])
