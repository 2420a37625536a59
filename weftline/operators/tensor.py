"""Landmarks in long form: video, file, frame, row_no, x, y, z; what is missing is null. Rows 0-20 are the left hand, 21-41 the right, 42-74 the body, from 75 the face."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.functions.vectors import mirror_row
from weftline.operators.lookup import join_null_safe
from weftline.operators.temporal import in_interval

# Rows of the shoulders within a frame.
SHOULDERS = (53, 54)


def coverage(points: DataFrame, keys: Sequence[str], rows: tuple[int, int]) -> DataFrame:
    """Share of a key's frames with any point known in rows [a, b)."""
    known = F.bool_or(F.col("row_no").between(rows[0], rows[1] - 1) & F.col("x").isNotNull())
    return points.groupBy(*keys, "frame").agg(known.alias("k")).groupBy(*keys).agg(F.avg(F.col("k").cast("int")).alias("coverage"), F.count(F.lit(1)).alias("n_frames"))


def missing_share(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.avg(F.col("x").isNull().cast("int")).alias("missing"))


def motion(points: DataFrame, keys: Sequence[str], rows: tuple[int, int] = (0, 42)) -> DataFrame:
    """Energy per frame: the mean distance points moved since the frame before, of those known in both; 0 if none is. Each point is a series of its own, so no key is sorted in one task."""
    w = W.partitionBy(*keys, "row_no").orderBy("frame")
    p = points.filter(F.col("row_no").between(rows[0], rows[1] - 1))
    d = p.withColumn("__d", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    return d.groupBy(*keys, "frame").agg(F.coalesce(F.avg("__d"), F.lit(0.0)).alias("energy"))


def path_length(points: DataFrame, keys: Sequence[str], row: int) -> DataFrame:
    """How far one point travels."""
    w = W.partitionBy(*keys).orderBy("frame")
    p = points.filter((F.col("row_no") == row) & F.col("x").isNotNull())
    d = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return p.withColumn("__d", d).groupBy(*keys).agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias("path"))


def dominant_side(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left or right, by the longer path of the wrist; right on a tie."""
    left, right = path_length(points, keys, 0).withColumnRenamed("path", "l"), path_length(points, keys, 21).withColumnRenamed("path", "r")
    both = left.join(right, list(keys), "full_outer")
    return both.select(*keys, F.when(F.coalesce("l", F.lit(0.0)) > F.coalesce("r", F.lit(0.0)), "left").otherwise("right").alias("side"))


def mirror(points: DataFrame) -> DataFrame:
    """x becomes 1 - x and the hands change places; twice is as before."""
    return points.withColumn("x", 1 - F.col("x")).withColumn("row_no", mirror_row(F.col("row_no")))


def unmirror(points: DataFrame, side: str) -> DataFrame:
    """x flipped back for rows whose file is labelled left."""
    return points.withColumn("x", F.when(F.col(side) == "left", 1 - F.col("x")).otherwise(F.col("x")))


def body_frame(points: DataFrame, keys: Sequence[str], per_frame: bool = False, shoulders: tuple[int, int] = SHOULDERS) -> DataFrame:
    """Coordinates relative to the middle of the shoulders, in shoulder widths; (0.5, 0.5) and 1 where the shoulders are unknown; a missing point is the body's centre."""
    by = [*keys, "frame"] if per_frame else list(keys)
    s = points.filter(F.col("row_no").isin(*shoulders)).groupBy(*dict.fromkeys([*keys, "frame"])).agg(
        F.max(F.when(F.col("row_no") == shoulders[0], F.struct("x", "y"))).alias("a"), F.max(F.when(F.col("row_no") == shoulders[1], F.struct("x", "y"))).alias("b")
    )
    s = s.withColumn("cx", (F.col("a.x") + F.col("b.x")) / 2).withColumn("cy", (F.col("a.y") + F.col("b.y")) / 2).withColumn("w", F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")))
    s = s.filter("cx is not null and w > 1e-6").groupBy(*by).agg(F.avg("cx").alias("cx"), F.avg("cy").alias("cy"), F.avg("w").alias("w"))
    p = join_null_safe(points, s, by, "left")
    rel = lambda c, m: F.coalesce((F.col(c) - F.coalesce(m, F.lit(0.5))) / F.coalesce("w", F.lit(1.0)), F.lit(0.0))
    return p.withColumn("x", rel("x", "cx")).withColumn("y", rel("y", "cy")).drop("cx", "cy", "w")


def dense(points: DataFrame, keys: Sequence[str], n_rows: int) -> DataFrame:
    """Every frame of a key from the first to the last with every row; what isn't there is null, and of several records the last by `z` counts."""
    ends = points.groupBy(*keys).agg(F.min("frame").alias("__a"), F.max("frame").alias("__b"))
    grid = ends.withColumn("frame", F.explode(F.sequence("__a", "__b"))).withColumn("row_no", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))).drop("__a", "__b")
    one = points.groupBy(*keys, "frame", "row_no").agg(F.max(F.struct("z", "x", "y")).alias("p"))
    return grid.join(one, [*keys, "frame", "row_no"], "left").select(*keys, "frame", "row_no", "p.x", "p.y", "p.z")


def robust_box(points: DataFrame, keys: Sequence[str], rows: tuple[int, int], pad: float) -> DataFrame:
    """A box around the points without the outermost 2 %, padded by a share of its size, within 0 and 1."""
    p = points.filter(F.col("row_no").between(rows[0], rows[1] - 1) & F.col("x").isNotNull()).groupBy(*keys).agg(F.percentile("x", [0.02, 0.98]).alias("px"), F.percentile("y", [0.02, 0.98]).alias("py"))
    dx, dy = (F.col("px")[1] - F.col("px")[0]) * pad, (F.col("py")[1] - F.col("py")[0]) * pad
    low, high = (lambda c: F.greatest(F.lit(0.0), c)), (lambda c: F.least(F.lit(1.0), c))
    return p.select(*keys, low(F.col("px")[0] - dx).alias("x0"), low(F.col("py")[0] - dy).alias("y0"), high(F.col("px")[1] + dx).alias("x1"), high(F.col("py")[1] + dy).alias("y1"))


def best_region(candidates: DataFrame, keys: Sequence[str], region: str, hit_rate: str, bonus: Column) -> DataFrame:
    """The region of the greatest rate plus bonus; of equal ones the first by name."""
    return candidates.groupBy(*keys).agg(F.min_by(region, F.struct(-(F.col(hit_rate) + bonus), F.col(region))).alias(region))


def centred_contour(points: DataFrame, keys: Sequence[str], rows: Sequence[int]) -> DataFrame:
    """Points of a contour relative to its centre, as one array a frame; null if a point is missing."""
    p = points.filter(F.col("row_no").isin(*rows)).groupBy(*keys, "frame").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.array_sort(F.collect_list(F.struct("row_no", "x", "y"))).alias("p"), F.count("x").alias("n"))
    flat = F.flatten(F.transform("p", lambda q: F.array(q["x"] - F.col("cx"), q["y"] - F.col("cy"))))
    return p.select(*keys, "frame", F.when(F.col("n") == len(rows), flat).alias("contour"))


def split_at_changes(spans: DataFrame, changes: DataFrame, key: str, start: str, end: str, at: str, width: float = 1 << 12) -> DataFrame:
    """Spans cut at the change points strictly inside them; part numbers the pieces. Points meet spans by buckets of `width` (temporal.in_interval), so no key's points come together; a span's own points are what its pieces need. Copies of spans count once."""
    own = spans.distinct()
    inside = in_interval(changes.select(key, F.col(at).alias("__at")).distinct(), own, [key], "__at", start, end, width).filter((F.col("__at") > F.col(start)) & (F.col("__at") < F.col(end)))
    points = inside.groupBy(*own.columns).agg(F.array_sort(F.collect_set("__at")).alias("__c"))
    marked = join_null_safe(own, points, own.columns, "left")
    kind = dict(own.dtypes)[start]
    bounds = F.concat(F.array(F.col(start)), F.coalesce(F.col("__c"), F.array().cast(f"array<{kind}>")), F.array(F.col(end)))
    pieces = marked.withColumn("__b", bounds).drop("__c").select("*", F.posexplode(F.slice("__b", F.lit(1), F.size("__b") - 1)).alias("part", "__s"))
    return pieces.withColumn("__e", F.get("__b", F.col("part") + 1)).withColumn(start, F.col("__s")).withColumn(end, F.col("__e")).drop("__b", "__s", "__e")


def valid_slice(frames: DataFrame, frame: str, first: Column, last: Column, feature: str) -> DataFrame:
    """Frames of [first, last), clamped at 0, without those whose feature is missing."""
    return frames.filter((F.col(frame) >= F.greatest(F.lit(0), first)) & (F.col(frame) < last) & F.col(feature).isNotNull())


def _spread(points: DataFrame, keys: Sequence[str], rows: Sequence[int]) -> DataFrame:
    """One row a frame with a struct p<row> of each of the rows' points."""
    at = lambda r: F.max(F.when(F.col("row_no") == r, F.struct("x", "y"))).alias(f"p{r}")
    return points.groupBy(*keys, "frame").agg(*[at(r) for r in rows])


def apertures(points: DataFrame, keys: Sequence[str], eyes: tuple[int, int], lips: tuple[int, int]) -> DataFrame:
    """Per frame the distance of two points (gap), that of the eyes (unit), and the one in units of the other; null where a point is missing or the eyes fall together."""
    far = lambda a, b: F.hypot(F.col(f"p{a}.x") - F.col(f"p{b}.x"), F.col(f"p{a}.y") - F.col(f"p{b}.y"))
    f = _spread(points, keys, [*eyes, *lips]).select(*keys, "frame", far(*lips).alias("gap"), far(*eyes).alias("unit"))
    return f.withColumn("aperture", F.col("gap") / F.nullif(F.col("unit"), F.lit(0.0)))


def nearest_point(points: DataFrame, keys: Sequence[str], rows: tuple[int, int], target: int) -> DataFrame:
    """Per frame the least distance of rows [a, b) from one point; frames without it, or without any of them, have no row. Both are gathered in one pass."""
    hand = F.col("row_no").between(rows[0], rows[1] - 1)
    known = points.filter(F.col("x").isNotNull() & (hand | (F.col("row_no") == target)))
    f = known.groupBy(*keys, "frame").agg(F.collect_list(F.when(hand, F.struct("x", "y"))).alias("h"), F.max(F.when(F.col("row_no") == target, F.struct("x", "y"))).alias("m"))
    return f.filter("m is not null and size(h) > 0").select(*keys, "frame", F.array_min(F.transform("h", lambda p: F.hypot(p["x"] - F.col("m.x"), p["y"] - F.col("m.y")))).alias("nearest"))


def frame_maps(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a frame with `points`, a map from row to point. A frame has a fixed number of rows."""
    return points.groupBy(*keys, "frame").agg(F.map_from_entries(F.collect_list(F.struct("row_no", F.struct("x", "y", "z")))).alias("points"))
