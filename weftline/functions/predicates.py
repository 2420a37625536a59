"""Filters and ordered classifications as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.text import bare, fold_key, phrase_key


def verified(video: str) -> Column:
    """A row with verdict y, a start, and a file of the video."""
    return (F.col("verdict") == "y") & (F.coalesce("sign_start", F.lit("")) != "") & F.contains(F.col("file"), F.lit(video))


def eligible(duration: Column, coverage: Column, least: float = 10.0, share: float = 0.6) -> Column:
    """Long and covered enough; an unknown coverage is not."""
    return F.coalesce((duration >= least) & (coverage >= share), F.lit(False))


def content_words(df: DataFrame, word: str, stop: DataFrame, least: int = 3) -> DataFrame:
    """Rows whose folded word has `least` letters and is no stop word. stop: a table with a column `word`, small by nature and checked by the join's statistics."""
    keyed = df.withColumn("__k", fold_key(F.col(word)))
    return keyed.filter(F.length("__k") >= least).join(stop.select(fold_key(F.col("word")).alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def blocked(context: Column, phrases: Column) -> Column:
    """Whether the folded context holds any of the phrases."""
    return F.exists(phrases, lambda p: (phrase_key(p) != "") & F.contains(phrase_key(context), phrase_key(p)))


def junk_label(label: Column) -> Column:
    return F.contains(label, F.lit("Internacional")) | (F.length(F.trim(label)) < 2) | ~label.rlike(r"\p{L}")


def single_word(label: Column) -> Column:
    return (F.length(label) > 0) & ~label.rlike(r"[( ]")


def file_kind(name: Column) -> Column:
    """The kind of a file by its suffix."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("npz", "npy"), "array").when(ext.isin("mp4", "mkv", "webm", "avi"), "video").when(ext == "json", "json").when(ext == "csv", "sheet").when(ext.isin("vtt", "srt"), "subtitles").otherwise("other")


def chunk_status(code: Column, size: Column, least: int = 2000) -> Column:
    """error if the call failed, whatever was written; end_of_audio if too little was; else ok."""
    return F.when(code != 0, "error").when(size < least, "end_of_audio").otherwise("ok")


def first_keyword(text: Column, classes: Sequence[tuple[str, str]], otherwise: str = "") -> Column:
    """The class of the first keyword of the list found in the text."""
    chain = F.when(F.lit(False), "")
    for keyword, name in classes:
        chain = chain.when(F.contains(F.lower(text), F.lit(keyword.lower())), name)
    return chain.otherwise(otherwise)


def in_slice(time: Column, length: Column) -> Column:
    return time.between(F.lit(0.0), length)


def same_word(a: Column, b: Column) -> Column:
    return bare(a) == bare(b)


def container_mismatch(duration: Column, frames: Column, fps: Column, tolerance: float = 0.01) -> Column:
    """Whether a container's duration and its frames over its rate differ by more than the tolerance."""
    other = frames / F.nullif(fps, F.lit(0.0))
    return F.abs(duration - other) > tolerance * F.greatest(duration, other)


def shift_verdict(median_shift: Column, spread: Column) -> Column:
    """What a flat shift does: NO-OP, WORKING, NOISY or UNCLEAR."""
    return F.when(F.abs(median_shift) < 0.05, "NO-OP").when((F.abs(median_shift) >= 0.5) & (spread < 1.0), "WORKING").when(spread >= 1.0, "NOISY").otherwise("UNCLEAR")


def go_verdict(low: Column, high: Column, chance: Column) -> Column:
    """GO if the interval lies above chance, NO-GO if below, else INCONCLUSIVE."""
    return F.when(low > chance, "GO").when(high < chance, "NO-GO").otherwise("INCONCLUSIVE")


def expand_templates(df: DataFrame, templates: Sequence[str], day: str) -> DataFrame:
    """A row per template with url, in which {yyyy}, {mm} and {dd} are the day's parts; `choice` is the template's place."""
    own = df.withColumn("__t", F.array(*[F.lit(t) for t in templates])).select(*df.columns, F.posexplode("__t").alias("choice", "url"))
    for mark, form in (("{yyyy}", "yyyy"), ("{mm}", "MM"), ("{dd}", "dd")):
        own = own.withColumn("url", F.replace(F.col("url"), F.lit(mark), F.date_format(day, form)))
    return own


def longest_text(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Of several texts of a key the one with the most words."""
    return df.groupBy(*keys).agg(F.max_by(text, F.struct(F.size(F.split(text, r"\s+")), text)).alias(text))


def allowed(value: Column, allow: Sequence[object] = (), deny: Sequence[object] = ()) -> Column:
    """Whether a value is in the allowed set, if there is one, and not in the denied one; null is not."""
    known = value.isin(*allow) if allow else value.isNotNull()
    return F.coalesce(known & ~value.isin(*deny) if deny else known, F.lit(False))
