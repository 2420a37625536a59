"""Texts that were cut off by the length limit of their source's field or in transfer (problem 8).

Method: per source, the histograms of lengths in characters and in bytes are tested for a spike at their maximum; values
at a spike without terminal punctuation were cut by the field. Values that broke off in transfer have any length; they
are told by their ends: statistics of all words of the corpus say whether the last word is only the beginning of a word,
or one that never ends a sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.operators.lookup import lookup_join
from weftline.session import cut

#: A spike has this many values, this many times the mean of the WIDTH lengths below, and few longer values beside it.
LEAST, STEEP, WIDTH, ABOVE = 3, 6.0, 32, 0.2
#: A byte limit cuts before a character that doesn't fit: up to 3 bytes short, or 2 longer if the rest of it became U+FFFD.
SHORT, LONG = 3, 2
#: A last word is a beginning if a longer word is seen so many times as often; a word seen SEEN times of which less than RARE end a sentence ends none.
BEGINS, BEGUN, SEEN, RARE = 100, 3, 50, 0.002
#: All beginnings of words up to this length are counted; of longer words, those as long as a last word that begins alike.
LONGEST = 48
#: An end is told by this many characters, unless they are one word or one run of closing signs and blanks; then by the whole text.
TAIL = 160
CLOSERS = r"[\"'»”’)\]]*+"
TERMINAL = rf"[.!?…。！？]{CLOSERS}\s*+\z"
#: At a spike a blank behind the punctuation shows that the text went on.
LAST_TERMINAL = rf"[.!?…。！？]{CLOSERS}\z"
ELLIPSIS = r"(…|\.\.\.)\s*+\z"
BROKEN = r"[,;:(«¿¡“\[/–—-]\s*+\z|�\s*+\z"
LAST_WORD = r"(?<!\p{L})(\p{L}++)\s*+\z"
UNDECIDED = rf"(?s)\A.{{0,3}}\p{{L}}*+{CLOSERS}\s*+\z"


def length_spikes(df: DataFrame, source: str, text: str) -> DataFrame:
    """source, unit ('chars' or 'bytes'), limit, n: where the lengths of a source's texts heap up at their maximum. Empty and null texts don't count, and copies of a text count once."""
    own = df.filter(F.char_length(text) > 0).select(F.col(source).alias("source"), F.char_length(text).alias("chars"), F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("text"))
    return _spikes(own)


def _spikes(lengths: DataFrame) -> DataFrame:
    """length_spikes of source, chars, bytes and text, a hash."""
    each = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    counts = lengths.select("source", "chars", "bytes", "text").distinct().select("source", each.alias("l")).groupBy("source", "l.unit", "l.length").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("source", "unit").orderBy("length")
    near = counts.withColumn("below", F.coalesce(F.sum("n").over(w.rangeBetween(-WIDTH, -1)), F.lit(0)) / WIDTH).withColumn("longer", F.coalesce(F.sum("n").over(w.rowsBetween(1, W.unboundedFollowing)), F.lit(0)))
    spikes = near.filter((F.col("n") >= LEAST) & (F.col("n") >= STEEP * F.col("below")) & (F.col("longer") <= ABOVE * F.col("n")))
    return spikes.groupBy("source", "unit").agg(F.max(F.struct("n", "length")).alias("s")).select("source", "unit", F.col("s.length").alias("limit"), F.col("s.n").alias("n"))


def word_ends(df: DataFrame, text: str) -> DataFrame:
    """word, n, n_terminal of all words that aren't the last of their text: how often each is seen, and how often right before the end of a sentence."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+[^\p{L}]{0,4}+"), F.lit(0))
    seen = df.select(tokens.alias("a")).select(F.explode(F.slice("a", F.lit(1), F.greatest(F.size("a") - 1, F.lit(0)))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    ends = F.col("t").rlike(rf"\A\p{{L}}+{CLOSERS}[.!?…。！？]")
    return seen.groupBy(F.regexp_extract("t", r"\A\p{L}+", 0).alias("word")).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(ends, F.col("n"))), F.lit(0)).alias("n_terminal"))


def last_words(words: DataFrame, ends: DataFrame) -> DataFrame:
    """word, why of the given last words that show a cut: 'word' for a word broken off, 'sentence' for one that ends no sentence."""
    known = ends.filter(F.col("n") >= BEGUN).withColumn("size", F.char_length("word"))
    starts = known.filter("size > 1").select(F.explode(F.sequence(F.lit(1), F.least(F.col("size") - 1, F.lit(LONGEST)))).alias("k"), "word", "n")
    beyond = words.filter(F.char_length("word") > LONGEST).select(F.left("word", F.lit(LONGEST)).alias("head"), F.char_length("word").alias("k")).distinct()
    far = known.filter(F.col("size") > LONGEST + 1).withColumn("head", F.left("word", F.lit(LONGEST))).join(beyond, "head").filter("k < size").select("k", "word", "n")
    longer = starts.unionByName(far).select(F.expr("left(word, k)").alias("word"), "n").groupBy("word").agg(F.max("n").alias("n_longer"))
    known = words.distinct().join(longer, "word", "left").join(ends, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    why = F.when(F.col("n_longer") >= F.greatest(F.lit(BEGUN), F.col("n") * BEGINS), "word").when((F.col("n") >= SEEN) & (F.col("n_terminal") < RARE * F.col("n")), "sentence")
    return known.select("word", why.alias("why")).filter("why is not null")


def _open_json(c: Column) -> Column:
    """A text that begins as a JSON object or array and doesn't end as one."""
    return c.rlike(r"\A\s*[\[{]\s*[\[{\"]") & ~c.rlike(r"[\]}]\s*\z")


def cut_texts(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """key, source, why of the texts that were cut: 'field' by the limit of the source's field, else 'word', 'sentence', 'bytes' or 'document' in transfer.

    Only texts without terminal punctuation can be cut; where most values at a spike end in an ellipsis, the field puts
    it there, and values at the spike are cut if they have it. Null, empty and blank texts aren't cut; a null source is a
    source of its own; repeated rows come out once. Texts that end openly on a whole word that can end a sentence aren't
    cut, nor are those that end in digits, links or signs.
    """
    own = df.select(F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("\u0000")).alias("source"), F.col(text).alias("text")).filter("text is not null and trim(text) <> ''")
    tail = F.right("text", F.lit(TAIL))
    end = F.when(tail.rlike(UNDECIDED), F.col("text")).otherwise(tail)
    ended = cut(own.select(
        "key", "source", F.char_length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("text"), end.rlike(TERMINAL).alias("terminal"), end.rlike(LAST_TERMINAL).alias("closed"), end.rlike(ELLIPSIS).alias("ellipsis"),
        end.rlike(BROKEN).alias("broken"), end.rlike("�\\s*\\z").alias("bytes_broken"), F.lower(F.regexp_extract(end, LAST_WORD, 1)).alias("word"), _open_json(F.col("text")).alias("json"),
    ).distinct())
    spikes = _spikes(ended)
    limits = spikes.groupBy("source").agg(F.max(F.when(F.col("unit") == "chars", F.col("limit"))).alias("max_chars"), F.max(F.when(F.col("unit") == "bytes", F.col("limit"))).alias("max_bytes"))
    # A limit in characters heaps up bytes as well where texts are ASCII; then the characters' limit explains both.
    limits = limits.withColumn("max_bytes", F.when(F.col("max_chars").isNull() | (F.col("max_chars") != F.col("max_bytes")), F.col("max_bytes")))
    limited = lookup_join(ended, limits, ["source"])
    at = F.coalesce(F.col("chars") == F.col("max_chars"), F.lit(False)) | F.coalesce(F.col("bytes").between(F.col("max_bytes") - SHORT, F.col("max_bytes") + LONG), F.lit(False))
    limited = limited.withColumn("at", at)
    marks = limited.filter("at").groupBy("source").agg((F.avg(F.col("ellipsis").cast("int")) >= 0.5).alias("marks"))
    suspects = lookup_join(limited.filter("at or not terminal or json or bytes_broken"), marks, ["source"])
    field = F.col("at") & F.when(F.coalesce("marks", F.lit(False)), F.col("ellipsis")).otherwise(~F.col("closed"))
    suspects = cut(suspects.withColumn("field", field))
    open_ends = suspects.filter("not field and not terminal and word <> ''")
    shown = last_words(open_ends.select("word"), word_ends(own, "text"))
    told = lookup_join(suspects, shown, ["word"])
    why = (
        F.when(F.col("field"), "field").when(F.col("bytes_broken"), "bytes").when(F.col("json"), "document")
        .when(F.col("terminal") | F.coalesce(F.col("marks") & F.col("at"), F.lit(False)), None).when(F.col("broken"), "sentence").otherwise(F.col("why"))
    )
    return told.withColumn("why", why).filter("why is not null").select(F.col("key").alias(key), F.when(F.col("source") != "\u0000", F.col("source")).alias(source), "why").distinct()
