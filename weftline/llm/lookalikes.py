"""One form for text that looks the same but is stored with different characters (problem 3).

Method: the look-alike-mapped distinct values are grouped under Spark's accent-sensitive collation UNICODE, a canonical
member is chosen per class, and the dictionary of changed values is joined back.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.operators.lookup import lookup_join
from weftline.session import cut

# Letters of other scripts that look like a Latin one but that the Unicode confusables lead elsewhere.
ALSO = ("Ԛχ", "Qx")
# Writing systems without separate letters; their signs are no look-alikes of a letter.
NO_LETTERS = ("CJK", "HANGUL", "KATAKANA", "HIRAGANA", "HALFWIDTH", "IDEOGRAPHIC", "YI ", "TANGUT", "NUSHU")
# Ligatures, hyphens and a letter that look like their plain counterparts.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
HYPHENS = ("\u2010\u2011\uFE63", "---")
# Blanks that look like the plain one.
BLANKS = "\u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u202F\u205F\u3000"
#: Characters that show nothing: default-ignorable ones, directional marks, variation selectors.
INVISIBLE = "[\u00AD\u034F\u061C\u115F\u1160\u17B4\u17B5\u180B-\u180F\u200B-\u200F\u202A-\u202E\u2060-\u206F\u3164\uFE00-\uFE0F\uFEFF\uFFA0]"
MARKS = "\u0327\u0328\u0323\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u030A\u030B\u030C"


@lru_cache(maxsize=1)
def printed_forms() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that Unicode decomposes into plain ones of the same look: to one character, and to several.

    Full-width and mathematical forms, letters that are another code for a Latin one, Roman numerals and the ligatures.
    Ordinals, powers, fractions and circled signs look different and aren't among them.
    """
    one, more = {}, dict(LIGATURES)
    for c in map(chr, range(0xA0, 0x1F000)):
        kind = unicodedata.decomposition(c)
        plain = unicodedata.normalize("NFKC", c)
        if kind.startswith(("<wide>", "<font>")) and c not in BLANKS or kind and " " not in kind and plain.isascii():
            one[c] = plain
        elif "\u2160" <= c <= "\u217F":
            more[c] = plain
    return {c: x for c, x in one.items() if len(x) == 1}, more | {c: x for c, x in one.items() if len(x) > 1}


@lru_cache(maxsize=1)
def look_alike_letters() -> tuple[str, str]:
    """Letters of other scripts and the Latin letter, with its mark, that each looks like: by the skeletons of the Unicode confusables, which the ICU library in Spark holds.

    Capital letters take a capital of the same skeleton and small ones a small one. Signs of scripts without letters
    and of those written from the right are left out.
    """
    checker = SparkSession.active()._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = lambda cs: checker.getSkeleton("\n".join(cs)).split("\n")
    latin = [c for c in map(chr, range(0x41, 0x250)) if unicodedata.category(c) in ("Lu", "Ll") and unicodedata.normalize("NFD", c)[0].isascii()]
    looks: dict[str, list[str]] = {}
    for c, s in zip(latin, skeletons(latin)):
        looks.setdefault(s, []).append(c)
    named = [(c, unicodedata.name(c, "LATIN")) for c in map(chr, range(0x370, 0x1F000)) if unicodedata.category(c) in ("Lu", "Ll", "Lo", "Lt") and unicodedata.bidirectional(c) == "L"]
    others = [c for c, name in named if "LATIN" not in name and not name.startswith(NO_LETTERS) and c not in printed_forms()[0]]
    found = dict(zip(*ALSO))
    for c, s in zip(others, skeletons(others)):
        if c not in found and (like := looks.get(s)):
            found[c] = next((x for x in like if x.isupper() == c.isupper()), like[0])
    return "".join(found), "".join(found.values())


def composed_pairs() -> list[tuple[str, str]]:
    """Every Latin letter with a combining mark that Unicode composes into one, in two rounds so that two marks compose as well."""
    letters, pairs = [c for c in map(chr, range(0x41, 0x250)) if unicodedata.category(c) in ("Lu", "Ll")], []
    for a in letters:
        for m in MARKS:
            one = unicodedata.normalize("NFC", a + m)
            if len(one) == 1:
                pairs.append((a + m, one))
    return pairs


def compose(c: Column) -> Column:
    """Compose Latin letters with the combining marks that follow them."""
    # One literal, letter, mark and composed letter a line: a column for each pair takes seconds to build.
    pairs = F.split(F.lit("\n".join(a + b for a, b in composed_pairs())), "\n")
    once = lambda x: F.aggregate(pairs, x, lambda acc, p: F.replace(acc, F.left(p, F.lit(2)), F.right(p, F.lit(1))))
    return F.when(c.rlike(r"\p{M}"), once(once(c))).otherwise(c)


def mapped(c: Column) -> Column:
    """The value with look-alikes replaced; null for a word that is wholly in another script and doesn't read as a Latin one."""
    one, more = printed_forms()
    letters, latin_letters = look_alike_letters()
    plain = F.translate(F.translate(F.translate(c, "".join(one), "".join(one.values())), BLANKS, " " * len(BLANKS)), *HYPHENS)
    several = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), more.items(), plain)
    plain = F.when(plain.rlike(f"[{''.join(more)}]"), several).otherwise(plain)
    plain = F.regexp_replace(plain, f"ı({INVISIBLE}*\\p{{M}})", "i$1")
    latin = F.translate(plain, letters, latin_letters)
    other = r"[\p{L}&&[^\p{IsLatin}ªº]]"
    foreign = plain.rlike(other) & ~plain.rlike(r"\p{IsLatin}") & latin.rlike(other)
    return F.when(~foreign, latin)


def cleaned(c: Column) -> Column:
    """A mapped value without invisible characters and with composed letters."""
    return compose(F.regexp_replace(c, INVISIBLE, ""))


def changed_forms(values: DataFrame, value: str = "value") -> DataFrame:
    """The dictionary of the values that have another canonical form: value, canonical.

    Values of one class are equal under UNICODE collation once their look-alikes are mapped: invisible characters and
    the way an accent is stored don't count; case, accents, ordinals and powers do. The canonical member is the
    shortest cleaned form, and of those the first by code point.
    """
    # Written before it is mapped, or the mapping would be pushed below the distinct and done for every row.
    own = cut(values.select(F.col(value).alias("value")).filter("value is not null").distinct())
    own = own.withColumn("m", F.when(F.col("value").rlike(r"[^ -~]"), mapped(F.col("value"))).otherwise(F.col("value"))).filter("m is not null")
    own = own.select("value", F.collate("m", "UNICODE").alias("class"), cleaned(F.col("m")).alias("c"))
    classes = own.groupBy("class").agg(F.min(F.struct(F.length("c").alias("n"), F.col("c"))).alias("least"))
    return own.join(classes, "class").select("value", F.col("least.c").alias("canonical")).filter("canonical <> value")


def canonical_forms(df: DataFrame, column: str, out: str, dictionary: DataFrame | None = None) -> DataFrame:
    """Add `out`, the canonical form of `column`.

    Null stays null and an empty text empty; a text of invisible characters only becomes empty. Words wholly in another
    script stay as they are unless every letter has a Latin look-alike. Equal values get equal forms, so repeated rows
    stay repeated. Texts of printable ASCII are never changed and take no part in the join. An existing column `out`
    is replaced.
    """
    known = cut(changed_forms(df, column) if dictionary is None else dictionary).select(F.col("value").alias("__look"), F.col("canonical").alias("__canon"))
    keyed = df.withColumn("__look", F.when(F.col(column).rlike(r"[^ -~]"), F.col(column)))
    return lookup_join(keyed, known, ["__look"], written=True, max_bytes=32 << 20).withColumn(out, F.coalesce("__canon", column)).select(*[c for c in df.columns if c != out], out)
