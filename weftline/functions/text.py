"""Text functions as column expressions: folding, tokens, HTML, times, labels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Accented letters and their plain forms.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def strip_accents(c: Column) -> Column:
    """Composed Latin letters without accents, and without combining marks."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[̀-ͯ]", "")


def fold_key(c: Column) -> Column:
    """Lower case without accents, letters a-z and digits only; other letters are dropped."""
    return F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]", "")


def bare(c: Column) -> Column:
    """Lower case without accents and without punctuation at the ends."""
    return F.regexp_replace(F.lower(strip_accents(c)), r"^[.,;:!?¿¡\"'()]+|[.,;:!?¿¡\"'()]+$", "")


def squeeze(c: Column) -> Column:
    """Lower case, trimmed, runs of white space as one blank."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def words(c: Column) -> Column:
    """Words of letters, digits and underscores."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def phrase_key(c: Column) -> Column:
    """Tokens folded one by one, empty ones dropped, joined by blanks."""
    return F.array_join(F.filter(F.transform(F.split(c, r"\s+"), fold_key), lambda x: x != ""), " ")


# What is done to a page's text, in this order.
HTML_RULES = (
    (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), (r"(?i)</p\s*>", "\n\n"), (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", " "),
    ("&nbsp;", " "), ("&aacute;", "á"), ("&eacute;", "é"), ("&iacute;", "í"), ("&oacute;", "ó"), ("&uacute;", "ú"), ("&ntilde;", "ñ"), ("&iexcl;", "¡"), ("&iquest;", "¿"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
    (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"\A\s+|\s+\z", ""),
)


def strip_html(c: Column) -> Column:
    """The text of HTML: scripts and styles go, paragraphs end in two line breaks and <br> in one, tags become blanks, common entities are read, blanks and line breaks squeezed."""
    for pattern, plain in HTML_RULES:
        c = F.regexp_replace(c, pattern, plain)
    return c


def between(c: Column, start: str, end: str) -> Column:
    """The text from the first match of `start` to before the next of `end`; without them to its own start or end."""
    body = F.when(c.rlike(start), F.regexp_extract(c, f"(?s)((?:{start}).*)", 1)).otherwise(c)
    return F.regexp_replace(body, f"(?s)(?:{end}).*", "")


def clock(seconds: Column) -> Column:
    """HH:MM:SS.mmm; times below zero are zero."""
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(F.floor(ms / 3600000)), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def seconds_of(text: Column) -> Column:
    """Seconds of HH:MM:SS.mmm or HH:MM:SS,mmm; null for anything else."""
    p = r"^(\d{2,}):(\d{2}):(\d{2})[.,](\d{3})$"
    g = lambda i: F.regexp_extract(text, p, i).try_cast("double")
    return g(1) * 3600 + g(2) * 60 + g(3) + g(4) / 1000


def file_time(name: Column) -> Column:
    """Seconds of a time written mmNNsSS in a file name."""
    return F.regexp_extract(name, r"mm(\d+)s(\d+)", 1).try_cast("double") * 60 + F.regexp_extract(name, r"mm(\d+)s(\d+)", 2).try_cast("double")


# What a label carries beside the word, in the order it is taken away, and what stands for it.
LABEL_RULES = (
    (r"(?i)\s*\(diccionario\s+lsm\)\s*", " "),
    (r"(?i)\s*diccionario\s+\(lsm\)\s*", " "),
    (r"(?i)\s+lsm\s+diccionario\s+lsm\s*$", ""),
    (r"(?i)\s+diccionario\s+lsm\s*$", ""),
    (r"(?i)\s*\((lsm|asl)\)\s*$", ""),
    (r"(?i)\s*\((variedad\s+distinta[^)]*|regionalismo[^)]*)\)", ""),
    (r"[¿?¡!]", ""),
    (r"\(([a-zA-Z])\)", r" ($1)"),
)


@F.pandas_udf(StringType())
def _composed(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def clean_label(c: Column) -> Column:
    """A label in lower case and composed letters, without notes on its source and variety, question and exclamation marks and repeated blanks. Only texts with combining marks go through Python."""
    for pattern, plain in LABEL_RULES:
        c = F.regexp_replace(c, pattern, plain)
    c = F.coalesce(_composed(F.when(c.rlike(r"\p{M}"), c)), c)
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def split_aliases(c: Column) -> Column:
    """The parts of a label at the commas outside brackets, trimmed, first occurrences only."""
    return F.array_distinct(F.filter(F.transform(F.split(c, r",(?![^(]*\))"), lambda x: F.trim(x)), lambda x: x != ""))


def matched_form(text: Column, forms: Column) -> Column:
    """The first of `forms` that is a whole word (or words) of the text, regardless of accents, case and invisible characters. Letters of other scripts stay what they are; a form without letters or digits matches nothing."""
    key = lambda c: F.array_join(words(F.regexp_replace(F.lower(strip_accents(c)), r"\p{Cf}", "")), " ")
    hay = F.concat(F.lit(" "), key(text), F.lit(" "))
    return F.get(F.filter(forms, lambda f: (key(f) != "") & F.contains(hay, F.concat(F.lit(" "), key(f), F.lit(" ")))), F.lit(0))


def prefix_alike(a: Column, b: Column) -> Column:
    """Equal, or one begins with the other."""
    return (a == b) | F.startswith(a, b) | F.startswith(b, a)


# How open and how round the lips are for a sound, from 0 to 1: vowels, glides, closed lips, lip and teeth. Other sounds show nothing.
VISEMES = {
    "a": (1.0, 0.0), "e": (0.6, 0.0), "i": (0.2, 0.0), "o": (0.6, 1.0), "u": (0.2, 1.0),
    "j": (0.15, 0.0), "w": (0.15, 1.0),
    "p": (0.05, 0.3), "b": (0.05, 0.3), "m": (0.05, 0.3),
    "f": (0.15, 0.0),
}
#: Spellings of sounds, in order: letters that name another sound or none, then unstressed i and u before a vowel, which are glides.
SOUNDS = (("j", "x"), ("w", "u"), ("qu", "k"), ("g[u]([eiéí])", "g$1"), ("v", "b"), ("[uü]([aeioáéíó])", "w$1"), ("i([aeouáéóú])", "j$1"))


def visemes(word: Column) -> Column:
    """The visible sounds of a word as (open, round), by rules of Spanish spelling."""
    c = F.lower(word)
    for pattern, sound in SOUNDS:
        c = F.regexp_replace(c, pattern, sound)
    table = F.create_map(*[x for k, (o, r) in VISEMES.items() for x in (F.lit(k), F.struct(F.lit(o).alias("open"), F.lit(r).alias("round")))])
    return F.filter(F.transform(F.split(strip_accents(c), ""), lambda ch: table[ch]), lambda v: v.isNotNull())


def occurs_as_stem(label: Column, key: Column) -> Column:
    """The label begins with the first five letters of the key."""
    return F.startswith(label, F.substring(key, 1, 5))


# The months in Spanish.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def spoken_date(c: Column) -> Column:
    """The date of a text such as `5 de mayo de 2024`; null for anything else."""
    p = r"(\d{1,2}) de (\p{L}+) de (\d{4})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(c, p, 2)))
    return F.when(month > 0, F.concat_ws("-", F.regexp_extract(c, p, 3), month.cast("string"), F.regexp_extract(c, p, 1)).try_cast("date"))
