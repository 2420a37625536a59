"""Text: folding, HTML, subtitle times, speakers, JSON, labels, forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from weftline.catalog import table
from weftline.functions import text as T
from weftline.plans.common import ASR, CLIPS, EV, REV, clips, events, heard, review
from weftline.plans.joins import FAMILIES
from weftline.plans.registry import CORE

add = CORE.add
_BARE = f"regexp_replace(translate({{0}}, '{T.ACCENTED}', '{T.PLAIN}'), '[̀-ͯ]', '', 'g')"
_FOLD = f"regexp_replace(lower({_BARE}), '[^a-z0-9]', '', 'g')"
_WORDS = f"' ' || array_to_string(regexp_extract_all(regexp_replace(lower({_BARE}), '\\p{{{{Cf}}}}', '', 'g'), '[\\p{{{{L}}}}\\p{{{{N}}}}_]+'), ' ') || ' '"
_FAMILY = ", ".join(f"('{k}', {list(fs)})" for k, fs in FAMILIES.items())


@add("q_fold_key", f"with {ASR} select {_FOLD.format('word')} as k, count(*) as n, count(distinct word) as n_spellings from heard where word is not null group by 1")
def q_fold_key(spark: SparkSession, d: str) -> DataFrame:
    return heard(spark, d).filter("word is not null").groupBy(T.fold_key(F.col("word")).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("word").alias("n_spellings"))


@add("q_acronyms", "with t as (select doc_id, unnest(regexp_extract_all(text, '[A-ZÁÉÍÓÚÑ]{2,}')) as a from documents) select a as acronym, count(*) as n, count(distinct doc_id) as n_docs from t where length(a) <= 6 group by 1 having count(*) >= 2")
def q_acronyms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-ZÁÉÍÓÚÑ]{2,}"), F.lit(0))).alias("acronym"))
    return t.filter(F.length("acronym") <= 6).groupBy("acronym").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs")).filter("n >= 2")


@add("q_html_strip", """with h as (select doc_id, '<html><body><h1>' || coalesce(source, '') || '</h1><script>x < 1</script><p>' || replace(replace(text, '<', ''), '>', '') || '</p><a href="/d/' || doc_id || '">m&aacute;s</a><br/>fin</body></html>' as html from documents where text is not null)
select doc_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as heading, regexp_extract(html, 'href="([^"]*)"', 1) as href, length(regexp_replace(html, '<[^>]+>', '', 'g'))::bigint as n_bare from h""")
def q_html_strip(spark: SparkSession, d: str) -> DataFrame:
    """Heading, link and text length of pages made of the documents, each with its whole text."""
    docs = table(spark, d, "documents").filter("text is not null")
    body = F.regexp_replace("text", "[<>]", "")
    html = F.concat(F.lit("<html><body><h1>"), F.coalesce("source", F.lit("")), F.lit("</h1><script>x < 1</script><p>"), body, F.lit('</p><a href="/d/'), F.col("doc_id").cast("string"), F.lit('">m&aacute;s</a><br/>fin</body></html>'))
    h = docs.select("doc_id", html.alias("html"))
    return h.select("doc_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"), F.regexp_extract("html", 'href="([^"]*)"', 1).alias("href"), F.length(F.regexp_replace("html", "<[^>]+>", "")).cast("long").alias("n_bare"))


_PAGE = "'<script>a<b</script><p>' || regexp_replace(text, '[<>&]', ' ', 'g') || '</p>m&aacute;s&iquest;<br/>fin'"
for _p, _r in T.HTML_RULES:
    _PAGE = f"regexp_replace({_PAGE}, '{_p}', '{_r}', 'g')"


@add("q_html_text", f"select doc_id, {_PAGE} as text from documents where text is not null")
def q_html_text(spark: SparkSession, d: str) -> DataFrame:
    """The whole stripped text of the same pages, with paragraphs and entities."""
    docs = table(spark, d, "documents").filter("text is not null")
    html = F.concat(F.lit("<script>a<b</script><p>"), F.regexp_replace("text", "[<>&]", " "), F.lit("</p>m&aacute;s&iquest;<br/>fin"))
    return docs.select("doc_id", T.strip_html(html).alias("text"))


@add("q_vtt_roundtrip", f"""with {ASR}, t as (select video, idx, greatest(start, 0) as s, cast(round(greatest(start, 0) * 1000) as bigint) as ms from heard where start is not null)
select video, idx, lpad((ms // 3600000)::varchar, 2, '0') || ':' || lpad((ms // 60000 % 60)::varchar, 2, '0') || ':' || lpad((ms // 1000 % 60)::varchar, 2, '0') || '.' || lpad((ms % 1000)::varchar, 3, '0') as clock, round(ms / 1000.0, 3)::double as seconds from t""")
def q_vtt_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Start times as subtitle clocks, and read back."""
    c = heard(spark, d).filter("start is not null").select("video", "idx", T.clock(F.col("start")).alias("clock"))
    return c.withColumn("seconds", F.round(T.seconds_of(F.col("clock")), 3))


@add("q_speaker_turns", f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where source = 'estenografica' and text is not null),
s as (select *, nullif(regexp_extract(line, '^([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ ]+): ', 1), '') as tag from l), c as (select *, last_value(tag ignore nulls) over (partition by doc_id order by n rows unbounded preceding) as speaker from s)
select coalesce(speaker, '(none)') as speaker, count(*) as n_lines, sum(len(regexp_extract_all(regexp_replace(line, '^[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ ]+: ', ''), '[\\p{{L}}\\p{{N}}_]+')))::bigint as n_words from c group by 1""")
def q_speaker_turns(spark: SparkSession, d: str) -> DataFrame:
    """Lines and words by speaker; a speaker holds until the next tag."""
    docs = table(spark, d, "documents").filter("source = 'estenografica' and text is not null")
    l = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    tag = F.nullif(F.regexp_extract("line", "^([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ ]+): ", 1), F.lit(""))
    c = l.withColumn("speaker", F.last(tag, True).over(W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    n = F.size(T.words(F.regexp_replace("line", "^[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ ]+: ", "")))
    return c.groupBy(F.coalesce("speaker", F.lit("(none)")).alias("speaker")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(n).alias("n_words"))


@add("q_json_props", f"with {EV} select event_type, cast(json_extract(props, '$.k') as bigint) // 10 as k10, count(*) as n from ev group by 1, 2")
def q_json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return events(spark, d).groupBy("event_type", F.floor(k / 10).alias("k10")).agg(F.count(F.lit(1)).alias("n"))


# Marks that a dictionary's labels carry are put around the words, so that every rule meets some.
_MARKED = ("", " (diccionario LSM) ", "¿?", " (LSM)", " (Variedad distinta de la costa)", "(a)", " LSM Diccionario LSM", "   ", "e\u0301")
_LABEL = "word || coalesce(mark, '')"
for _p, _r in T.LABEL_RULES:
    _LABEL = f"regexp_replace({_LABEL}, '{_p}', '{_r.replace('$', chr(92))}', 'g')"


@add("q_label_cleanup", f"with {REV}, l as (select word, mark from rev, (values {', '.join(f"('{m}')" for m in _MARKED)}) t(mark) where word is not null) select word || mark as word, lower(trim(regexp_replace(nfc_normalize({_LABEL}), '\\s+', ' ', 'g'), ' ')) as label, count(*) as n from l group by 1, 2")
def q_label_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """The clean form of every label, bare and with each kind of mark."""
    r = review(spark, d).filter("word is not null").select(F.explode(F.transform(F.array(*map(F.lit, _MARKED)), lambda m: F.concat("word", m))).alias("word"))
    used = r.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return used.select("word", T.clean_label(F.col("word")).alias("label"), "n")


@add("q_aliases")
def q_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Titles split at the commas outside brackets: the first part and the others."""
    own = table(spark, d, "documents").filter("source = 'video_title' and text is not null").select("doc_id", T.split_aliases(F.col("text")).alias("parts"))
    return own.select("doc_id", F.get("parts", F.lit(0)).alias("label"), F.array_join(F.slice("parts", 2, 1000), "|").alias("aliases"))


@add("q_matched_form", f"""with {CLIPS}, fam as (select {_FOLD.format('k')} as k, fs from (values {_FAMILY}) t(k, fs)), c as (select file, surface, unnest(coalesce(fs, [word])) as form, generate_subscripts(coalesce(fs, [word]), 1) as i from clips left join fam on k = {_FOLD.format('word')}),
m as (select file, arg_min(form, i) as form from c where {_WORDS.format('form')} <> '  ' and contains({_WORDS.format('surface')}, {_WORDS.format('form')}) group by 1)
select file, m.form from clips left join m using (file)""")
def q_matched_form(spark: SparkSession, d: str) -> DataFrame:
    """For every clip the first form of its word's family (else the word itself) that its surface holds."""
    w = F.col("word")
    families = F.create_map(*[x for k, fs in FAMILIES.items() for x in (T.fold_key(F.lit(k)), F.array(*map(F.lit, fs)))])
    return clips(spark, d).select("file", T.matched_form(F.col("surface"), F.coalesce(families[T.fold_key(w)], F.array(w))).alias("form"))


_SAID = "lower(word)"
for _p, _r in T.SOUNDS:
    _SAID = f"regexp_replace({_SAID}, '{_p}', '{_r.replace('$', chr(92))}', 'g')"
_OPEN = " ".join(f"when '{k}' then {o}" for k, (o, _) in T.VISEMES.items())
_ROUND = ", ".join(f"'{k}'" for k, (_, r) in T.VISEMES.items() if r > 0.5)


@add("q_visemes", f"with {CLIPS}, w as (select distinct word from clips), s as (select word, list_filter(string_split({_BARE.replace('{0}', _SAID)}, ''), lambda x: x in ({', '.join(f"'{k}'" for k in T.VISEMES)})) as v from w) select word, len(v)::bigint as n_shapes, len(list_filter(v, lambda x: x in ({_ROUND})))::bigint as n_round, round(list_avg(list_transform(v, lambda x: (case x {_OPEN} end)::double)), 6) as mean_open from s")
def q_visemes(spark: SparkSession, d: str) -> DataFrame:
    """How many visible sounds a word has, how many of them are round, and how open they are in the mean."""
    s = clips(spark, d).select("word").distinct().withColumn("v", T.visemes(F.col("word")))
    open_ = F.aggregate("v", F.lit(0.0), lambda t, x: t + x["open"]) / F.nullif(F.size("v"), F.lit(0))
    return s.select("word", F.size("v").cast("long").alias("n_shapes"), F.size(F.filter("v", lambda x: x["round"] > 0.5)).cast("long").alias("n_round"), F.round(open_, 6).alias("mean_open"))


@add("q_prefix_alike", f"with {CLIPS} select file, starts_with(lower(surface), lower(word)) or starts_with(lower(word), lower(surface)) as alike, starts_with(lower(surface), substr(lower(word), 1, 5)) as same_stem from clips")
def q_prefix_alike(spark: SparkSession, d: str) -> DataFrame:
    s, w = F.lower("surface"), F.lower("word")
    return clips(spark, d).select("file", T.prefix_alike(s, w).alias("alike"), T.occurs_as_stem(s, w).alias("same_stem"))
