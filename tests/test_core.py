"""Operators against brute force and on awkward input."""

from __future__ import annotations

import json
import random
import time
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F, types as T

from weftline.functions import kernels, text as X, vectors as V
from weftline.operators import coverage, evaluation, lookup, merging, sampling, sequences as S, temporal
from weftline.sources import readers, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Rows that fail to parse


LINES = [
    ("a,b,1,y,s,1,2", None), ('a,"b,c",1,y,"s ""x""",1,2\r', None), ('a,b"c,1,y,s,1,2', "quoting"), ('a,"b" ,1,y,s,1,2', "quoting"), ('"a,b,1,y,s,1,2', "quoting"), ("a,b,1,y,s,1", "columns"),
    (",,,,,,", None), ("a,b,1,Y,s,1,2", "verdict"), ("a,b,1,y,s,2,1", "timing"), ("a,b,1,y,s,,", None), ("a,b,1,y,s,1,", "timing"), ("a,b,1,y,s,-1,2", "timing"), ("a,b,1,y,s, +1. , .5e1 ", "timing"),
    ("a,b,1,y,s, +1. , 1.5 ", None), ('a,"x\ny",1,neg,s,0,1', None), ("file,word,video_start,verdict,signer,sign_start,sign_end", "header"), ("  ", "header"), ("", "header"), (None, "header"),
    ("a,b,1,y,s,-0,1", None), ("a,b,1,y,s,１,2", "timing"), ('a,"' + "x" * 300_000 + '",1,y,s,1,2', None), ('a,"' + '""' * 50_000 + '",1,y,s,1,2', None), ("a,b,1,x,s,1", "columns"), ("a,b,1,y,s,1.00000000000000001,1.00000000000000002", None),
]


def judged(spark, lines):
    from weftline.plans.sheets import DOMAINS, SHEET
    from weftline.operators.rejects import decimal_less, is_blank, parse_lines, with_reason

    df = spark.createDataFrame([(i, line, "clash") for i, (line, _) in enumerate(lines)], "i int, line string, form string")
    p = parse_lines(df, "line", SHEET)
    s, e = is_blank(F.col("sign_start")), is_blank(F.col("sign_end"))
    pair = (s != e) | (~s & ~e & ~decimal_less(F.col("sign_start"), F.col("sign_end")))
    return with_reason(p, DOMAINS, F.col("form"), [("timing", pair)])


def test_rejects_reasons(spark):
    got = {r["i"]: r["reason"] for r in judged(spark, LINES).select("i", "reason").collect()}
    for i, (line, want) in enumerate(LINES):
        assert got.get(i, "header") == want, (line or "")[:60]


def test_rejects_fields_and_empty(spark):
    r = judged(spark, [LINES[1]]).first()
    assert (r["word"], r["signer"], r["sign_end"]) == ("b,c", 's "x"', "2")
    assert judged(spark, [(None, None)]).count() == 0


def test_lookup_join_salted_equals_broadcast(spark):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(300)] + [(None, -1)], "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, v int")
    assert rows(lookup.lookup_join(big, small, ["k"])) == rows(lookup.lookup_join(big, small, ["k"], max_bytes=0))
    assert lookup.lookup_join(big, small.limit(0), ["k"], max_bytes=0).filter("v is not null").count() == 0


# Overlapping and gapped intervals


def brute_periods(spans):
    out = []
    for a, b in sorted(s for s in spans if None not in s and s[0] < s[1]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    gaps = [("gap", x[1], y[0]) for x, y in zip(out, out[1:])]
    return [("period", a, b) for a, b in out] + gaps


@pytest.mark.parametrize("width", [7, 1 << 15])
def test_periods_and_gaps(spark, width):
    rng = random.Random(3)
    spans = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.randint(-300, 300), rng.choice([None, *([rng.randint(-300, 320)] * 9)])) for _ in range(400)]
    spans += [(k, a, a + rng.randint(1, 6)) for k, a, _ in spans] + spans[:50]
    df = spark.createDataFrame(spans, "video string, s long, e long").withColumn("kind", F.lit("clash"))
    got = rows(coverage.periods_and_gaps(df, ["video"], "s", "e", width))
    want = sorted(((k, *x) for k in {s[0] for s in spans} for x in brute_periods([(a, b) for v, a, b in spans if v == k])), key=repr)
    assert got == want
    for k in {g[0] for g in got}:
        own = sorted(g[2:] for g in got if g[0] == k)
        assert all(x[1] == y[0] for x, y in zip(own, own[1:])), "periods and gaps alternate and fill the span"


def test_periods_of_doubles_and_empty(spark):
    df = spark.createDataFrame([("a", 0.5, 1.5), ("a", 1.5, 2.0), ("a", float("nan"), 9.0), ("a", 4.0, 4.0)], "k string, s double, e double")
    assert rows(coverage.periods_and_gaps(df, ["k"], "s", "e", 1.0)) == [("a", "period", 0.5, 2.0)]
    assert coverage.periods_and_gaps(df.limit(0), ["k"], "s", "e").count() == 0


# Time


def test_neighbours(spark):
    rng = random.Random(5)
    left = [(rng.choice("ab"), rng.choice([None, *[rng.uniform(0, 50)] * 8]), i) for i in range(200)]
    right = [(rng.choice("abc"), float(rng.randint(0, 50)), f"r{i}") for i in range(60)] + [("a", None, "none")]
    ldf, rdf = spark.createDataFrame(left, "k string, t double, i int"), spark.createDataFrame(right, "k string, u double, name string")
    got = {r["i"]: r for r in temporal.neighbours(ldf, rdf, ["k"], "t", "u", ["name"], 3.0).collect()}
    assert len(got) == len(left)
    for k, t, i in left:
        own = [] if t is None else [(u, n) for kk, u, n in right if kk == k and u is not None]
        before, after = [x for x in own if x[0] <= (t or 0)], [x for x in own if x[0] > (t or 0)]
        want_b = min((x for x in before if x[0] == max(before)[0]), default=None) if before else None
        want_a = min(after) if after else None
        assert (tuple(got[i]["before"]) if got[i]["before"] else None) == want_b and (tuple(got[i]["after"]) if got[i]["after"] else None) == want_a


def test_lag_and_running_sum_in_cells(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.choice("ab"), rng.choice([None, *[rng.randint(0, 500)] * 9]), i, rng.randint(-5, 5)) for i in range(300)], "k string, t int, i int, v int")
    w = W.partitionBy("k").orderBy("t", "i")
    want = df.select("i", F.lag("v").over(w).alias("p"), F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"))
    a = S.lag_in_cells(df, ["k"], ["t", "i"], ["v"], 20)
    got = S.running_sum(a, ["k"], ["t", "i"], "v", 20, "s").select("i", "prev.v", "s")
    assert rows(got) == rows(want)


def test_overlapping_equals_nested_loop(spark):
    rng = random.Random(2)
    mk = lambda n: [(rng.choice("ab"), x := rng.randint(0, 200), x + rng.randint(-2, 40), i) for i in range(n)]
    a, b = mk(60), mk(60)
    got = temporal.overlapping(spark.createDataFrame(a, "k string, a0 long, a1 long, i int"), spark.createDataFrame(b, "k string, b0 long, b1 long, j int"), ["k"], ("a0", "a1"), ("b0", "b1"), 16)
    want = sorted((x[3], y[3], min(x[2], y[2]) - max(x[1], y[1])) for x in a for y in b if x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and min(x[2], y[2]) > max(x[1], y[1]))
    assert sorted((r["i"], r["j"], r["overlap"]) for r in got.collect()) == want


def test_trim_and_runs(spark):
    present = {*range(30, 71), *range(115, 121)}
    df = spark.createDataFrame([("v", i, i in present) for i in range(130)], "k string, f int, on boolean")
    isl = S.islands(df.filter("on"), ["k"], "f", [], 20, 1 << 20)
    assert rows(isl.select("start_at", "end_at", "n")) == [(115, 120, 6), (30, 70, 41)]
    assert S.longest_run(df, ["k"], "f", "on", False).first()["longest"] == 44
    assert S.trim(df, ["k"], "f", "on", 5).agg(F.min("f"), F.max("f")).first()[:] == (25, 125)


def test_thin_keeps_the_first_and_is_idempotent(spark):
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate([0, 5, 19, 20, 39, 41, 100])], "k string, t int, i int")
    once = S.thin(df, ["k"], "t", "i", 20)
    assert sorted(r["t"] for r in once.collect()) == [0, 20, 41, 100]
    assert rows(S.thin(once, ["k"], "t", "i", 20)) == rows(once)


def test_upsert_is_idempotent_and_keeps_old(spark):
    old, new = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], "id string, region string, n string"), spark.createDataFrame([("a", "", "9"), ("c", "z", None)], "id string, region string, n string")
    once = merging.upsert(new, old, "id", ["region"])
    assert rows(once) == [("a", "x", "9"), ("b", "y", "2"), ("c", "z", None)]
    assert rows(merging.upsert(new, once, "id", ["region"])) == rows(once)


def test_seeded_sample_ignores_partitions(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    assert rows(sampling.seeded(df, ["k"], "id", 4, 1)) == rows(sampling.seeded(df.repartition(7), ["k"], "id", 4, 1))


# Statistics


def test_statistics(spark):
    x = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (2.0, 4.0), (5.0, 9.0), (None, 1.0)], "x double, y double")
    assert evaluation.spearman(x, "x", "y").first()["rho"] == pytest.approx(0.6324555, abs=1e-6)
    m = evaluation.mann_whitney(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), ("b", 0.5)], "g string, v double"), "g", "v", "a").first()
    assert (m["u"], m["n1"], m["n2"]) == (2.0, 2, 3) and m["p_less"] == pytest.approx(4 / 6)
    w = evaluation.wilcoxon(spark.createDataFrame([(1.0,), (-2.0,), (3.0,), (0.0,)], "d double"), "d").first()
    assert (w["w_plus"], w["n"]) == (4.0, 3)
    lo, hi = evaluation.wilson(F.lit(10), F.lit(26))
    got = spark.range(1).select(lo, hi).first()
    assert got[0] == pytest.approx(0.224, abs=1e-3) and got[1] == pytest.approx(0.575, abs=1e-3)


# Kernels, text, vectors


def test_dtw_kernels():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(9, 3))
    assert kernels.dtw(a, a) == 0 and kernels.dtw(a, a[:0]) == float("inf")
    hay = np.vstack([rng.normal(size=(6, 3)) + 9, a, rng.normal(size=(4, 3)) + 9])
    assert kernels.subsequence_dtw(a, hay) == (6, 14, 0.0)
    assert kernels.subsequence_dtw(a[:2], hay) is None
    assert kernels.dtw(a, a + 1, band=2) >= kernels.dtw(a, a + 1)


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.fold_key(F.lit("¡Niño, ÁÉ 3!"))) == "ninoae3"
    assert one(X.clock(F.lit(3661.5))) == "01:01:01.500" and one(X.clock(F.lit(-2.0))) == "00:00:00.000"
    assert one(X.seconds_of(F.lit("01:01:01,500"))) == 3661.5 and one(X.seconds_of(F.lit("x"))) is None
    assert one(X.strip_html(F.lit("<style>a{}</style><p>m&aacute;s</p><p>b<br>c</p>"))) == "más\n\nb\nc"
    assert one(X.split_aliases(F.lit("a (x, y), b, a (x, y)"))) == ["a (x, y)", "b"]
    assert one(X.matched_form(F.lit("Los niños."), F.array(F.lit("niño"), F.lit("niños")))) == "niños"
    assert one(X.file_time(F.lit("a_mm12s30.mp4"))) == 750.0
    assert one(X.between(F.lit("x START y END z"), "START", "END")) == "START y "


def test_vectors(spark):
    v = spark.createDataFrame([([1.0, 2.0, 4.0],)], "a array<double>")
    assert v.select(V.velocity(F.col("a"))).first()[0] == [0.0, 1.0, 2.0]
    assert v.select(V.resample(F.col("a"), 5)).first()[0] == [1.0, 1.5, 2.0, 3.0, 4.0]
    assert v.select(V.cosine(F.col("a"), F.col("a"))).first()[0] == pytest.approx(1.0)
    m = V.mirror_row(V.mirror_row(F.col("id")))
    assert spark.range(75).filter(m != F.col("id")).count() == 0


# Sources and sinks


def test_cues_round_trip(spark):
    text = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02,500\nhola\nmundo\n\n2\n00:00:03.000 --> 00:00:04.000\n\n\n00:00:05.000 --> 00:00:06.000\r\nfin\n"
    df = spark.createDataFrame([("r", text), ("empty", ""), ("null", None)], "run string, t string")
    got = rows(readers.cues(df, "run", "t"))
    assert got == [("r", 0, 1.0, 2.5, "hola mundo"), ("r", 1, 5.0, 6.0, "fin")]
    again = readers.cues(sinks.subtitles(readers.cues(df, "run", "t"), "run", "idx", "start", "end_sec", "text"), "run", "document")
    assert rows(again) == got


def test_files(spark, tmp_path):
    a = np.full((2, 3, 3), np.nan)
    a[0, 1] = 1
    np.savez_compressed(tmp_path / "x.npz", landmarks=a)
    (tmp_path / "bad.npz").write_bytes(b"no")
    t = readers.tensors(spark, str(tmp_path))
    assert t.filter("readable").count() == 6 and t.filter("x is not null").count() == 1 and t.filter("not readable").count() == 1
    assert rows(readers.inventory(spark, str(tmp_path)).select("name", "kind")) == [("bad.npz", "array"), ("x.npz", "array")]
    (tmp_path / "d.json").write_text(json.dumps({"video": "v", "words": [{"word": "b"}, {"word": "a"}]}))
    j = readers.json_documents(spark, str(tmp_path / "d.json"), "words", T.StructType.fromDDL("video string, words array<struct<word: string>>"))
    assert rows(j.select("video", "idx", "word")) == [("v", 0, "b"), ("v", 1, "a")]
    (tmp_path / "t.eaf").write_text('<A><TIME_ORDER><TIME_SLOT TIME_SLOT_ID="t1" TIME_VALUE="500"/><TIME_SLOT TIME_SLOT_ID="t2" TIME_VALUE="1500"/></TIME_ORDER><TIER TIER_ID="s"><ANNOTATION><ALIGNABLE_ANNOTATION TIME_SLOT_REF1="t1" TIME_SLOT_REF2="t2"><ANNOTATION_VALUE>x</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION></TIER></A>')
    assert rows(readers.xml_tiers(spark, str(tmp_path / "t.eaf")).select("tier", "start", "end_sec", "value")) == [("s", 0.5, 1.5, "x")]
    assert readers.sheet_kind(readers.COMPLETED) == "completed" and readers.sheet_kind(["file"]) == "unknown"
    h = spark.createDataFrame([('<script>const ROWS = [{"a": 1}, {"a": 2}];</script>',)], "t string")
    assert rows(readers.html_rows(h, "t", "ROWS", "a: int")) == [(1,), (2,)]


def test_resumable_append(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for _ in range(2):
        sinks.write_new(df, str(tmp_path / "out"), "k")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2




# Landmarks and predicates


def test_landmarks(spark):
    from weftline.operators import tensor

    rng = random.Random(1)
    pts = [("v", f, r, None if rng.random() < 0.2 else rng.random(), rng.random(), 0.0) for f in range(6) for r in range(60)]
    df = spark.createDataFrame(pts, "video string, frame int, row_no int, x double, y double, z double")
    assert rows(tensor.mirror(tensor.mirror(df)).select("frame", "row_no", F.round("x", 9))) == rows(df.select("frame", "row_no", F.round("x", 9)))
    moved = df.withColumn("x", F.col("x") * 1.3 + 0.1).withColumn("y", F.col("y") * 1.3 + 0.05)
    a, b = (tensor.body_frame(x, ["video"], True).select("frame", "row_no", F.round("x", 6), F.round("y", 6)) for x in (df, moved))
    seen = {f for _, f, r, x, *_ in pts if r in (53, 54) and x is None}
    keep = lambda x: [t for t in rows(x) if t[0] not in seen]
    assert keep(a) == keep(b) and len(keep(a)) > 0
    assert tensor.coverage(df, ["video"], (0, 42)).first()["coverage"] == 1.0
    assert tensor.dense(df.filter("frame <> 3"), ["video"], 60).filter("frame = 3 and x is null").count() == 60


def test_predicates(spark):
    from weftline.functions import predicates as P

    one = lambda c: spark.range(1).select(c).first()[0]
    status = [one(P.chunk_status(F.lit(c), F.lit(n))) for c, n in ((0, 50000), (0, 100), (1, 100), (1, 50000), (0, 2000), (0, 1999))]
    assert status == ["ok", "end_of_audio", "error", "error", "ok", "end_of_audio"]
    assert one(P.eligible(F.lit(12.0), F.lit(None).cast("double"))) is False
    assert one(P.blocked(F.lit("El agua fría"), F.array(F.lit("agua fria")))) is True
    assert one(P.container_mismatch(F.lit(100.0), F.lit(3000.0), F.lit(30.0))) is False
    days = spark.createDataFrame([("2024-05-06",)], "d string").select(F.to_date("d").alias("d"))
    assert [r["url"] for r in P.expand_templates(days, ["a/{yyyy}{mm}", "b-{dd}"], "d").collect()] == ["a/202405", "b-06"]
    vocab = merging.vocabulary(spark.createDataFrame([(w,) for w in "b a abc ab ñu z a".split()], "w string"), "w", 1)
    assert [r["w"] for r in vocab.orderBy("id").collect()] == sorted("b a abc ab ñu z".split()) and [r["id"] for r in vocab.orderBy("id").collect()] == list(range(6))


def test_single_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c"), (3, None), (4, "x"), (4, "y")], "k int, v string")
    want = rows(lookup.distinct_rows(df, ["k"]))
    assert rows(lookup.single_rows(df, ["k"])) == want == rows(lookup.single_rows(df, ["k"], max_bytes=1))
    assert lookup.single_rows(df.limit(0), ["k"]).count() == 0


def test_frames_don_t_depend_on_blocks(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.choice("ab"), i // 3, i, rng.random() if i % 5 else None) for i in range(400)], "k string, t int, i int, v double")
    w = W.partitionBy("k").orderBy("t", "i")
    want = rows(df.select("i", F.round(F.avg("v").over(w.rowsBetween(-4, 4)), 9), F.round(F.sum("v").over(w.rowsBetween(-2, 1)) / 4, 9)))
    for size in (7, 1 << 16):
        r, frame, own = S.in_row_blocks(df, ["k"], ["t", "i"], 10.0, 4, 4, size)
        got = r.withColumn("a", F.avg("v").over(frame)).withColumn("m", F.sum("v").over(frame.rowsBetween(-2, 1)) / 4).filter(own)
        assert rows(got.select("i", F.round("a", 9), F.round("m", 9))) == want
    x = S.in_frames(df, ["k"], ["t", "i"], S.rolling("v", 4) | S.moving_average("v", 4), 10.0)
    assert rows(x.select("i", F.round("roll_mean", 9), F.round("ma", 9))) == want and S.in_frames(df.limit(0), ["k"], ["t"], S.rolling("v", 4)).count() == 0


def test_ranks_and_thinning_against_brute_force(spark):
    rng = random.Random(9)
    values = [rng.choice([1.5, 2.5, rng.uniform(-1e6, 1e6)]) for _ in range(300)]
    got = {r["v"]: r["r"] for r in evaluation.average_ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v", "r").collect()}
    s = sorted(values)
    assert got == {v: (s.index(v) + 1 + s.index(v) + s.count(v)) / 2 for v in values}
    events = [(rng.choice(["a", None]), rng.randint(0, 900), i) for i in range(500)]
    kept = {(r["k"], r["t"], r["i"]) for r in S.thin(spark.createDataFrame(events, "k string, t int, i int"), ["k"], "t", "i", 20).collect()}
    want, last = set(), {}
    for k, t, i in sorted(events, key=lambda e: (e[1], e[2])):
        if k not in last or t - last[k] >= 20:
            want.add((k, t, i))
            last[k] = t
    assert kept == want


def test_known_values_beside_rows(spark):
    rng = random.Random(11)
    cells = [(rng.choice(["a", "b", None]), rng.choice([None, *[rng.randint(0, 120)] * 9]), rng.choice([None, None, None, rng.uniform(0, 9)]), i) for i in range(500)]
    cells += [("c", i, None, 1000 + i) for i in range(30)] + [("d", 50, 4.0, 2000), *[("d", i, None, 2001 + i) for i in range(0, 100, 9)]]
    df = spark.createDataFrame(cells, "k string, t int, v double, i int")
    for cell in (1 << 16, 7):
        got = {r["i"]: r for r in S.carried(S.interpolate(df, ["k"], "t", "v", "line", cell), ["k"], "t", "v", "last", cell).collect()}
        assert len(got) == len(cells)
        for k, t, v, i in cells:
            known = [] if t is None else [(u, x) for kk, u, x, _ in cells if kk == k and u is not None and x is not None]
            a, b = min((x for x in known if x[0] == max(y[0] for y in known if y[0] <= t)), default=None) if any(x[0] <= t for x in known) else None, min((x for x in known if x[0] >= t), default=None)
            line = v if v is not None else a[1] + (b[1] - a[1]) * (t - a[0]) / (b[0] - a[0]) if a and b and a[0] < b[0] else a[1] if a else b[1] if b else None
            assert got[i]["last"] == (a[1] if a else None), (cell, k, t, v, i)
            assert got[i]["line"] == (None if line is None else pytest.approx(line, rel=1e-12)), (cell, k, t, v, i)


def test_interpolation_goes_through_a_cell_once_each_way(spark, data):
    """A frame from the row to the cell's end is summed up anew for each row: the square of a cell's rows."""
    import __spark_entry__ as entry

    plan = entry.queries()["q_interp"](spark, data)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rowframe" in plan and "currentrow$(), unboundedfollowing$()" not in plan


def by_difflib(x, y):
    at = [-1] * len(x)
    for i, j, n in SequenceMatcher(a=x, b=y, autojunk=False).get_matching_blocks():
        at[i : i + n] = range(j, j + n)
    return at


@pytest.mark.parametrize("few", [kernels.FEW, -(10**6)])
def test_aligned_equals_difflib(monkeypatch, few):
    """By listed runs, and with every gap swept; chunks of few pairs."""
    monkeypatch.setattr(kernels, "FEW", few)
    monkeypatch.setattr(kernels, "PAIRS", 50)
    rng = random.Random(13)
    for _ in range(300):
        lists = []
        for _ in range(rng.randint(1, 5)):
            v, a = rng.choice([1, 2, 3, 6, 30]), rng.choice([0, 1, 7, 40, 90])
            a = [rng.randrange(v) for _ in range(a)]
            lists.append((a, rng.choice([[x for i, x in enumerate(a) if i % 7 != 3], [x for x in a if rng.random() < 0.8], a[len(a) // 2 :] + a[: len(a) // 2], [rng.randrange(v) for _ in range(30)]])))
        tokens = np.array([x for a, _ in lists for x in a] + [x for _, b in lists for x in b], np.int64)
        got = kernels.aligned(tokens, np.cumsum([len(a) for a, _ in lists]), np.cumsum([len(b) for _, b in lists]))
        assert got.tolist() == [x for a, b in lists for x in by_difflib(a, b)], lists


def test_token_align_of_lists(spark):
    lists = [(0, list("abcxabd"), list("abdabc")), (1, [], ["a"]), (2, None, ["a"]), (3, ["a"], None), (4, ["a", None, "b"], [None, "b", "a"]), (5, ["a"], []), (6, list("bcd"), list("abcd"))]
    got = spark.createDataFrame(lists * 40, "i int, a array<string>, b array<string>").repartition(1).withColumn("at", kernels.token_align_column()("a", "b")).collect()
    assert len(got) == len(lists) * 40
    for r in got:
        assert r["at"] == by_difflib(r["a"] or [], r["b"] or []), r


def test_token_align_of_long_texts_ends(spark, tmp_path):
    """Words repeated over and over, a refrain, and a long text of words of any frequency: difflib goes through all pairs of a word's places for each block."""
    import __spark_entry__ as entry

    rng = random.Random(17)
    common = [f"w{int(rng.paretovariate(0.8))}" for _ in range(30_000)]
    texts = [["no", "sí"] * 2_000, [f"w{i % 50}" for i in range(20_000)], common, common[:1_500], ["no", "sí"] * 200]
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string").repartition(1).write.parquet(str(tmp_path / "documents.parquet"))
    began = time.monotonic()
    got = {r["doc_id"]: r for r in entry.queries()["q_token_align"](spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 30
    assert [got[i]["n_words"] for i in range(5)] == [4_000, 20_000, 30_000, 1_500, 400]
    for i in (3, 4):
        assert got[i]["n_matched"] == sum(j >= 0 for j in by_difflib(texts[i], [w for n, w in enumerate(texts[i]) if n % 7 != 3]))
