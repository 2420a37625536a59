"""Queries that do their whole job, on small tables with what a cut would lose."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from weftline.functions import kernels
from weftline.plans import CORE, common
from weftline.plans.joins import FAMILIES


def made(spark, folder, name, values, schema):
    spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_html_strip_takes_whole_texts(spark, tmp_path):
    texts = ["corto", "a<b>c " * 500, "uno\r\ndos\x01tres", "", None]
    d = made(spark, tmp_path, "documents", [(i, t, None if i == 1 else f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["heading"], r["href"], r["n_bare"]) for r in CORE.queries["q_html_strip"](spark, d).collect()}
    want = {}
    for i, t in enumerate(texts):
        if t is not None:
            h = "" if i == 1 else f"s{i}"
            page = f'<html><body><h1>{h}</h1><script>x < 1</script><p>{re.sub("[<>]", "", t)}</p><a href="/d/{i}">m&aacute;s</a><br/>fin</body></html>'
            want[i] = (h, f"/d/{i}", len(re.sub("<[^>]+>", "", page)))
    assert got == want and want[1][2] > 2000


def warped(kernel, vectors):
    """The five nearest of all others to each stated query, pair by pair."""
    out = {}
    for a, _, va in vectors:
        if a % 20 == 0:
            found = [(kernel(np.reshape(va, (-1, 4)), np.reshape(vb, (-1, 4))), b) for b, _, vb in vectors if b != a]
            out[a] = sorted((x for x in found if x[0] is not None), key=lambda x: (x[0][-1], x[1]))[:5]
    return out


def test_warping_sees_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(4)
    ids = [*range(0, 120, 3), *range(9_990, 10_030), *range(20_000, 20_450)]
    vectors = [(i, i % 3, [float(x) for x in rng.normal(size=64 if i % 11 else 48)]) for i in ids]
    d = made(spark, tmp_path, "embeddings", vectors, "vec_id long, label int, embedding array<double>")
    got = {(r["a"], r["rank"]): (r["b"], r["b_label"], r["cost"]) for r in CORE.queries["q_dtw_pairs"](spark, d).collect()}
    want = warped(lambda a, b: (min(kernels.dtw(a, b, 10), kernels.dtw(-a, b, 10)),), vectors)
    assert got == {(a, k): (b, b % 3, round(c, 6)) for a, best in want.items() for k, ((c,), b) in enumerate(best, 1)}
    got = {(r["a"], r["rank"]): (r["b"], r["start"], r["end"], r["cost"]) for r in CORE.queries["q_subseq_dtw"](spark, d).collect()}
    want = warped(lambda a, b: kernels.subsequence_dtw(a[5:11], b), vectors)
    assert got == {(a, k): (b, s, e, round(c, 6)) for a, best in want.items() for k, ((s, e, c), b) in enumerate(best, 1)}


def test_warping_retrieval(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = [(i, i % 4, [float(x) for x in rng.normal(size=64) + 2 * (i % 4)]) for i in range(0, 600, 5)]
    d = made(spark, tmp_path, "embeddings", vectors, "vec_id long, label int, embedding array<double>")
    near = warped(lambda a, b: (min(kernels.dtw(a, b, 10), kernels.dtw(-a, b, 10)),), vectors)
    ranks = [next((k for k, (_, b) in enumerate(best, 1) if b % 4 == a % 4), None) for a, best in near.items()]
    got = {r["slice"]: r for r in CORE.queries["q_dtw_eval"](spark, d).collect()}
    assert set(got) == {"all", "multi-example"} and got["all"]["n"] == len(near)
    assert got["all"]["top1"] == round(sum(r == 1 for r in ranks) / len(ranks), 6) and got["all"]["top5"] == round(sum(r is not None for r in ranks) / len(ranks), 6)
    assert len(CORE.queries["q_dtw_sweep"](spark, d).collect()) == 3
    best = {r["a"]: (r["b"], r["cost"]) for r in CORE.queries["q_best_reference"](spark, d).collect()}
    v = {i: np.reshape(x, (-1, 4)) for i, _, x in vectors}
    want = {a: min((min(kernels.dtw(v[a], v[b], 10), kernels.dtw(-v[a], v[b], 10)), b) for b in v if b != a and b % 4 == a % 4) for a in v if a % 20 == 0}
    assert best == {a: (b, round(c, 6)) for a, (c, b) in want.items()}


def test_cost_alone_equals_the_full_kernel():
    rng = np.random.default_rng(6)
    for _ in range(40):
        t, h = rng.normal(size=(rng.integers(3, 9), 3)), rng.normal(size=(rng.integers(3, 30), 3))
        valid = rng.random(len(h)) > 0.2
        assert abs(kernels.subsequence_cost(t, h, valid) - kernels.subsequence_dtw(t, h, valid)[2]) < 1e-6 * max(1, kernels.subsequence_dtw(t, h, valid)[2])
    assert kernels.subsequence_cost(t[:2], h) is None


def test_matched_form_keeps_all_clips(spark, tmp_path):
    cases = [
        ("agua", "¡Agua!", "agua"), ("agua", "las aguas frías", "aguas"), ("niño", "una NINA", "niña"), ("nino", "los\u00a0niños.", "niños"), ("trabajo", "trabajadores", None), ("casa", "casas y casa", "casa"),
        ("dia", "a\u200bl d\u00adi\u0301a", "dia"), ("sol", "sólо", None), ("solo", "sólo-uno", "solo"), ("de la", "fin de  la,", "de la"), ("...", "...", None), ("x", None, None), (None, "x", None), ("x", "", None),
    ]
    d = made(spark, tmp_path, "word_times", [(str(i), "v", w, s, 0.0, 0.0, 1.0, "k") for i, (w, s, _) in enumerate(cases)], "file string, video string, word string, surface string, video_start double, word_start double, word_end double, match_kind string")
    got = {int(r["file"]): r["form"] for r in CORE.queries["q_matched_form"](spark, d).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_matched_form_against_brute_force(spark, data):
    def fold(x):
        x = "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        return re.findall(r"[^\W]+", x)

    clips = {r["file"]: r for r in common.clips(spark, data).collect()}
    got = {r["file"]: r["form"] for r in CORE.queries["q_matched_form"](spark, data).collect()}
    families = {"".join(fold(k)): fs for k, fs in FAMILIES.items()}
    want = {}
    for f, r in clips.items():
        held = fold(r["surface"])
        want[f] = next((x for x in families.get("".join(fold(r["word"])), [r["word"]]) if (k := fold(x)) and any(held[i : i + len(k)] == k for i in range(len(held)))), None)
    assert got == want and len(got) == len(clips)


def test_dense_grid_has_all_frames_and_rows(spark, tmp_path):
    vectors = [(i, label, [i + r / 100 for r in range(64)]) for i, label in ((0, 1), (1, 1), (4, 1), (2, 2), (3, 2))]
    d = made(spark, tmp_path, "embeddings", vectors, "vec_id long, label int, embedding array<double>")
    got = {(r["video"], r["frame"], r["row_no"]): r["y"] for r in CORE.queries["q_dense_grid"](spark, d).collect()}
    there = {(str(label), i): v for i, label, v in vectors}
    want = {(v, f, r): there[v, f][r * 2 + 1] if (v, f) in there else None for v, a, b in (("1", 0, 4), ("2", 2, 3)) for f in range(a, b + 1) for r in range(32)}
    assert got == want and got["1", 2, 31] is None and got["1", 1, 31] is not None


def test_self_pairs_has_all_clips(spark, tmp_path):
    cases = [(f"f{i:03}", f"v{i % 3}", "agua" if i % 4 else "sol") for i in range(80)] + [("g", "v", "una"), ("h", "v", None), ("i", "w", None)]
    values = [(f, v, w, w, 0.0, 0.0, 1.0, "k") for f, v, w in cases]
    d = made(spark, tmp_path, "word_times", values + values[:5], "file string, video string, word string, surface string, video_start double, word_start double, word_end double, match_kind string")
    got = sorted((r["file"], r["word"], r["n_links"], r["n_across"]) for r in CORE.queries["q_self_pairs"](spark, d).collect())
    links = {a: [v != y for b, y, u in cases if w == u and a != b] for a, v, w in cases if w is not None}
    assert got == sorted((a, w, len(links[a]), sum(links[a])) for a, _, w in cases if a in links)


def test_content_words_counts_all_words(spark, tmp_path):
    said = ["Avenida", "a\u2062venida", "\u00a0avenida,", "avenid\u00e3", "avenida\u0301", "p\u200bara", "el", "\u65e5\u672c", " ", None]
    d = made(spark, tmp_path, "asr", [("v", i, float(i), i + 0.5, w) for i, w in enumerate(said)], "video string, idx int, start double, end_sec double, word string")
    assert [tuple(r) for r in CORE.queries["q_content_words"](spark, d).collect()] == [("avenida", 5)]


def test_vtt_cues_keeps_whole_words(spark, tmp_path):
    said = [" ¿Qué, tal? ", "2024", "日本", "a\u0303o", "uno\n\n dos\r\ntres", "\n\nx\n", "00:00:01.000 --> 00:00:02.000", "a\u200bb", "<i>&", " ", "\t\n", "", None, "fin."]
    d = made(spark, tmp_path, "asr", [("v", i, float(i), i + 0.5, w) for i, w in enumerate(said)], "video string, idx int, start double, end_sec double, word string")
    got = [(r["idx"], r["start"], r["end_sec"], r["text"]) for r in CORE.queries["q_vtt_cues"](spark, d).orderBy("idx").collect()]
    lines = [" ".join(x.strip(" \t") for x in re.split(r"[\r\n]+", w or "") if x.strip(" \t")) for w in said]
    want = [(float(i), i + 0.5, x) for i, x in enumerate(lines) if x]
    assert got == [(k, *x) for k, x in enumerate(want)] and len(got) == 10
