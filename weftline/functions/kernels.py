"""Sequence kernels that need a table of cells: time warping and token alignment, on Arrow batches."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

INVALID = 1e6


def dtw(a: np.ndarray, b: np.ndarray, band: int | None = None) -> float:
    """Least cost of aligning two sequences of vectors by Euclidean distance, over the sum of their lengths. Infinite for an empty sequence."""
    n, m = len(a), len(b)
    if not n or not m:
        return float("inf")
    cost = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))
    reach = max(band if band is not None else max(n, m), abs(n - m))
    last = np.full(m + 1, np.inf)
    last[0] = 0.0
    for i in range(1, n + 1):
        row = np.full(m + 1, np.inf)
        lo, hi = max(1, i - reach), min(m, i + reach)
        for j in range(lo, hi + 1):
            row[j] = cost[i - 1, j - 1] + min(last[j - 1], last[j], row[j - 1])
        last = row
    return float(last[m] / (n + m))


def subsequence_dtw(template: np.ndarray, hay: np.ndarray, valid: np.ndarray | None = None) -> tuple[int, int, float] | None:
    """start, end, cost per template frame of the part of `hay` that fits best. Steps prefer the diagonal, then up, then left; the first best end counts. Invalid frames of hay cost INVALID. None for fewer than three frames."""
    n, m = len(template), len(hay)
    if n < 3 or m < 3:
        return None
    cost = np.sqrt(((template[:, None, :] - hay[None, :, :]) ** 2).sum(-1))
    cost[~np.isfinite(cost)] = INVALID
    if valid is not None:
        cost[:, ~valid] = INVALID
    total, origin = cost[0].copy(), np.arange(m)
    for i in range(1, n):
        now, came = np.empty(m), np.empty(m, np.int64)
        now[0], came[0] = total[0] + cost[i, 0], origin[0]
        for j in range(1, m):
            best, at = total[j - 1], origin[j - 1]
            if total[j] < best:
                best, at = total[j], origin[j]
            if now[j - 1] < best:
                best, at = now[j - 1], came[j - 1]
            now[j], came[j] = best + cost[i, j], at
        total, origin = now, came
    end = int(total.argmin())
    return int(origin[end]), end, float(total[end] / n)


def _frames(x: object, width: int) -> np.ndarray:
    flat = np.asarray(x if x is not None else [], np.float64)
    return flat[: len(flat) // width * width].reshape(-1, width)


def dtw_column(width: int, band: int | None = None):
    """A column function of two flat arrays of frames of `width` numbers each."""

    def kernel(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([dtw(_frames(x, width), _frames(y, width), band) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(kernel, "double")


def subsequence_column(width: int):
    def kernel(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = [subsequence_dtw(_frames(x, width), _frames(y, width)) or (None, None, None) for x, y in zip(a, b)]
        return pd.DataFrame(got, columns=["start", "end", "cost"])

    return F.pandas_udf(kernel, "start long, end long, cost double")


def dtw_many(a: np.ndarray, bs: np.ndarray, band: int | None = None) -> np.ndarray:
    """dtw of one sequence with each of several of one length, all at once."""
    n, (k, m) = len(a), bs.shape[:2]
    if not n or not m:
        return np.full(k, np.inf)
    cost = np.sqrt(((a[:, None, None, :] - bs.transpose(1, 0, 2)[None]) ** 2).sum(-1))
    reach = max(band if band is not None else max(n, m), abs(n - m))
    last = np.full((m + 1, k), np.inf)
    last[0] = 0.0
    for i in range(1, n + 1):
        row = np.full((m + 1, k), np.inf)
        for j in range(max(1, i - reach), min(m, i + reach) + 1):
            row[j] = cost[i - 1, j - 1] + np.minimum(np.minimum(last[j - 1], last[j]), row[j - 1])
        last = row
    return last[m] / (n + m)


def subsequence_many(template: np.ndarray, hays: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """subsequence_dtw of one template in each of several sequences of one length, all at once: starts, ends, costs."""
    n, (k, m) = len(template), hays.shape[:2]
    if n < 3 or m < 3:
        return None
    cost = np.sqrt(((template[:, None, None, :] - hays.transpose(1, 0, 2)[None]) ** 2).sum(-1))
    cost[~np.isfinite(cost)] = INVALID
    total, origin = cost[0].copy(), np.repeat(np.arange(m)[:, None], k, 1)
    for i in range(1, n):
        now, came = np.empty((m, k)), np.empty((m, k), np.int64)
        now[0], came[0] = total[0] + cost[i, 0], origin[0]
        for j in range(1, m):
            up = total[j] < total[j - 1]
            best, at = np.where(up, total[j], total[j - 1]), np.where(up, origin[j], origin[j - 1])
            left = now[j - 1] < best
            now[j], came[j] = np.where(left, now[j - 1], best) + cost[i, j], np.where(left, came[j - 1], at)
        total, origin = now, came
    end, each = total.argmin(0), np.arange(k)
    return origin[end, each], end, total[end, each] / n


def _of_one_length(vs: pd.Series, width: int):
    """The places and the frames of the sequences of each length."""
    by: dict[int, list[int]] = {}
    frames = [_frames(v, width) for v in vs]
    for i, f in enumerate(frames):
        by.setdefault(len(f), []).append(i)
    for at in by.values():
        yield np.array(at), np.stack([frames[i] for i in at])


def subsequence_cost(template: np.ndarray, hay: np.ndarray, valid: np.ndarray | None = None) -> float | None:
    """The cost of subsequence_dtw alone: one row is kept, and no origins."""
    n, m = len(template), len(hay)
    if n < 3 or m < 3:
        return None
    cost = np.sqrt(((template[:, None, :] - hay[None, :, :]) ** 2).sum(-1))
    cost[~np.isfinite(cost)] = INVALID
    if valid is not None:
        cost[:, ~valid] = INVALID
    total = cost[0]
    for row in cost[1:]:
        best = np.minimum(np.concatenate([[np.inf], total[:-1]]), total) + row
        # What comes from the left adds up along the row: the least of all starts, by a running minimum.
        along = np.cumsum(row)
        total = along + np.minimum.accumulate(best - along)
    return float(total.min() / n)


def _stack(vs: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vs])


def compared():
    """A function of a block of queries (query, ql, qv) and a part of all vectors (vec_id, label, v): cosine similarity and distance of every query to every other vector of the part, by one product of matrices."""

    def block(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(refs):
            return pd.DataFrame([], columns=["query", "ql", "other", "ol", "sim", "dist"])
        q, v = _stack(queries["qv"]), _stack(refs["v"])
        dot = q @ v.T
        qn, vn = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
        sim = dot / (qn[:, None] * vn[None, :] + 1e-12)
        dist = np.sqrt(np.maximum((qn**2)[:, None] + (vn**2)[None, :] - 2 * dot, 0))
        i, j = np.nonzero(queries["query"].to_numpy()[:, None] != refs["vec_id"].to_numpy()[None, :])
        return pd.DataFrame({"query": queries["query"].to_numpy()[i], "ql": queries["ql"].to_numpy()[i], "other": refs["vec_id"].to_numpy()[j], "ol": refs["label"].to_numpy()[j], "sim": sim[i, j], "dist": dist[i, j]})

    return block


def nearest_by_cosine(k: int):
    """The k most similar vectors of a part to each query of a block; cost is 1 - similarity, rounded so that equal ones go by id."""
    every = compared()

    def block(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        s = every(queries, refs)
        s["cost"] = (1 - s["sim"].astype(float)).round(9)
        top = s.sort_values(["query", "cost", "other"]).groupby("query").head(k)
        return top.rename(columns={"ql": "label", "ol": "b_label", "query": "a", "other": "b"})[["label", "b_label", "a", "b", "cost"]]

    return block


def nearest_by_warping(width: int, k: int, band: int | None = None, mirror: bool = True, same: bool = False):
    """A function of a block of queries (query, ql, qv) and a part of all vectors (vec_id, label, v): the k nearest of each query by banded warping; the mirrored form counts if it is nearer. same: only vectors of the query's label are candidates."""

    def block(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        ids, labels, parts = refs["vec_id"].to_numpy(), refs["label"].to_numpy(), list(_of_one_length(refs["v"], width))
        out = []
        for query, ql, qv in zip(queries["query"], queries["ql"], queries["qv"]):
            a, cost = _frames(qv, width), np.empty(len(ids))
            for at, bs in parts:
                cost[at] = np.minimum(dtw_many(a, bs, band), dtw_many(-a, bs, band)) if mirror else dtw_many(a, bs, band)
            cost[ids == query] = np.nan
            if same:
                cost[labels != ql] = np.nan
            out += [(ql, labels[i], query, ids[i], cost[i]) for i in np.lexsort((ids, cost))[:k] if not np.isnan(cost[i])]
        return pd.DataFrame(out, columns=["label", "b_label", "a", "b", "cost"])

    return block


def nearest_by_part(width: int, k: int, first: int, n: int):
    """As nearest_by_warping, for where the `n` frames from `first` of a query fit best in each vector."""

    def block(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        ids, labels, parts = refs["vec_id"].to_numpy(), refs["label"].to_numpy(), list(_of_one_length(refs["v"], width))
        out = []
        for query, ql, qv in zip(queries["query"], queries["ql"], queries["qv"]):
            part, cost, start, end = _frames(qv, width)[first : first + n], np.full(len(ids), np.nan), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for at, bs in parts:
                if (got := subsequence_many(part, bs)) is not None:
                    start[at], end[at], cost[at] = got
            cost[ids == query] = np.nan
            out += [(ql, labels[i], query, ids[i], start[i], end[i], cost[i]) for i in np.lexsort((ids, cost))[:k] if not np.isnan(cost[i])]
        return pd.DataFrame(out, columns=["label", "b_label", "a", "b", "start", "end", "cost"])

    return block


#: Pairs of places looked at at once; pairs of a gap that are always gone through; tokens whose texts are aligned together.
PAIRS, FEW, TOKENS = 1 << 20, 1 << 16, 1 << 17


def _shared(ids: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which ids are on both sides; own: whether a place is on the first."""
    m = int(ids.max(initial=-1)) + 1
    return (np.bincount(ids[own], minlength=m) > 0) & (np.bincount(ids[~own], minlength=m) > 0)


def _run_ids(tokens: np.ndarray, first: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """For runs of 1, 2, 4, ... tokens: an id at each place, equal for equal runs of one list; -1 where its partner has no such run."""
    ids = pd.factorize(tokens)[0]
    levels = [np.where(_shared(ids, first)[ids], ids, -1)] if len(ids) else []
    while levels:
        ids, k = levels[-1], 1 << (len(levels) - 1)
        at = np.flatnonzero((ids[:-k] >= 0) & (ids[k:] >= 0) & (owner[:-k] == owner[k:])) if k < len(ids) else np.empty(0, np.int64)
        pairs = pd.factorize(ids[at] * (int(ids.max()) + 1) + ids[at + k])[0]
        both = _shared(pairs, first[at])[pairs] if len(at) else np.zeros(0, bool)
        if not both.any():
            break
        levels.append(np.full(len(ids), -1))
        levels[-1][at[both]] = pairs[both]
    return levels


def _placed(runs: list[tuple[int, int, int]], least: int, a0: int, b0: int, a1: int, b1: int) -> list[tuple[int, int, int]]:
    """Of runs (-length, i, j) in the gap from (a0, b0) to (a1, b1) the longest, of equally long ones the first, is placed; then the longest of what it leaves of the others, and so on down to `least`."""
    heapq.heapify(runs)
    i_at, j_at, n_at, out = [a0, a1], [b0, b1], [0, 0], []
    while runs:
        n, i, j = heapq.heappop(runs)
        n, q = -n, bisect_right(i_at, i) - 1
        while q + 1 < len(i_at) and (a := i_at[q] + n_at[q]) < i + n:
            lo, hi = max(0, a - i, j_at[q] + n_at[q] - j), min(n, i_at[q + 1] - i, j_at[q + 1] - j)
            if hi - lo == n:
                for starts, new in ((i_at, i), (j_at, j), (n_at, n)):
                    starts.insert(q + 1, new)
                out.append((i, j, n))
                break
            if hi - lo >= least:
                heapq.heappush(runs, (lo - hi, i + lo, j + lo))
            q += 1
    return out


def _swept(x: np.ndarray, y: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """As _placed with every run of the gap, but without listing them; x and y: the gap's ids of runs of k tokens, of which none is twice as long.

    Length by length from the longest: no run is longer then, so from the left each run of that length is placed at its first place in the gap.
    """
    na, nb, m = len(x) + k - 1, len(y) + k - 1, int(max(x.max(), y.max())) + 1
    i_at, j_at, n_at, out = [0, na], [0, nb], [0, 0], []
    for n in range(min(2 * k - 1, na, nb), k - 1, -1):
        u, v = (np.where((z[: len(z) - n + k] >= 0) & (z[n - k :] >= 0), z[: len(z) - n + k] * m + z[n - k :], -1) for z in (x, y))
        code = pd.factorize(np.concatenate([u, v]))[0]
        cu, cv = code[: len(u)], code[len(u) :]
        many = np.bincount(cv[v >= 0], minlength=int(code.max()) + 1)
        at = np.flatnonzero((u >= 0) & (many[cu] > 0))
        places = np.flatnonzero(v >= 0)
        places = places[np.argsort(cv[places], kind="stable")].tolist()
        end, q = np.cumsum(many), 0
        for i, s, e in zip(at.tolist(), (end - many)[cu[at]].tolist(), end[cu[at]].tolist()):
            while i_at[q + 1] <= i:
                q += 1
            if i >= i_at[q] + n_at[q] and i + n <= i_at[q + 1]:
                f = bisect_left(places, j_at[q] + n_at[q], s, e)
                if f < e and (j := places[f]) + n <= j_at[q + 1]:
                    for starts, new in ((i_at, i), (j_at, j), (n_at, n)):
                        starts.insert(q + 1, new)
                    out.append((i, j, n))
    return out


def aligned(tokens: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For each token of the first lists its partner's position in the second list of the same pair, or -1.

    tokens: numbers of all first lists, then of all second lists; ends: where each pair's lists end, counted from 0 on
    either side. The blocks are those of difflib's SequenceMatcher without junk: the longest common run, of equally long
    ones the first in the first list, then in the second; then the same to its left and to its right. Runs of 2^p tokens
    and more are placed before shorter ones are looked for, and those only in the gaps between the placed ones. Pairs of
    places in a gap are listed only where they are few (_placed); a gap of words repeated over and over is swept (_swept).
    """
    na, docs = int(a_ends[-1]) if len(a_ends) else 0, len(a_ends)
    sizes = np.concatenate([np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)])
    owner, first = np.repeat(np.arange(2 * docs), sizes), np.arange(len(tokens)) < na
    levels = _run_ids(owner % max(docs, 1) * (int(tokens.max(initial=0)) + 1) + tokens, first, owner)
    # Placed blocks in order, with one of no length where a pair begins and one at the end.
    bi, bj = np.concatenate([[0], a_ends]).astype(np.int64), np.concatenate([[0], b_ends]).astype(np.int64)
    bn = np.zeros(docs + 1, np.int64)
    for p in range(len(levels) - 1, -1, -1):
        k, ids = 1 << p, levels[p]
        a0, b0, a1, b1 = (bi + bn)[:-1], (bj + bn)[:-1], bi[1:], bj[1:]
        sides = []
        for places, starts, lo, hi in ((np.flatnonzero(ids[:na] >= 0), bi, a0, a1), (np.flatnonzero(ids[na:] >= 0), bj, b0, b1)):
            gap = np.searchsorted(starts, places, "right") - 1
            inside = (places >= lo[gap]) & (places + k <= hi[gap])
            sides.append((places[inside], gap[inside]))
        (ap, ag), (bp, bg) = sides
        m = int(ids.max()) + 1
        code = pd.factorize(np.concatenate([ag * m + ids[ap], bg * m + ids[na + bp]]))[0]
        ca, cb = code[: len(ap)], code[len(ap) :]
        many = np.bincount(cb, minlength=int(code.max(initial=-1)) + 1)
        keep = many[ca] > 0
        ap, ag, ca = ap[keep], ag[keep], ca[keep]
        pairs, size = np.bincount(ag, many[ca], len(a0)), np.bincount(ag, minlength=len(a0))
        crowded = (size > 0) & (pairs > 16 * k * size + FEW)
        placed = [(i + a0[g], j + b0[g], n) for g in np.flatnonzero(crowded) for i, j, n in _swept(ids[a0[g] : a1[g] - k + 1], ids[na + b0[g] : na + b1[g] - k + 1], k)]
        keep = ~crowded[ag]
        ap, ag, ca = ap[keep], ag[keep], ca[keep]
        bp, begin = bp[np.argsort(cb, kind="stable")], np.cumsum(many) - many
        upto = np.cumsum(many[ca])
        found, at = [], 0
        while at < len(ap):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            reps = many[ca[at:end]]
            i, g = np.repeat(ap[at:end], reps), np.repeat(ag[at:end], reps)
            j = bp[np.arange(len(i)) + np.repeat(begin[ca[at:end]] - (np.cumsum(reps) - reps), reps)]
            starts = (i == a0[g]) | (j == b0[g]) | (levels[0][i - 1] < 0) | (levels[0][i - 1] != levels[0][na + j - 1])
            found.append((i[starts], j[starts], g[starts]))
            at = end
        i, j, g = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (zip(*found) if found else ((), (), ())))
        n = np.full(len(i), k)
        for q in range(p - 1, -1, -1):  # none is twice as long
            more = np.flatnonzero((i + n + (1 << q) <= a1[g]) & (j + n + (1 << q) <= b1[g]))
            x, y = levels[q][(i + n)[more]], levels[q][na + (j + n)[more]]
            n[more[(x >= 0) & (x == y)]] += 1 << q
        same = g[1:] == g[:-1]
        clash = same & ((i[1:] < (i + n)[:-1]) | (j[1:] < (j + n)[:-1]))
        crossed = np.isin(g, g[1:][clash])
        new = np.stack([i, j, n])[:, ~crossed]
        if crossed.any():
            i, j, n, g = i[crossed], j[crossed], n[crossed], g[crossed]
            cuts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            every = list(zip((-n).tolist(), i.tolist(), j.tolist()))
            placed += [b for s, e in zip(cuts[:-1], cuts[1:]) for b in _placed(every[s:e], k, *(int(x[g[s]]) for x in (a0, b0, a1, b1)))]
        new = np.concatenate([new, np.array(placed, np.int64).reshape(-1, 3).T], axis=1)
        new = new[:, np.argsort(new[0])]
        order = np.argsort(np.concatenate([bi, new[0]]), kind="stable")
        bi, bj, bn = (np.concatenate([x, y])[order] for x, y in zip((bi, bj, bn), new))
    out = np.full(na, -1, np.int32)
    place = np.arange(int(bn.sum())) + np.repeat(bi - (np.cumsum(bn) - bn), bn)
    out[place] = place + np.repeat(bj - bi, bn) - np.concatenate([[0], b_ends])[owner[place]]
    return out


def token_align_column():
    """matched: for each token of the first list the position of its partner in the second, or -1; by longest matching blocks (aligned)."""

    def kernel(a: pa.Array, b: pa.Array) -> pa.Array:
        ends = [np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False))]).astype(np.int64) for x in (a, b)]
        tokens = pc.dictionary_encode(pa.concat_arrays([a.flatten(), b.flatten()]), null_encoding="encode").indices.to_numpy().astype(np.int64)
        a_tokens, b_tokens = tokens[: ends[0][-1]], tokens[ends[0][-1] :]
        out, at, upto = [], 0, ends[0] + ends[1]
        while at < len(a):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + TOKENS, "right")) - 1)
            (a0, a1), (b0, b1) = ((x[at], x[end]) for x in ends)
            out.append(aligned(np.concatenate([a_tokens[a0:a1], b_tokens[b0:b1]]), ends[0][at + 1 : end + 1] - a0, ends[1][at + 1 : end + 1] - b0))
            at = end
        return pa.ListArray.from_arrays(pa.array(ends[0], pa.int32()), pa.array(np.concatenate([*out, np.empty(0, np.int32)]), pa.int32()))

    return F.arrow_udf(kernel, "array<int>")
