"""Fill containers of a fixed capacity with items of varying length (problem 7).

Method: a configuration linear program over the histogram of lengths, solved by multiplicative weights, whose prices
are answered by a knapsack dynamic program; then rounded: the whole parts are fixed and the program is solved anew for
what is left, until so little is left that no phase gets on. Best fit packs only those last items. The program knows only
the histogram, which has no more rows than the capacity, so it is solved on the driver whatever the number of items; the
items are assigned in the cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from weftline.session import cut

CAPACITY = 2048
#: How far a round lowers the logarithm of a weight; a column within EPSILON of the best price counts as best.
ETA, EPSILON = 0.1, 0.04
#: Rounds that only learn the prices; rounds of a phase; lengths that are priced together; a phase that fixes less than this share of what is left is the last.
WARM, ROUNDS, TOGETHER, LAST = 8, 3, 32, 0.05
#: A configuration: the lengths in a container and how often each is in it.
Config = tuple[tuple[int, int], ...]


def best_configs(lengths: np.ndarray, limits: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length the configuration of greatest total price that has it, and its price: a bounded knapsack by dynamic programming over the capacity, read back for all lengths at once.

    A row of the result says how often each length is in the configuration; a length is in it at most `limits` times, but
    for the row's own, which may be in it once more.
    """
    parts = []
    for i, limit in enumerate(limits):
        k, left = 1, int(limit)
        while left > 0:
            n = min(k, left)
            if n * int(lengths[i]) <= capacity:
                parts.append((i, n, n * int(lengths[i])))
            left, k = left - n, k * 2
    best, taken = np.zeros(capacity + 1), np.zeros((len(parts), capacity + 1), bool)
    for row, (i, n, size) in zip(taken, parts):
        got = best[: capacity + 1 - size] + prices[i] * n
        np.greater(got, best[size:], out=row[size:])
        np.maximum(got, best[size:], out=best[size:])
    configs, room = np.eye(len(lengths), dtype=np.int64), capacity - lengths
    for row, (i, n, size) in zip(taken[::-1], parts[::-1]):
        here = row[room]
        if here.any():
            configs[here, i] += n
            room = room - here * size
    return configs, prices + best[capacity - lengths]


def fractional(counts: dict[int, int], capacity: int, weights: dict[int, float], rounds: int, seed: int = 0) -> list[tuple[Config, float]]:
    """Configurations with fractional multiplicities that cover no length more often than it is counted.

    `weights` are the program's dual prices; those of lengths it doesn't have yet are in proportion to the length, and all
    are changed in place: each round the weight of a length falls by the factor exp(-ETA) times the share of what could be
    covered of it that was covered, so lengths that lag behind grow dear. Each round deals the lengths at random, but
    each kind of size alike, into parts that are priced on their own, so that the configurations found don't compete for
    the same few lengths; those within EPSILON of the best price are taken, each as far as its lengths may still be
    covered in the round.
    """
    rng = np.random.default_rng(seed)
    lengths = np.array(sorted(counts), np.int64)
    need = np.array([counts[int(x)] for x in lengths], float)
    limits, covered, found = np.minimum(need, capacity // lengths).astype(np.int64), np.zeros(len(lengths)), Counter()
    weight = np.array([weights.get(int(x), x / capacity) for x in lengths])
    n_parts = -(-len(lengths) // TOGETHER)
    for r in range(1, rounds + 1):
        allowed = np.maximum(need * r / rounds - covered, 0)
        first = allowed.copy()
        price = weight * (1 + 1e-4 * rng.random(len(lengths)))
        part = np.concatenate([rng.permutation(n_parts) for _ in range(-(-len(lengths) // n_parts))])[: len(lengths)]
        for p in range(n_parts):
            at = np.flatnonzero((part == p) & (allowed > 1e-9))
            if not len(at):
                continue
            configs, value = best_configs(lengths[at], limits[at], price[at], capacity)
            good = np.flatnonzero((configs <= limits[at]).all(1) & (value >= (1 - EPSILON) * value.max()))
            for j in good[np.argsort(-value[good], kind="stable")]:
                inside = np.flatnonzero(configs[j])
                times, mine = configs[j, inside], at[inside]
                step = float((allowed[mine] / times).min())
                if step > 1e-9:
                    allowed[mine] -= step * times
                    covered[mine] += step * times
                    found[tuple(zip(lengths[mine].tolist(), times.tolist()))] += step
        weight *= np.exp(-ETA * (1 - allowed / np.maximum(first, 1e-9)))
        weight /= weight.sum()
    weights.update(zip(lengths.tolist(), weight.tolist()))
    return found.most_common()


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The least number of containers that any packing needs, by solutions of the program's dual: the sizes themselves, and the classical step functions that count how many items above the k-th part of the capacity go together."""
    x, n = np.array(sorted(counts), np.int64), np.array([counts[k] for k in sorted(counts)], np.int64)
    best = -(-int((x * n).sum()) // capacity)
    for k in range(1, 21):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, (k + 1) * x / capacity / (k + 1), ((k + 1) * x // capacity) / k)
        best = max(best, int(np.ceil(float((value * n).sum()) - 1e-6)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Best fit, longest first, over a histogram: containers that are filled alike are treated as one, so the work depends on the number of lengths and not of items."""
    room: dict[int, Counter] = {}
    order: list[int] = []

    def put(left: int, config: Config, k: int) -> None:
        if k:
            if left not in room:
                room[left] = Counter()
                insort(order, left)
            room[left][config] += k

    def take(left: int, k: int) -> list[tuple[Config, int]]:
        got = []
        for config in sorted(room[left]):
            n = min(k, room[left][config])
            room[left][config] -= n
            if not room[left][config]:
                del room[left][config]
            got.append((config, n))
            k -= n
            if not k:
                break
        if not room[left]:
            del room[left]
            order.remove(left)
        return got

    for x in sorted(counts, reverse=True):
        rest = counts[x]
        while rest:
            i = bisect_left(order, x)
            left = order[i] if i < len(order) else capacity
            each = left // x
            k = rest // each or 1
            each = min(each, rest)
            if i < len(order):
                k = min(k, sum(room[left].values()))
                taken = take(left, k)
            else:
                taken = [((), k)]
            for config, n in taken:
                put(left - each * x, (*config, (x, each)), n)
            rest -= each * k
    out: Counter = Counter()
    for by in room.values():
        for config, n in by.items():
            out[config] += n
    return sorted(out.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Config, int]], list[tuple[Config, int]], int]:
    """The containers filled by the program, those filled by best fit with what it left over, and a lower bound on their number; a container is given by its configuration, with how many there are. Together they hold exactly the counted items.

    Each phase solves the program for the items left and rounds: multiplicities are added up from the greatest on, and a
    configuration is fixed as often as the sum passes whole numbers, so that a tenth of ten configurations becomes one of
    them; only where its items are still there. Phases end when one fixes less than LAST of the items left.
    """
    left, out, weights = Counter({x: n for x, n in counts.items() if n > 0}), [], {}
    if left:
        fractional(left, capacity, weights, WARM)
    while left:
        before, carry = left.total(), 0.5
        for config, x in fractional(left, capacity, weights, ROUNDS, len(out)):
            carry += x
            k = min([int(carry), *(left[i] // n for i, n in config)])
            carry -= int(carry)
            if k > 0:
                out.append((config, k))
                left.subtract({i: n * k for i, n in config})
        left = +left
        if before - left.total() < LAST * before:
            break
    return out, best_fit(left, capacity), lower_bound(counts, capacity) if counts else 0


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """Assign each item to a container: key, piece, begin, size, container (from 0), planned (whether the program filled the container, or best fit).

    An item larger than the capacity is split into pieces of the capacity and a rest; no other item is split. Items of
    size null or <= 0 are one piece of size 0 and go to any container (0 if there is no other). Repeated rows count
    once; of rows with one key but different sizes the largest counts; a null key is an item of its own. No items, no
    rows. Which items of one length share a container follows from a hash of their keys, so the result doesn't depend
    on the order of rows.

    Within one length items are ranked in two steps (a hashed part of the length, then within it), as a third of all
    items may have one length.
    """
    own = sizes.groupBy(F.col(key).alias("key")).agg(F.greatest(F.coalesce(F.max(F.col(size)), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    own = cut(own)
    whole = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    pieces = own.select("key", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"), "n")
    pieces = pieces.select("key", "piece", (F.col("piece").cast("long") * capacity).alias("begin"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece").cast("long") * capacity).cast("int").alias("size"))
    histogram = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}
    planned, rest, _ = plan({x: n for x, n in histogram.items() if x > 0}, capacity)
    total, n_planned = sum(k for _, k in planned + rest), sum(k for _, k in planned)
    # Per length the ranges of ranks that each configuration takes: length, first rank, first container, items a container.
    first, slots, base = Counter(), [], 0
    for config, k in planned + rest:
        for x, n in config:
            slots.append((x, first[x], base, n))
            first[x] += n * k
        base += k
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    shared = sizes.sparkSession.sparkContext.broadcast(table)

    parts = max(16, min(1 << 16, sum(histogram.values()) // 250_000))
    salted = pieces.filter("size > 0").withColumn("part", F.pmod(F.xxhash64("key", "piece"), F.lit(parts)).cast("int"))
    before = salted.groupBy("size", "part").count().withColumn("off", F.coalesce(F.sum("count").over(W.partitionBy("size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    nth = F.row_number().over(W.partitionBy("size", "part").orderBy(F.xxhash64("key", "piece"), "key", "piece")) - 1
    ranked = salted.withColumn("nth", nth).join(before, ["size", "part"]).select("key", "piece", "begin", "size", (F.col("nth") + F.col("off")).cast("long").alias("rank"))

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        span = 1 << 44
        starts = t[:, 0] * span + t[:, 1]
        for b in it:
            x, r = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64), b.column(4).to_numpy(zero_copy_only=False)
            i = np.searchsorted(starts, x * span + r, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(t[i, 2] + (r - t[i, 1]) // t[i, 3])], names=[*b.schema.names[:4], "container"])

    kind = sizes.schema[key].dataType.simpleString()
    packed = ranked.mapInArrow(assign, f"key {kind}, piece int, begin long, size int, container long")
    empty = pieces.filter("size <= 0").select("key", "piece", "begin", "size", F.pmod(F.xxhash64("key"), F.lit(max(1, total))).cast("long").alias("container"))
    return packed.unionByName(empty).select(F.col("key").alias(key), "piece", "begin", "size", "container", (F.col("container") < n_planned).alias("planned"))
