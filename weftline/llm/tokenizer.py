"""Encoding of texts with a public byte-level BPE vocabulary (problem 6).

Method: two tiers. A minimal perfect hash resolves whole pre-tokens that are in the vocabulary; for the others, a heap
of candidate merges over linked bytes applies the merges in order of rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from weftline.llm.perfect_hash import PerfectHash

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode's White_Space property, which the pattern's \s means; U+001C-001F don't belong to it.
SPACE = r"\p{White_Space}"
#: Pre-tokens a worker keeps encoded; then it starts anew. Longer ones aren't kept.
KEPT, KEPT_BYTES = 1 << 18, 64


class Encoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.known = PerfectHash(ranks)
        self.split = regex.compile(PATTERN.replace(r"[^\s", rf"[^{SPACE}").replace(r"\s", SPACE).replace(r"\S", r"\P{White_Space}"))
        self.seen: dict[str, list[int]] = {}

    def __getstate__(self) -> dict:
        return {"known": self.known, "split": self.split, "seen": {}}

    def merged(self, raw: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of the least rank, the leftmost first, is merged until none is left. O(n log n)."""
        get, n = self.known.get, len(raw)
        part: list[bytes] = [raw[i : i + 1] for i in range(n)]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) >= 0]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            alive[j] = 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(part[i] + part[k])) >= 0:
                    heappush(heap, (r, i, size + len(part[k])))
            h = before[i]
            if h >= 0 and (r := get(part[h] + part[i])) >= 0:
                heappush(heap, (r, h, len(part[h]) + size))
        return [get(part[i]) for i in range(n) if alive[i]]

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text without special tokens; [] for null and for an empty text. A special token's string is ordinary text."""
        out: list[int] = []
        if not text:
            return out
        seen = self.seen
        for piece in self.split.findall(text):
            ids = seen.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace")
                one = self.known.get(raw)
                ids = [one] if one >= 0 else self.merged(raw)
                if len(raw) <= KEPT_BYTES:
                    if len(seen) >= KEPT:
                        seen.clear()
                    seen[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of a rank file: lines of a base64 token and its rank."""
    with open(f"{folder}/{vocabulary}", "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _lists(ids: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(df: DataFrame, text: str, out: str = "ids", keep: Sequence[str] | None = None, counts: bool = False, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add `out`, the ids of `text` as a list of integers; or their number, with counts=True. `text` isn't kept unless it is in `keep`.

    Null and empty texts give an empty list (0). Rows stay as they are, copies included. The vocabulary's hash is built
    once on the driver (50,256 keys, some 4 MB) and broadcast; texts never shuffle.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    shared = df.sparkSession.sparkContext.broadcast(encoder(folder, vocabulary))
    kind = T.LongType() if counts else T.ArrayType(T.IntegerType())
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, kind)])
    own = df.select(*keep, F.col(text).cast("string").alias("__text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value
        for b in it:
            ids = [enc.encode(t) for t in b.column(b.num_columns - 1).to_pylist()]
            last = pa.array([len(x) for x in ids], pa.int64()) if counts else _lists(ids)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], last], names=[*keep, out])

    return own.mapInArrow(batches, schema)
