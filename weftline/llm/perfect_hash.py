"""A minimal perfect hash over a fixed set of byte strings: every key has its own slot among as many slots as keys."""

from __future__ import annotations

from collections import defaultdict

import xxhash

PER_BUCKET = 2
_LOW = (1 << 32) - 1


def _parts(key: bytes) -> tuple[int, int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h & _LOW, (h >> 32) & _LOW, (h >> 64) & _LOW


class PerfectHash:
    """Hash and displace: keys fall into buckets; each bucket stores the pair (p, q) that sends its keys, at (a + p * b + q) mod n, to free slots. Largest buckets first; a bucket of one key takes the next free slot."""

    def __init__(self, ids: dict[bytes, int]) -> None:
        n = len(ids)
        self.n, self.m = n, max(1, n // PER_BUCKET)
        self.keys: list[bytes] = [b""] * n
        self.ids: list[int] = [-1] * n
        self.shift: list[tuple[int, int]] = [(0, 0)] * self.m
        buckets = defaultdict(list)
        for k in ids:
            c, a, b = _parts(k)
            buckets[c % self.m].append((a, b, k))
        taken, free = bytearray(n), 0
        for at, members in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                while taken[free]:
                    free += 1
                slots, pq = [free], (0, (free - members[0][0]) % n)
            else:
                slots, pq = self._place(members, taken, at * 2654435761 % n)
            self.shift[at] = pq
            for s, (_, _, k) in zip(slots, members):
                taken[s], self.keys[s], self.ids[s] = 1, k, ids[k]

    def _place(self, members: list[tuple[int, int, bytes]], taken: bytearray, start: int) -> tuple[list[int], tuple[int, int]]:
        n = self.n
        for t in range(n * n):
            p, q = t // n, (start + t) % n
            slots = [(a + p * b + q) % n for a, b, _ in members]
            if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                return slots, (p, q)
        raise ValueError("no displacement found: two keys hash alike")

    def get(self, key: bytes) -> int:
        """The key's id, or -1 for a string that is no key."""
        c, a, b = _parts(key)
        p, q = self.shift[c % self.m]
        s = (a + p * b + q) % self.n
        return self.ids[s] if self.keys[s] == key else -1
