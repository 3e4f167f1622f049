"""A cuckoo filter over 16-byte digests: membership with few bytes a key, and exact deletion."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500
LOAD = 0.85


def buckets_for(keys: int) -> int:
    """A power of two that holds ``keys`` below the load limit."""
    return 1 << max(3, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; what finds no place stays in an exact list."""

    def __init__(self, buckets: int, table: bytes | None = None, stash: bytes | None = None):
        self.buckets = buckets
        flat = np.frombuffer(table, np.uint16).copy() if table else np.zeros(buckets * SLOTS, np.uint16)
        self.table = flat.reshape(buckets, SLOTS)
        self.stash = [tuple(x) for x in np.frombuffer(stash, np.int64).reshape(-1, 2).tolist()] if stash else []

    def places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first bucket, second bucket) of digests given as an (n, 2) array of uint64."""
        mark = (digests[:, 0] >> np.uint64(32)) & np.uint64(0xFFFF)
        mark = np.maximum(mark, np.uint64(1))
        mask = np.uint64(self.buckets - 1)
        first = digests[:, 1] & mask
        return mark.astype(np.uint16), first.astype(np.int64), self._other(first, mark).astype(np.int64)

    def _other(self, bucket, mark):
        with np.errstate(over="ignore"):
            spread = mark * np.uint64(0x5BD1E9955BD1E995)
        return bucket ^ ((spread >> np.uint64(20)) & np.uint64(self.buckets - 1))

    def contains(self, digests: np.ndarray) -> np.ndarray:
        mark, first, second = self.places(digests)
        hit = (self.table[first] == mark[:, None]).any(1) | (self.table[second] == mark[:, None]).any(1)
        for bucket, kept in self.stash:
            hit |= (mark == kept) & ((first == bucket) | (second == bucket))
        return hit

    def insert(self, digests: np.ndarray) -> None:
        draw = np.random.default_rng(self.buckets)
        for mark, first, second in zip(*self.places(digests)):
            self._put(int(mark), int(first), int(second), draw)

    def _put(self, mark: int, first: int, second: int, draw) -> None:
        for bucket in (first, second):
            empty = np.flatnonzero(self.table[bucket] == 0)
            if len(empty):
                self.table[bucket, empty[0]] = mark
                return
        bucket = second
        for _ in range(KICKS):
            slot = int(draw.integers(SLOTS))
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = int(self._other(np.uint64(bucket), np.uint64(mark)))
            empty = np.flatnonzero(self.table[bucket] == 0)
            if len(empty):
                self.table[bucket, empty[0]] = mark
                return
        self.stash.append((bucket, mark))

    def delete(self, digests: np.ndarray) -> None:
        """Takes out one entry for every digest; only digests that were inserted may be given."""
        for mark, first, second in zip(*self.places(digests)):
            for bucket in (int(first), int(second)):
                held = np.flatnonzero(self.table[bucket] == mark)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break
                if (bucket, int(mark)) in self.stash:
                    self.stash.remove((bucket, int(mark)))
                    break

    def parts(self) -> tuple[int, bytes, bytes]:
        return self.buckets, self.table.tobytes(), np.array(self.stash, np.int64).tobytes()
