"""A cuckoo filter over 64-bit keys: two candidate buckets of four 16-bit prints each.

The second bucket is the first one combined with a scramble of the print, so a print can
move, and be deleted, without its key.  All operations take whole arrays.
"""

from __future__ import annotations

import numpy as np

from gradeloom.llm.wordhash import mix

SLOTS = 4
LOAD = 0.8
MAX_ROUNDS = 500


class CuckooFilter:
    """Approximate multiset of keys: no false negatives, about 2**-13 false positives.

    Inserting a key that is already there stores a second print, so callers insert a key
    when its first reference appears and delete it with its last one.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        need = max(1, int(keys / (SLOTS * LOAD)) + 1)
        return cls(1 << max(3, (need - 1).bit_length()))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def dump(self) -> bytes:
        return self.table.tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def room(self, more: int) -> bool:
        return len(self) + more <= self.buckets * SLOTS * LOAD

    def _prints(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64))
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, (h & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        jump = mix(prints.astype(np.uint64)) & np.uint64(self.buckets - 1)
        return bucket ^ jump.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one = self._prints(keys)
        two = self._other(one, prints)
        p = prints[:, None]
        return (self.table[one] == p).any(axis=1) | (self.table[two] == p).any(axis=1)

    def _place(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Fill free slots; True where a print found one."""
        done = np.zeros(len(bucket), bool)
        for slot in range(SLOTS):
            left = np.flatnonzero(~done)
            free = left[self.table[bucket[left], slot] == 0]
            _, first = np.unique(bucket[free], return_index=True)
            won = free[first]
            self.table[bucket[won], slot] = prints[won]
            done[won] = True
        return done

    def insert(self, keys: np.ndarray) -> bool:
        """Store one print per key; False (and an unchanged filter) if they do not fit."""
        if not self.room(len(keys)):
            return False
        before = self.table.copy()
        prints, bucket = self._prints(keys)
        for turn in range(MAX_ROUNDS):
            if not len(prints):
                return True
            done = self._place(bucket, prints)
            prints, bucket = prints[~done], bucket[~done]
            if turn == 0 or not len(prints):
                bucket = self._other(bucket, prints)
                continue
            # the bucket is full: one waiting print swaps with a stored one, which goes on to its other bucket
            _, first = np.unique(bucket, return_index=True)
            slot = (turn + bucket[first]) % SLOTS
            out = self.table[bucket[first], slot].copy()
            self.table[bucket[first], slot] = prints[first]
            prints[first] = out
            bucket[first] = self._other(bucket[first], out)
        self.table = before
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Remove one print per key; only keys that were inserted may be passed."""
        for p, a in zip(*self._prints(keys), strict=True):
            b = int(self._other(np.array([a]), np.array([p]))[0])
            for bucket in (int(a), b):
                hit = np.flatnonzero(self.table[bucket] == p)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break
