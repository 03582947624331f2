"""A cuckoo filter over 64-bit keys, in arrays: keys are put, looked up and taken out by the batch.

A key has a fingerprint of 16 bits and two places, the second of which follows from the first
and the fingerprint alone; each place has four slots. A batch is put in rounds: in each, all pending
fingerprints take what slots are free, and where there are none one a place drives another out, which is
pending in the next. A filter that has no room after ``ROUNDS`` is full and must be made anew,
larger, from the keys, as fingerprints do not say where they would stand in a larger one.
"""

from __future__ import annotations

import numpy as np

from .common import U64, mix

SLOTS = 4
#: Rounds after which the filter counts as full.
ROUNDS = 250
#: Share of the slots that are filled when a filter is sized for its keys.
FILL = 0.8


class Full(Exception):
    """No room: the filter has lost fingerprints and must be made anew from the keys."""


class Cuckoo:
    def __init__(self, places: int, slots: np.ndarray | None = None, bits: int = 16):
        """``places`` is a power of two; ``bits`` of a fingerprint are fewer in tests only."""
        self.slots = np.zeros((places, SLOTS), np.uint16) if slots is None else slots
        self.bits = bits

    @classmethod
    def sized(cls, keys: int, bits: int = 16) -> Cuckoo:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * FILL))))), bits=bits)

    @classmethod
    def of(cls, keys: np.ndarray, least: int = 0, bits: int = 16) -> Cuckoo:
        """A filter of distinct ``keys`` with room for ``least`` of them at least; doubled until they fit."""
        new = cls.sized(max(len(keys), least), bits)
        while True:
            try:
                new.put(keys)
                return new
            except Full:
                new = cls(2 * len(new.slots), bits=bits)

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, bits: int = 16) -> Cuckoo:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy(), bits)

    def _print(self, keys: np.ndarray) -> np.ndarray:
        """Fingerprints, never 0, which marks a free slot."""
        return (U64(1) + (keys >> U64(32)) % U64((1 << self.bits) - 1)).astype(np.uint16)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) & U64(len(self.slots) - 1)).astype(np.int64)

    def _other(self, place: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return place ^ (mix(prints.astype(U64)) & U64(len(self.slots) - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in the filter; never false for one that is."""
        p, at = self._print(keys), self._home(keys)
        return ((self.slots[at] == p[:, None]) | (self.slots[self._other(at, p)] == p[:, None])).any(1)

    def _place(self, at: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Put what finds a free slot; which of them did not."""
        order = np.argsort(at, kind="stable")
        a = at[order]
        first = np.searchsorted(a, a, "left")
        rank = np.arange(len(a)) - first
        taken = self.slots[a] != 0
        fits = rank < SLOTS - taken.sum(1)
        slot = np.argsort(taken, 1, kind="stable")[np.arange(len(a)), np.minimum(rank, SLOTS - 1)]
        self.slots[a[fits], slot[fits]] = p[order][fits]
        return np.sort(order[~fits])

    def put(self, keys: np.ndarray) -> None:
        """Put ``keys``, each as often as it stands there."""
        p, at = self._print(keys), self._home(keys)
        for turn in range(ROUNDS):
            left = self._place(at, p)
            if not len(left):
                return
            p, at = p[left], at[left]
            if turn % 2:  # both places were tried: one a place drives another out
                _, who = np.unique(at, return_index=True)
                slot = (turn // 2 + at[who]) % SLOTS
                p[who], self.slots[at[who], slot] = self.slots[at[who], slot], p[who]
            at = self._other(at, p)
        raise Full

    def take(self, keys: np.ndarray) -> None:
        """Take out distinct ``keys`` that are in the filter, one fingerprint for each."""
        p, at = self._print(keys), self._home(keys)
        for _ in range(2):  # where fingerprints are equal, in pairs of places that are, any will do
            order = np.lexsort((p, at))
            a, f = at[order], p[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (f[1:] != f[:-1])]) if len(a) else np.empty(0, bool)
            rank = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0)) if len(a) else np.empty(0, np.int64)
            same = self.slots[a] == f[:, None]
            there = rank < same.sum(1)
            slot = np.argsort(~same, 1, kind="stable")[np.arange(len(a)), np.minimum(rank, SLOTS - 1)]
            self.slots[a[there], slot[there]] = 0
            left = np.sort(order[~there])
            if not len(left):
                return
            p, at = p[left], self._other(at[left], p[left])
        raise KeyError("a key is not in the filter")
