"""Token ids of stretches of text that come again, for whole Arrow columns at once.

A text is cut where no token can span, so a stretch has the same ids wherever it stands. Stretches are found by a 64-bit
hash of their bytes (see :mod:`words`: a polynomial up to 64 bytes, a BLAKE2b digest beyond) in a table that holds the
ids of short ones, and only new ones are given to the tokenizer. Longer ones are encoded once for each batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import pieces, range_hashes

#: Stretches of more bytes are encoded anew whenever they come, so what is remembered is bounded in bytes.
SHORT = 64


class Memory:
    """Runs of ids by 64-bit keys: an open hash table in arrays."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.n, self.used = 0, 0
        self.key, self.at = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.start, self.size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)
        self.ids = np.zeros(1 << 17, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys' runs, -1 for those that aren't there."""
        mask = np.uint64(len(self.key) - 1)
        slot = (keys & mask).astype(np.int64)
        there = self.key[slot]
        out = np.where(there == keys, self.at[slot], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(mask)
            there = self.key[slot[left]]
            found = there == keys[left]
            out[left[found]] = self.at[slot[left[found]]]
            left = left[~found & (there != 0)]
        return out

    def _place(self, keys: np.ndarray, at: np.ndarray) -> None:
        slot = (keys & np.uint64(len(self.key) - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.key[slot[left]] == 0]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.key[slot[first]], self.at[slot[first]] = keys[first], at[first]
            left = left[self.key[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.key) - 1)

    def add(self, keys: np.ndarray, runs: list[bytes]) -> None:
        """keys: distinct ones that aren't there; runs: unsigned 32-bit ids."""
        ids, size = np.frombuffer(b"".join(runs), np.uint32), np.array([len(x) // 4 for x in runs], np.int32)
        n, used = self.n + len(keys), self.used + len(ids)
        while n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.start[self.n : n], self.size[self.n : n] = self.used + np.cumsum(size) - size, size
        self.ids[self.used : used] = ids
        if 2 * n > len(self.key):
            known = self.key != 0
            keys_then, at_then, size_now = self.key[known], self.at[known], 1 << int(2 * n - 1).bit_length() + (n < 1 << 17)
            self.key, self.at = np.zeros(size_now, np.uint64), np.zeros(size_now, np.int32)
            self._place(keys_then, at_then)
        self._place(keys, np.arange(self.n, n, dtype=np.int32))
        self.n, self.used = n, used


class StretchEncoder:
    """Ids of whole texts from those of their stretches. A kind of tokenizer has its own :meth:`cut` and :meth:`learn`."""

    def __init__(self, remembered: int):
        self.remembered = remembered
        self.memory = Memory()

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First bytes of the stretches, among them that of each row that isn't empty."""
        raise NotImplementedError

    def learn(self, stretches: list[bytes]) -> list[bytes]:
        """Ids of different stretches, as unsigned 32-bit numbers."""
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end."""
        out, ends, before = [], [], 0
        for _, _, data, offsets in pieces(texts):
            ids, stops = self._piece(data, offsets)
            out.append(ids)
            ends.append(before + stops)
            before += len(ids)
        return (np.concatenate(out), np.concatenate(ends)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        memory = self.memory
        if memory.n > self.remembered:
            memory.clear()
        starts = self.cut(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        keys = range_hashes(data, starts, ends)
        keys[keys == 0] = 1
        at = memory.find(keys)
        new = np.flatnonzero(at < 0)
        run, size = memory.start[at], memory.size[at].astype(np.int64)
        learnt, of_new = np.zeros(0, np.uint32), np.zeros(len(keys), bool)
        if len(new):
            first, again = np.unique(keys[new], return_index=True, return_inverse=True)[1:]
            at_first = new[first]
            found = self.learn([data[a:b].tobytes() for a, b in zip(starts[at_first].tolist(), ends[at_first].tolist(), strict=True)])
            sizes = np.array([len(x) // 4 for x in found], np.int64)
            short = np.flatnonzero(ends[at_first] - starts[at_first] <= SHORT)
            run[new], size[new], of_new[new] = (np.cumsum(sizes) - sizes)[again], sizes[again], True
            learnt = np.frombuffer(b"".join(found), np.uint32)
        to = np.cumsum(size)
        place = np.repeat(run - to + size, size) + np.arange(int(to[-1]) if len(to) else 0)
        if len(new):
            fresh = np.repeat(of_new, size)
            ids = np.empty(len(place), np.uint32)
            ids[fresh], ids[~fresh] = learnt[place[fresh]], memory.ids[place[~fresh]]
            memory.add(keys[at_first[short]], [found[k] for k in short.tolist()])
        else:
            ids = memory.ids[place]
        return ids, np.concatenate([[0], to])[np.searchsorted(starts, offsets[1:])]
