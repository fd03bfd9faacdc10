"""A worker's table from spans of text to ids: open addressing over 64-bit hashes, all look-ups by array operations.

A hash only finds the place: the bytes of each entry are kept, and every hit is compared with
them. A span whose hash another span holds is encoded by itself, so ids are right whatever
the hashes are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import eights, power_of_two, span_hashes

#: Spans that a worker's table holds (about 80 bytes each with their ids); a full table starts anew.
CAPACITY = 1_000_000
#: Longer spans are encoded where they stand, so that the table's bytes are bounded.
KEPT_BYTES = 128

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class SpanTable:
    def __init__(self, encode: Callable[[list[str]], list[list[int]]], capacity: int = CAPACITY):
        self.encode, self.capacity = encode, capacity
        self.slots = power_of_two(2 * capacity)
        self.shift = np.uint64(64 - (self.slots.bit_length() - 1))
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)  # 0: free
        self.entry = np.zeros(self.slots, np.int32)
        self.n = self.used = self.written = 0
        self.starts, self.lengths = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32)
        self.ids = np.zeros(1 << 12, np.int32)
        # the bytes of each entry: its number of bytes, its first 8, and its place among the bytes behind those
        self.sizes, self.heads, self.at = np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.uint64), np.zeros(1 << 10, np.int64)
        self.bytes = np.zeros(1 << 12, np.uint8)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        slot = (hashes >> self.shift).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == hashes, self.entry[slot], np.int32(-1)).astype(np.int64)
        open_ = np.flatnonzero((key != hashes) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
            key = self.keys[slot[open_]]
            hit = key == hashes[open_]
            out[open_[hit]] = self.entry[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def same(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Whether the bytes of each span are those of its entry; an entry of -1 has none."""
        sizes = ends - starts
        out = (entries >= 0) & (self.sizes[entries] == sizes) if self.n else np.zeros(len(starts), bool)
        here = eights(raw)
        out[out] = (here[starts[out]] & _MASKS[np.minimum(sizes[out], 8)]) == self.heads[entries[out]]
        open_ = np.flatnonzero(out & (sizes > 8))
        there = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes.data, strides=(1,))
        for k in range(8, KEPT_BYTES, 8):
            open_ = open_[sizes[open_] > k]
            if not len(open_):
                break
            differs = ((here[starts[open_] + k] ^ there[self.at[entries[open_]] + k - 8]) & _MASKS[np.minimum(sizes[open_] - k, 8)]) != 0
            out[open_[differs]] = False
            open_ = open_[~differs]
        return out

    def _put(self, values: list[list[int]]) -> np.ndarray:
        """Entries with these ids behind the last one. They stay only if n and used are moved on; else the next ones overwrite them."""
        lengths = np.fromiter(map(len, values), np.int64, len(values))
        flat = np.fromiter((i for v in values for i in v), np.int32, int(lengths.sum()))
        while self.n + len(values) > len(self.starts):
            size = 2 * len(self.starts)
            for name in ("starts", "lengths", "sizes", "heads", "at"):
                setattr(self, name, np.resize(getattr(self, name), size))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        entries = np.arange(self.n, self.n + len(values))
        self.starts[entries] = self.used + np.cumsum(lengths) - lengths
        self.lengths[entries] = lengths
        self.ids[self.used : self.used + len(flat)] = flat
        return entries

    def add(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, values: list[list[int]]) -> np.ndarray:
        """New entries for spans with distinct hashes that aren't there."""
        entries = self._put(values)
        sizes = ends - starts
        self.sizes[entries] = sizes
        self.heads[entries] = eights(raw)[starts] & _MASKS[np.minimum(sizes, 8)]
        behind = np.maximum(sizes - 8, 0)
        while self.written + int(behind.sum()) + 8 > len(self.bytes):
            self.bytes = np.resize(self.bytes, 2 * len(self.bytes))
        at = self.written + np.cumsum(behind) - behind
        self.at[entries] = at
        total = int(behind.sum())
        self.bytes[self.written : self.written + total] = raw[np.repeat(starts + 8 - (at - self.written), behind) + np.arange(total)]
        self.n, self.used, self.written = self.n + len(values), self.used + int(self.lengths[entries].sum()), self.written + total
        slot, open_ = (hashes >> self.shift).astype(np.int64), np.arange(len(hashes))
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            self.keys[slot[free]] = hashes[free]  # of those that want one slot the last has it
            self.entry[slot[free]] = entries[free]
            open_ = open_[self.keys[slot[open_]] != hashes[open_]]
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
        return entries

    def _look_up(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The entry of each span; those missing are encoded once, in one call."""
        text = lambda k: raw[starts[k] : ends[k]].tobytes()
        found = self.find(hashes)
        short = ends - starts <= KEPT_BYTES
        missing = np.flatnonzero((found < 0) & short)
        if len(missing):
            new, at, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            if self.n + len(new) > self.capacity:
                self.clear()
                found[:] = -1
                missing = np.flatnonzero(short)
                new, at, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at = missing[at]
            found[missing] = self.add(raw, starts[at], ends[at], new, self.encode([text(k).decode() for k in at.tolist()]))[back]
        alone = np.flatnonzero(~self.same(raw, starts, ends, found))
        if len(alone):  # too long for the table, or of a hash that another span has
            texts: dict[bytes, int] = {}
            place = [texts.setdefault(text(k), len(texts)) for k in alone.tolist()]
            found[alone] = self._put(self.encode([t.decode() for t in texts]))[place]
        return found

    def resolve(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans one after the other, or none; the number of each span's), by blocks that the table can hold."""
        hashes = span_hashes(raw, starts, ends) if hashes is None else hashes
        hashes = np.maximum(hashes, np.uint64(1))
        flat, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        step = max(1, self.capacity // 2)
        for a in range(0, len(starts), step):
            entries = self._look_up(raw, starts[a : a + step], ends[a : a + step], hashes[a : a + step])
            lengths.append(self.lengths[entries].astype(np.int64))
            if ids:
                flat.append(self.gather(entries))
        return np.concatenate(flat), np.concatenate(lengths)

    def gather(self, entries: np.ndarray) -> np.ndarray:
        """The ids of entries, one after the other."""
        lengths = self.lengths[entries].astype(np.int64)
        end = np.cumsum(lengths)
        total = int(end[-1]) if len(end) else 0
        at = np.repeat(self.starts[entries] - (end - lengths), lengths)
        return self.ids[at + np.arange(total)]


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each text's spans; first: the index of each text's first span, and one past the last."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
