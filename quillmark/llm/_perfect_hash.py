"""Minimal perfect hashing of distinct 64-bit keys, with the keys kept in the order of their slots so that a lookup is verified."""

from __future__ import annotations

import numpy as np

from quillmark.llm._words import mix

U64 = np.uint64


class PerfectHash:
    """Slots 0 .. n - 1 for n distinct keys, in about four bits a key besides the keys themselves.

    Level after level, each key asks for a place in a bit field twice as long as the keys left; a place that only one
    key asks for is its own, the others go on to the next level. A key's slot is the number of set bits before its place.
    """

    def __init__(self, bits: np.ndarray, lengths: np.ndarray, keys: np.ndarray | None = None):
        self.bits, self.lengths, self.keys = bits, lengths, keys
        self.start = np.cumsum(lengths) - lengths
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @staticmethod
    def build(keys: np.ndarray) -> "PerfectHash":
        """For distinct ``keys``; different keys stay different at every level, so the levels end."""
        fields, lengths, left = [], [], keys.astype(U64)
        while len(left):
            n = -(-2 * len(left) // 64) * 64
            at = _place(left, len(lengths), n)
            asked = np.bincount(at, minlength=n)
            fields.append(np.packbits(asked == 1, bitorder="little"))
            lengths.append(n)
            left = left[asked[at] > 1]
        bits = np.concatenate(fields).view("<u8") if fields else np.zeros(0, U64)
        out = PerfectHash(bits, np.array(lengths, np.int64))
        out.keys = np.empty(len(keys), keys.dtype)
        out.keys[out._slots(keys)] = keys
        return out

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; for keys that weren't there at the start some slot, or -1."""
        out, todo, left = np.full(len(keys), -1, np.int64), np.arange(len(keys)), keys.astype(U64)
        for level, (n, start) in enumerate(zip(self.lengths.tolist(), self.start.tolist())):
            at = start + _place(left, level, n)
            word, bit = at >> 6, (at & 63).astype(U64)
            field = self.bits[word]
            found = (field >> bit & U64(1)).astype(bool)
            out[todo[found]] = self.before[word[found]] + np.bitwise_count(field[found] & (U64(1) << bit[found]) - U64(1))
            todo, left = todo[~found], left[~found]
            if not len(todo):
                break
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that aren't among those hashed."""
        out = self._slots(keys)
        out[out >= 0] = np.where(self.keys[out[out >= 0]] == keys[out >= 0], out[out >= 0], -1)
        return out

    def dump(self) -> tuple[bytes, bytes, bytes]:
        return self.bits.tobytes(), self.lengths.tobytes(), self.keys.tobytes()

    @staticmethod
    def load(bits: bytes, lengths: bytes, keys: bytes) -> "PerfectHash":
        return PerfectHash(np.frombuffer(bits, U64), np.frombuffer(lengths, np.int64), np.frombuffer(keys, np.int64))


class ManyHashes:
    """Several perfect hashes side by side, asked at once: slots count on from one hash to the next."""

    def __init__(self, dumps: list[tuple[bytes, bytes, bytes]]):
        each = [PerfectHash.load(*d) for d in dumps]
        self.levels = max([len(h.lengths) for h in each], default=0)
        size = np.array([len(h.bits) for h in each], np.int64)
        first = 64 * (np.cumsum(size) - size)
        self.length = np.zeros((self.levels, len(each)), np.int64)
        self.start = np.zeros((self.levels, len(each)), np.int64)
        for k, h in enumerate(each):
            self.length[: len(h.lengths), k], self.start[: len(h.lengths), k] = h.lengths, h.start + first[k]
        self.bits = np.concatenate([h.bits for h in each]) if each else np.zeros(0, U64)
        self.keys = np.concatenate([h.keys for h in each]) if each else np.zeros(0, np.int64)
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def slots(self, keys: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The slot of each key in the hash ``which``; -1 for keys that it doesn't have."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level in range(self.levels):
            n = self.length[level, which[todo]]
            todo, n = todo[n > 0], n[n > 0]
            if not len(todo):
                break
            at = self.start[level, which[todo]] + _place(keys[todo].astype(U64), level, n.astype(U64))
            word, bit = at >> 6, (at & 63).astype(U64)
            field = self.bits[word]
            found = (field >> bit & U64(1)).astype(bool)
            out[todo[found]] = self.before[word[found]] + np.bitwise_count(field[found] & (U64(1) << bit[found]) - U64(1))
            todo = todo[~found]
        some = np.flatnonzero(out >= 0)
        out[some[self.keys[out[some]] != keys[some]]] = -1
        return out


def _place(keys: np.ndarray, level: int, n) -> np.ndarray:
    return (mix(keys ^ U64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.asarray(n, U64)).astype(np.int64)
