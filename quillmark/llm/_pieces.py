"""Distinct pieces of a slice of texts, and small caches of what is known of a piece.

Texts repeat their words, so what is dear (a tokenizer's answer) is asked once for each distinct piece of a slice and kept
while there is room. Equal hashes are compared by their bytes, so two pieces are one only if they are equal.
"""

from __future__ import annotations

import gc
from contextlib import contextmanager
from typing import Callable

import numpy as np

from quillmark.llm._words import LOWER, SPACED, Words, ragged, same_bytes


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_LETTERS = byte_letters()


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(one occurrence of each distinct piece, the piece of every occurrence), both as indices."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, piece = np.unique(words.hashes(), return_index=True, return_inverse=True)
    like, size = first[piece], words.ends - words.starts
    if np.array_equal(size[like], size) and same_bytes(words.data, words.starts, words.starts[like], size).all():
        return first, piece
    known: dict[bytes, int] = {}  # two pieces share a hash
    piece = np.array([known.setdefault(words.data[a:b].tobytes(), len(known)) for a, b in zip(words.starts, words.ends)])
    return np.unique(piece, return_index=True)[1], piece


@contextmanager
def resting():
    """The garbage collector rests: what is kept has no cycles, and looking through it again and again takes a third of the time."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        gc.freeze()
        if on:
            gc.enable()


def cut_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    held = data.tobytes()
    return [held[a:z] for a, z in zip(starts.tolist(), ends.tolist())]


class Kept:
    """Answers by piece in two generations of at most ``limit`` pieces each; pieces of more than ``longest`` bytes aren't kept."""

    def __init__(self, answer: Callable[[list[bytes]], list], limit: int = 100_000, longest: int = 48):
        self.answer, self.limit, self.longest = answer, limit, longest
        self.new: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}

    def __call__(self, pieces: list[bytes]) -> list:
        """The answer (never None) for each of the distinct ``pieces``."""
        out = list(map(self.new.get, pieces))
        fresh = [i for i, x in enumerate(out) if x is None]
        ask = []
        for i in fresh:
            out[i] = self.old.get(pieces[i])
            if out[i] is None:
                ask.append(i)
        for i, x in zip(ask, self.answer([pieces[i] for i in ask]) if ask else []):
            out[i] = x
        for i in fresh:
            if len(pieces[i]) <= self.longest:
                if len(self.new) >= self.limit:
                    self.old, self.new = self.new, {}
                self.new[pieces[i]] = out[i]
        return out


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?)")] = True
#: Bytes that a character which is no white space may begin with, whatever follows them.
_OPENS = np.zeros(256, bool)
_OPENS[0x21:0x7F] = True
_OPENS[0xC3:0xF5] = True
_OPENS[[0xE1, 0xE2, 0xE3]] = False


class Marked(Words):
    """Words between ASCII white space, cut once more between an ASCII letter and one of the marks ``.,;:!?)``; A-Z is lowered in words of
    ASCII without ``<``, which begins the names of special tokens."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        super().__init__(raw, offsets, SPACED)
        odd = np.cumsum(np.append(0, (self.data >= 0x80) | (self.data == 0x3C)))
        low = LOWER[self.data]
        keep = np.flatnonzero(odd[self.ends] > odd[self.starts])
        at = ragged(self.starts[keep], self.ends[keep] - self.starts[keep])
        low[at] = self.data[at]
        cut = np.flatnonzero(_LETTER[self.data[:-1]] & _MARK[self.data[1:]]) + 1  # both bytes are of one word: neither is white space
        row_starts = offsets - offsets[0]
        cut = cut[~np.isin(cut, row_starts)]
        self.data, self.starts, self.ends = low, np.sort(np.append(self.starts, cut)), np.sort(np.append(self.ends, cut))
        self.first = np.searchsorted(self.starts, row_starts)


class Chunks(Words):
    """The texts, each after a space of its own, cut before single spaces that precede a character that is no white space, and between an ASCII letter
    and one of the marks ``.,;:!?)``. A piece holds the space that it begins with."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, cuts: bool = True):
        off = offsets - offsets[0]
        self.data = data = np.insert(raw[int(offsets[0]) : int(offsets[-1])], off[:-1], 32)
        off = off + np.arange(len(off))
        heads = np.zeros(len(data), bool)
        if cuts and len(data) > 2:
            heads[1:-1] = (data[1:-1] == 32) & (data[:-2] != 32) & _OPENS[data[2:]]
            heads[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        heads[off[:-1]] = True
        self.starts = np.flatnonzero(heads)
        self.ends = np.append(self.starts[1:], len(data))
        self.first = np.searchsorted(self.starts, off)
