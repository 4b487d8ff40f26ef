"""Periodic runs of words: stretches that repeat a period of q words, as long as ``max(least_words, 4 q)`` at least, and cannot be extended.

A run of period q from s to e shows as two equal stretches, one q words after the other, which can be extended neither to the left nor to the
right: a maximal pair at distance q of length e - s - q, three times the distance or more. So runs are found as maximal pairs, without extending
anything: suffixes of a document's words in sorted order are the leaves of a tree of LCP intervals, which is walked from the leaves up. Each interval
holds the starts of its stretches in order; a start from one child and one from another have exactly the interval's length in common, and if the words to their
left (their classes) differ and their distance allows, they are a maximal pair. Multiples of a period give the same stretch, whose least distance counts.

Only stretches of five words or more matter (three times the distance, and six words with it), so suffixes whose first five words occur nowhere else
in their document, or not near enough for what they have in common with any other, are left out beforehand, as are intervals of one left
class. Suffixes are ranked by doubling, five words at first; words are compared by 64-bit hashes, and the words of each run that is found
are compared by their bytes.

Documents are handled within the tasks, some 1 MB at a time (a longer one alone), so nothing is shuffled and a task holds one document's words at most.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from quillmark.llm._spark import bounded_batches
from quillmark.llm._words import SPACED, Words, ragged, release, same_bytes, slices, trimmed, utf8

#: A run repeats its period this often; pairs have one period less in common.
REPEATS = 4
LEAST_WORDS = 6
#: The least words that a pair can have in common: REPEATS - 1, or LEAST_WORDS less the distance of 1.
CORE = 5


def _levels(ids: np.ndarray, doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(ranks of the stretches of CORE, 2 CORE, 4 CORE, ... words that begin at each place, the places with a like, how near the next one is).

    Stretches of one document that are equal, and no others, have one rank; ranks grow with the numbers of the words. There are levels until all
    ranks differ. Places at the end of a document differ from all others, as the number that follows its words is its own.
    """
    n = len(ids)
    far = np.append(ids, int(ids.max()) + 1 + np.arange(CORE - 1))
    column = [far[j : j + n] for j in range(CORE)]
    if far[-1] < 1 << 21:
        column = [column[0] << 42 | column[1] << 21 | column[2], column[3] << 21 | column[4]]
    order = np.lexsort(column[::-1])
    same = doc[order][1:] == doc[order][:-1]
    for c in column:
        same &= c[order][1:] == c[order][:-1]
    same = np.append(False, same)
    level = np.zeros(n + 1, np.int32)
    index = np.arange(n)
    level[order] = 1 + np.maximum.accumulate(np.where(same, 0, index))
    like = same | np.append(same[1:], False)
    step = np.full(n + 1, n)
    step[1:n][same[1:]] = (order[1:] - order[:-1])[same[1:]]
    at, near = order[like], np.minimum(step[:-1], step[1:])[like]
    levels, members, k = [level], at, CORE
    while len(members):
        first, second = level[members], level[np.minimum(members + k, n)]
        o = np.lexsort((second, first))
        members, first, second = members[o], first[o], second[o]
        again = np.append(False, first[1:] == first[:-1])
        same = again & np.append(False, second[1:] == second[:-1])
        index = np.arange(len(members))
        level = level.copy()
        level[members] = first + np.maximum.accumulate(np.where(same, 0, index)) - np.maximum.accumulate(np.where(again, 0, index))
        levels.append(level)
        members = members[same | np.append(same[1:], False)]
        k *= 2
    return levels, at, near


def _common(levels: list[np.ndarray], words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at a and at b have in common (a < n, b < n, never equal)."""
    n, total = len(words), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + total, n), np.minimum(b + total, n)
        same = (levels[k][x] == levels[k][y]) & (levels[k][x] > 0)
        total[same] += CORE << k
    open_ = np.ones(len(a), bool)
    for _ in range(CORE):
        x, y = a + total, b + total
        open_ &= np.maximum(x, y) < n
        open_[open_] = words[x[open_]] == words[y[open_]]
        total[open_] += 1
    return total


def _pairs(at: list[int], common: list[int], left: dict[int, int]) -> list[tuple[int, int, int]]:
    """Maximal pairs (start, length of both with the distance, distance) among sorted suffixes; ``common[i]``: words that i - 1 and i share."""
    out: list[tuple[int, int, int]] = []

    def merged(a: list[int], b: list[int], length: int) -> list[int]:
        """The starts of two children; pairs between them are told. Starts nearer than a third of the length stand in equal steps, so all
        but the first of them have the same word to their left: looking at the nearest and the farthest is enough."""
        if len(a) < len(b):
            a, b = b, a
        reach = length // (REPEATS - 1)
        for x in b:
            i = bisect_left(a, x - reach)
            if i < len(a) and a[i] < x and left[a[i]] != left[x] and length + x - a[i] >= LEAST_WORDS:
                out.append((a[i], length + x - a[i], x - a[i]))
            i = bisect_left(a, x)
            while i < len(a) and a[i] - x <= reach and left[a[i]] != left[x]:
                if length + a[i] - x >= LEAST_WORDS:
                    out.append((x, length + a[i] - x, a[i] - x))
                i += 1
        if len(b) > 8:
            a += b
            a.sort()
        else:
            for x in b:
                insort(a, x)
        return a

    stack: list[tuple[int, list[int]]] = []
    current = [at[0]]
    for i in range(1, len(at) + 1):
        length = common[i] if i < len(at) else 0
        while stack and stack[-1][0] > length:
            h, others = stack.pop()
            current = merged(others, current, h)
        if stack and stack[-1][0] == length:
            current = merged(stack.pop()[1], current, length)
        stack.append((length, current))
        if i < len(at):
            current = [at[i]]
    return out


def find_runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of documents whose words are the 64-bit numbers ``words``; ``first``: where each document begins.

    Ordered by start, then period. Starts count over all documents.
    """
    none = (np.zeros(0, np.int64),) * 3
    if not len(words):
        return none
    sizes = np.diff(first)
    n = len(words) + len(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)
    stop = np.append(doc[1:] != doc[:-1], True)
    ids = np.empty(n, np.int64)  # each document is followed by a number of its own
    ids[~stop] = np.unique(words, return_inverse=True)[1]
    ids[stop] = len(words) + np.arange(len(sizes))
    levels, at, near = _levels(ids, doc)
    if not len(at):
        return none
    ranked = np.lexsort((levels[-1][at], doc[at]))
    sa, near = at[ranked], near[ranked]
    shared = np.append(0, np.where(doc[sa[1:]] == doc[sa[:-1]], _common(levels, ids, sa[:-1], sa[1:]), 0))
    # the nearest like must be near enough for the most words that the place has in common with any other
    kept = np.flatnonzero(near * (REPEATS - 1) <= np.maximum(shared, np.append(shared[1:], 0)))
    if not len(kept):
        return none
    sa = sa[kept]
    low = np.append(0, np.minimum.reduceat(shared[: kept[-1] + 1], kept[:-1] + 1) if len(kept) > 1 else [])  # what neighbours share
    left = np.where(sa > 0, ids[sa - 1], -1)  # before a document's first word stands the number of the document before
    cut = np.flatnonzero(low < CORE)
    end = np.append(cut[1:], len(sa))
    several = np.minimum.reduceat(left, cut) != np.maximum.reduceat(left, cut)  # else there is no maximal pair
    found: list[tuple[int, int, int]] = []
    for a, z in zip(cut[several].tolist(), end[several].tolist()):
        places = sa[a:z].tolist()
        found += _pairs(places, low[a:z].tolist(), dict(zip(places, left[a:z].tolist())))
    if not found:
        return none
    s, length, q = np.array(found, np.int64).T
    order = np.lexsort((q, length, s))
    s, length, q = s[order], length[order], q[order]
    least = np.append(True, (s[1:] != s[:-1]) | (length[1:] != length[:-1]))  # the others are multiples
    s, length, q = s[least], length[least], q[least]
    order = np.lexsort((q, s))
    s, length, q = s[order], length[order], q[order]
    return s - doc[s], length, q


def looped(n: int, doc_id: object) -> np.ndarray | None:
    """Which word stands at each place of a text of n words that the contract's rule repeats; None where the rule leaves it alone."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _exact(words: Words, source: np.ndarray) -> np.ndarray:
    """Numbers that are equal only for equal words."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(words.data[a:z].tobytes(), len(known) + 1) for a, z in zip(words.starts.tolist(), words.ends.tolist())], np.uint64)
    return ids[source]


def document_runs(words: Words, source: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of documents that have word ``source[i]`` at place i, with the words of each run compared by their bytes."""
    found = find_runs(words.hashes(double=True)[source], first)
    s, length, q = found
    at = ragged(s, length - q)
    a, b = source[at], source[at + np.repeat(q, length - q)]
    differ = a != b
    a, b = a[differ], b[differ]
    size = words.ends - words.starts
    if np.array_equal(size[a], size[b]) and same_bytes(words.data, words.starts[a], words.starts[b], size[a]).all():
        return found
    return find_runs(_exact(words, source), first)  # two words share a hash


def periodic_runs(docs: DataFrame, *, rule: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_runs, start, length, period, exponent_milli, runs, runs_sha256, collapsed_sha256) of each row.

    ``runs`` are structs of start, length and period by start, then period; the single columns tell the run with the greatest length by
    period (ties: the least start, then the least period) and are null without runs. ``collapsed_sha256`` digests the words without those that some run
    contains after its first period, joined by one space. ``rule`` repeats a part of the words of some documents first (``looped``). Null and empty
    texts have no words; repeated rows repeat, other columns are ignored, an empty table gives no rows.
    """
    bounded_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed_sha256"]
    schema = f"doc_id {kind}, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, runs_sha256 string, collapsed_sha256 string"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(ids: list, w: Words):
        source = np.arange(len(w))
        if rule:
            for i, doc_id in enumerate(ids):
                moved = looped(int(w.first[i + 1] - w.first[i]), doc_id)
                if moved is not None:
                    source[w.first[i] : w.first[i + 1]] = w.first[i] + moved
        s, length, q = document_runs(w, source, w.first)
        gone = np.zeros(len(w) + 1, np.int64)
        np.add.at(gone, s + q, 1)
        np.add.at(gone, s + length, -1)
        kept = np.cumsum(gone)[:-1] == 0 if len(w) else np.zeros(0, bool)
        joined, at = w.joined()
        at_run = np.searchsorted(s, w.first).tolist()
        before = np.append(0, np.cumsum(kept))
        word = source[kept]
        text = joined[ragged(at[word], at[word + 1] - at[word])].tobytes() if len(word) else b""
        upto = np.append(0, np.cumsum(at[word + 1] - at[word]))[before[w.first]].tolist()
        for i, (a, z) in enumerate(zip(at_run, at_run[1:])):
            offset = int(w.first[i])
            mine = list(zip((s[a:z] - offset).tolist(), length[a:z].tolist(), q[a:z].tolist()))
            best = None
            for r in mine:
                if best is None or r[1] * best[2] > best[1] * r[2]:
                    best = r
            told = "".join([f"{x},{y},{p}\n" for x, y, p in mine])
            tail = text[upto[i] : upto[i + 1]][:-1]
            yield (int(w.first[i + 1]) - offset, len(mine), *(best or (None,) * 3), best and 1000 * best[1] // best[2], [dict(start=x, length=y, period=p) for x, y, p in mine], hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(tail).hexdigest())

    def run(batches):
        for b in trimmed(batches):
            raw, off = utf8(b.column(1))
            ids = b.column(0).to_pylist()
            for lo, hi in slices(off):
                w = Words(raw, off[lo : hi + 1], SPACED)
                columns = list(zip(*rows(ids[lo:hi], w)))
                types = [*[pa.int64()] * 6, run_type, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)
        release()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)
