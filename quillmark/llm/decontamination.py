"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ``window`` consecutive words of a benchmark item (an item with fewer words is one window) is a
pattern. The symbols of the search are words. Patterns of one length share a shift table on blocks of two words:
it says how far the search can move on without skipping an occurrence. Where it says 0, the hash of the last block
and of the first select a bucket of patterns, and comparing the words themselves confirms the occurrence.

Lanes (stretches of up to ``LANE`` words) move through the text side by side, so one numpy step serves many of them.

Patterns are broadcast in blocks of at most about ``block_windows`` windows. A benchmark with more of them is
searched block by block, and what the blocks find is joined by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from quillmark.llm._spark import bounded_batches
from quillmark.llm._words import ALNUM, U64, Words, ragged, runs, same_bytes, slices, trimmed, utf8, window_starts

LANE = 512
TABLE_BITS = 18
BLOCK_WINDOWS = 200_000


def _words_of(batch_column) -> Words:
    raw, off = utf8(batch_column)
    return Words(raw, off, ALNUM, lower=True)


def phrase_bytes(words: Words, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words first .. first + count - 1 joined by spaces, phrase after phrase, and the n + 1 offsets."""
    w = ragged(first, count)
    size = words.ends[w] - words.starts[w] + 1
    stop = np.cumsum(size)
    src = ragged(words.starts[w], size)
    src[stop - 1] = 0
    out = words.data[src]
    out[stop - 1] = 32
    at = np.zeros(len(first) + 1, np.int64)
    at[1:] = stop[np.cumsum(count) - 1]
    return out, at


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct (item, n, phrase) rows; items without words have none, a null item id reads as the empty text."""

    def cut(batches):
        for b in trimmed(batches):
            raw, off = utf8(b.column(1))
            for lo, hi in slices(off):
                words = Words(raw, off[lo : hi + 1], ALNUM, lower=True)
                n = np.diff(words.first)
                short = (n > 0) & (n < window)
                first = np.concatenate([window_starts(words.first, window), words.first[:-1][short]])
                count = np.concatenate([np.full(len(first) - int(short.sum()), window), n[short]]).astype(np.int64)
                if not len(first):
                    continue
                data, at = phrase_bytes(words, first, count)
                row = np.searchsorted(words.first, first, "right") - 1 + lo
                whole = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array(count, pa.int32()), pa.array([whole[s : e - 1].decode() for s, e in zip(at[:-1], at[1:])])],
                    names=["item", "n", "phrase"],
                )

    src = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(cut, "item string, n int, phrase string").distinct()


class Patterns:
    """Wu-Manber tables of the patterns of one length."""

    def __init__(self, n: int, phrases: list[str], items: np.ndarray):
        self.n, self.block = n, min(2, n)
        encoded = [p.encode() + b" " for p in phrases]
        self.at = np.zeros(len(encoded) + 1, np.int64)
        np.cumsum([len(x) for x in encoded], out=self.at[1:])
        self.data = np.frombuffer(b"".join(encoded), np.uint8)
        words = Words(self.data, self.at, ALNUM)
        h = words.hashes().reshape(len(phrases), n)
        blocks = np.stack([runs(row, self.block) for row in h])  # patterns x (n - block + 1)
        self.far = n - self.block + 1
        shift = np.full(1 << TABLE_BITS, self.far, np.int64)
        for j in range(blocks.shape[1]):
            np.minimum.at(shift, slot(blocks[:, j]), self.far - 1 - j)
        self.shift = shift
        order = np.argsort(key := bucket(blocks[:, 0], blocks[:, -1]), kind="stable")
        self.key, self.order, self.items = key[order], order, items

    def find(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern's item of each occurrence in the rows of ``words``."""
        blocks = runs(h, self.block)
        rows = np.diff(words.first)
        ends = np.maximum(rows - self.n + 1, 0)  # places in a row where a window can start
        lanes = -(-ends // LANE)
        step = ragged(np.zeros(len(lanes), np.int64), lanes) * LANE
        pos = np.repeat(words.first[:-1], lanes) + step
        stop = np.minimum(pos + LANE, np.repeat(words.first[:-1] + ends, lanes))
        hits = []
        last = self.n - self.block
        table = self.shift[slot(blocks)].astype(np.uint8) if len(blocks) else np.zeros(0, np.uint8)
        while len(pos):
            move = table[pos + last]
            hits.append(pos[move == 0])
            pos = pos + np.maximum(move, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        at = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        if not len(at):
            return at, at
        want = bucket(blocks[at], blocks[at + last])
        lo, hi = np.searchsorted(self.key, want, "left"), np.searchsorted(self.key, want, "right")
        start, pattern = np.repeat(at, hi - lo), self.order[ragged(lo, hi - lo)]
        if not len(start):
            return start, start
        data, off = phrase_bytes(words, start, np.full(len(start), self.n))
        size = np.diff(off)
        ok = size == self.at[pattern + 1] - self.at[pattern]
        start, pattern, size, off = start[ok], pattern[ok], size[ok], off[:-1][ok]
        both = np.concatenate([data, self.data])
        ok = same_bytes(both, off, self.at[pattern] + len(data), size) if len(start) else np.zeros(0, bool)
        return start[ok], self.items[pattern[ok]]


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - TABLE_BITS)).astype(np.int64)


def bucket(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return first * U64(0x9E3779B97F4A7C15) ^ last


def build(rows) -> tuple[list[str], list[Patterns]]:
    """Tables for collected (item, n, phrase) rows."""
    names = sorted({r.item for r in rows})
    number = {x: i for i, x in enumerate(names)}
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.n, r.phrase, r.item)):
        by.setdefault(r.n, []).append(r)
    return names, [Patterns(n, [r.phrase for r in rs], np.array([number[r.item] for r in rs])) for n, rs in by.items()]


def _scan(docs: DataFrame, tables) -> DataFrame:
    """(doc_id, row_key, n_words, spans, items) for every row of (doc_id, row_key, text)."""
    bounded_batches(docs)
    span = pa.struct([("s", pa.int32()), ("e", pa.int32())])

    def scan(batches):
        names, groups = tables.value
        for b in trimmed(batches):
            raw, off = utf8(b.column(2))
            for lo, hi in slices(off):
                words = Words(raw, off[lo : hi + 1], ALNUM, lower=True)
                h = words.hashes()
                n, rows = len(words), np.diff(words.first)
                edge = np.zeros(n + 1, np.int64)
                found_row, found_item = [], []
                for g in groups:
                    start, item = g.find(words, h)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + g.n, -1)
                    found_row.append(np.searchsorted(words.first, start, "right") - 1)
                    found_item.append(item)
                cover = np.zeros(n + 2, np.int8)
                cover[1:-1] = np.cumsum(edge)[:n] > 0
                first_word = np.zeros(n + 1, bool)
                first_word[words.first] = True
                up = np.flatnonzero(cover[1:-1].astype(bool) & ((cover[:-2] == 0) | first_word[:n]))
                down = np.flatnonzero(cover[1:-1].astype(bool) & ((cover[2:] == 0) | first_word[1:])) + 1
                of = np.searchsorted(words.first, up, "right") - 1
                at = np.zeros(len(rows) + 1, np.int64)
                np.cumsum(np.bincount(of, minlength=len(rows)), out=at[1:])
                base = words.first[of]
                spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(up - base, pa.int32()), pa.array(down - base, pa.int32())], fields=list(span)))
                row, item = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (found_row, found_item))
                pair = np.unique(row * max(len(names), 1) + item)
                row, item = pair // max(len(names), 1), pair % max(len(names), 1)
                np.cumsum(np.bincount(row, minlength=len(rows)), out=at[1:])
                items = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array([names[i] for i in item], pa.string()))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.int64()), spans, items], names=["doc_id", "row_key", "n_words", "spans", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"doc_id {kind}, row_key int, n_words bigint, spans array<struct<s:int,e:int>>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Occurrences of benchmark windows: (doc_id, n_words, n_hit, items, spans, contaminated), one row per input row.

    Null and empty texts have no words, and no hits. An empty benchmark hits nothing. Repeated rows give repeated
    results. ``spans`` are the hit words as disjoint [s, e) ranges of word numbers; ``items`` are sorted as strings.
    Other columns of either table are ignored, whatever their names.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.hash(F.col(text_col)).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    windows = benchmark_windows(benchmark, item_col, item_text_col, window)
    total = windows.count()
    blocks = max(1, -(-total // block_windows))
    found = []
    for k in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k)
        found.append(_scan(src, spark.sparkContext.broadcast(build(part.collect()))))  # at most about block_windows rows
    out = found[0]
    if blocks > 1:
        rest = found[1]
        for x in found[2:]:
            rest = rest.unionByName(x)
        rest = rest.where(F.size("items") > 0).groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k"), "row_key").agg(F.flatten(F.collect_set("spans")).alias("more"), F.flatten(F.collect_set("items")).alias("others"))
        out = (
            out.withColumn("k", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
            .join(rest, ["k", "row_key"], "left")
            .withColumn("spans", F.concat("spans", F.coalesce("more", F.array().cast("array<struct<s:int,e:int>>"))))
            .withColumn("items", F.array_distinct(F.concat("items", F.coalesce("others", F.array().cast("array<string>")))))
        )
    merged = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["e"], x["s"]))).alias("n"), F.greatest(a["e"], x["e"]).alias("e")),
    )["n"]
    return out.select("doc_id", "n_words", merged.cast("bigint").alias("n_hit"), F.array_sort("items").alias("items"), "spans", (F.size("items") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a benchmark window, with all their columns; cases as for ``decontaminate``."""
    bounded_batches(docs)
    windows = benchmark_windows(benchmark, item_col, item_text_col, window)
    blocks = max(1, -(-windows.count() // block_windows))
    at = docs.columns.index(text_col)
    out = docs
    for k in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k)
        tables = docs.sparkSession.sparkContext.broadcast(build(part.collect()))

        def keep(batches, tables=tables):
            for b in trimmed(batches):
                raw, off = utf8(b.column(at))
                for lo, hi in slices(off):
                    words = Words(raw, off[lo : hi + 1], ALNUM, lower=True)
                    h = words.hashes()
                    clean = np.ones(hi - lo, bool)
                    for g in tables.value[1]:
                        start, _ = g.find(words, h)
                        clean[np.searchsorted(words.first, start, "right") - 1] = False
                    yield b.slice(lo, hi - lo).filter(pa.array(clean))

        out = out.mapInArrow(keep, docs.schema)
    return out
