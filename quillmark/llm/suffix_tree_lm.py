"""Language-model scoring with a probabilistic suffix tree over characters (UTF-8 bytes).

The text of a document is its lower-cased words with one space between them and an end symbol. A context of up to
``DEPTH`` symbols is a candidate if it occurs ``MIN_COUNT`` times in training, an absolute number, so the tree grows with the
corpus. It is retained if its next-symbol distribution diverges from the one of its longest proper suffix by ``MIN_GAIN`` nats
over all its occurrences; suffixes of what is retained are kept too. Distributions are smoothed by those of the suffix, down to
256 equally likely bytes, and a symbol is scored from the longest retained suffix of its past.

The contexts are a table and nothing limits them. They are applied in blocks by their last three symbols, of about
``BLOCK_STATES`` contexts: all retained suffixes of a past are in one block (the shorter ones in each), so each position is
scored by one block, a document's score is the sum over the blocks, and one block at a time is built and broadcast.

One pass over the corpus writes, for units of ``UNIT_BYTES`` of text, word counts, counts of (DEPTH + 1)-grams, and
the documents as numbers of the unit's distinct words. The counts are summed over all units; each unit gets back the sums
of its own words only, so no vocabulary is broadcast or collected.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import zstandard
from pyspark.sql import DataFrame, Window

from quillmark.llm._spark import bounded_batches, crc_mod, written
from quillmark.llm._words import SPACED, U64, Words, ragged, slices, trimmed, utf8

DEPTH = 5
MIN_COUNT = 100
MIN_GAIN = 20.0
STRENGTH = 2.0
UNIT_BYTES = 8_000_000
CHUNK = 1 << 16
BLOCK_STATES = 100_000
END = 10
WORDS, DOCS, GRAMS = 1, 2, 3
NULLS_LAST = (1 << 63) - 1


def symbols(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each row's symbols, the last of them the end, after ``DEPTH`` end symbols as its past; and the n + 1 offsets."""
    data, at = words.joined()
    data = data.copy()
    size = at[words.first[1:]] - at[words.first[:-1]]
    data[at[words.first[1:]][size > 0] - 1] = END
    full = np.maximum(size, 1) + DEPTH
    off = np.concatenate([[0], np.cumsum(full)])
    out = np.full(off[-1], END, np.uint8)
    out[ragged(off[:-1] + DEPTH, size)] = data
    return out, off


def gram_codes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The (DEPTH + 1)-gram that ends at each symbol, as bytes of a number."""
    at = ragged(off[:-1], np.diff(off) - DEPTH)
    code = np.zeros(len(at), np.int64)
    for j in range(DEPTH + 1):
        code = (code << 8) | data[at + j]
    return code


class _Unit:
    def __init__(self):
        self.hashes, self.counts, self.meta, self.grams, self.bytes = [], [], [], [], 0

    def add(self, raw, off, ids, keys, train) -> None:
        words = Words(raw, off, SPACED, lower=True)
        self.bytes += int(off[-1] - off[0])
        self.hashes.append(words.hashes(double=True))
        self.counts.append(np.diff(words.first))
        self.meta.append((ids, keys, train))
        if train.any():
            data, at = symbols(words)
            codes = gram_codes(data, at)
            keep = np.repeat(train, np.diff(at) - DEPTH)
            self.grams.append(np.unique(codes[keep], return_counts=True))

    def rows(self):
        """(kind, h, c, blob) columns of everything that the unit has to tell."""
        h, n = np.concatenate(self.hashes), np.concatenate(self.counts)
        ids, keys, train = (np.concatenate([m[i] for m in self.meta]) for i in range(3))
        distinct, local = np.unique(h, return_inverse=True)
        weight = np.repeat(train, n)
        c = np.bincount(local, weights=weight, minlength=len(distinct)).astype(np.int64)
        yield WORDS, distinct.view(np.int64), c, None
        doc = np.repeat(np.arange(len(n)), n)
        pair, times = np.unique(doc * max(len(distinct), 1) + local, return_counts=True)
        doc, local = pair // max(len(distinct), 1), pair % max(len(distinct), 1)
        per = np.bincount(doc, minlength=len(n))
        delta = np.diff(local, prepend=0)
        delta[np.cumsum(per)[:-1][per[1:] > 0]] = local[np.cumsum(per)[:-1][per[1:] > 0]] if len(per) > 1 else 0
        fields = [ids.astype(np.int64), keys.astype(np.int32), n.astype(np.int32), per.astype(np.int32), delta.astype(np.uint32), np.minimum(times, 255).astype(np.uint8), times[times >= 255].astype(np.int32)]
        body = b"".join([np.array([len(n), len(delta)], np.int64).tobytes()] + [f.tobytes() for f in fields])
        yield DOCS, np.zeros(1, np.int64), np.array([int(train.sum())]), [zstandard.ZstdCompressor(level=3).compress(body)]
        if self.grams:
            codes, counts = np.concatenate([g for g, _ in self.grams]), np.concatenate([k for _, k in self.grams])
            codes, inverse = np.unique(codes, return_inverse=True)
            yield GRAMS, codes, np.bincount(inverse, weights=counts).astype(np.int64), None


def _open(blob: bytes):
    body = zstandard.ZstdDecompressor().decompress(blob)
    docs, pairs = np.frombuffer(body, np.int64, 2)
    at, out = 16, []
    for kind, n in ((np.int64, docs), (np.int32, docs), (np.int32, docs), (np.int32, docs), (np.uint32, pairs), (np.uint8, pairs)):
        out.append(np.frombuffer(body, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    ids, keys, n, per, delta, times = out
    times = times.astype(np.int64)
    times[times == 255] = np.frombuffer(body, np.int32, -1, at) if at < len(body) else 0
    stop = np.cumsum(per)
    total = np.cumsum(delta.astype(np.int64))
    before = np.where(stop > per, total[np.maximum(stop - per, 1) - 1], 0)
    return ids, keys, n, per, total - np.repeat(before, per), times


def gather_counts(src: DataFrame) -> DataFrame:
    """(kind, unit, h, c, blob) rows of (id bigint, key int, train boolean, text string)."""

    def count(batches):
        unit = _Unit()

        def flush():
            name = uuid.uuid4().int >> 65  # a unit's rows come from one attempt of one task and are written once
            for kind, h, c, blob in unit.rows():
                for i in range(0, len(h), 50_000):
                    n = len(h[i : i + 50_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, kind), pa.int32()), pa.array(np.full(n, name), pa.int64()), pa.array(h[i : i + n]), pa.array(c[i : i + n]), pa.array(blob or [None] * n, pa.binary())],
                        names=["kind", "unit", "h", "c", "blob"],
                    )

        for b in trimmed(batches):
            ids, keys, train = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            raw, off = utf8(b.column(3))
            for lo, hi in slices(off):
                unit.add(raw, off[lo : hi + 1], ids[lo:hi], keys[lo:hi], train[lo:hi])
                if unit.bytes >= UNIT_BYTES:
                    yield from flush()
                    unit = _Unit()
        if unit.meta:
            yield from flush()

    return src.mapInArrow(count, "kind int, unit bigint, h bigint, c bigint, blob binary")


def _base_sums(told: DataFrame) -> DataFrame:
    """(id, key, n_tokens, n_known, logs) with logs the sum of log10(count + 0.1) over words, without the end."""
    word = told.where(F.col("kind") == WORDS)
    reply = word.select("unit", "h", F.sum("c").over(Window.partitionBy("h")).alias("total"))
    blobs = told.where(F.col("kind") == DOCS).select("unit", "blob")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        h, total = right.column("h").to_numpy().view(U64), right.column("total").to_numpy()
        total = total[np.argsort(h)]
        logs = np.log10(total + 0.1)
        out = []
        for blob in left.column("blob").to_pylist():
            ids, keys, n, per, local, times = _open(blob)
            doc = np.repeat(np.arange(len(n)), per)
            known = np.bincount(doc, weights=times * (total[local] > 0), minlength=len(n)).astype(np.int64)
            out.append(pa.table([pa.array(ids), pa.array(keys), pa.array(n.astype(np.int64) + 1), pa.array(known), pa.array(np.bincount(doc, weights=times * logs[local], minlength=len(n)).astype(np.float64))], names=["id", "key", "n_tokens", "n_known", "logs"]))
        kind = pa.schema([("id", pa.int64()), ("key", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64())])
        return pa.concat_tables(out) if out else kind.empty_table()

    found = blobs.groupBy("unit").cogroup(reply.groupBy("unit")).applyInArrow(score, "id bigint, key int, n_tokens bigint, n_known bigint, logs double")
    return found.groupBy("id", "key").agg(*(F.first(c).alias(c) for c in ("n_tokens", "n_known", "logs")))  # repeated rows agree


class SuffixTree:
    """Retained contexts as a tree: the children of a context are those that reach one symbol further back.

    Built from the next-symbol counts of contexts of which every suffix is given too. It scores the positions whose last three
    symbols lie in ``ends`` (a range of three-byte numbers).
    """

    def __init__(self, depth: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, ends: tuple[int, int] = (0, 1 << 24), min_gain: float = MIN_GAIN, strength: float = STRENGTH):
        self.ends = ends
        seen = np.unique(np.append(symbol, END)) if len(symbol) else np.array([END])
        self.number = np.zeros(256, np.int64)
        self.number[seen] = np.arange(len(seen)) + (len(seen) < 256)  # 0: any byte that training lacks
        width = len(seen) + (len(seen) < 256)
        key = (depth.astype(np.int64) << 56) | context
        if not len(key):
            key, symbol, n = np.array([0]), np.array([END]), np.array([0])
        names, row = np.unique(key, return_inverse=True)
        counts = np.bincount(row * width + self.number[symbol], weights=n, minlength=len(names) * width).astype(np.float32).reshape(len(names), width)
        length, past = names >> 56, names & ((1 << 56) - 1)
        under = np.maximum(length - 1, 0)
        suffix = np.searchsorted(names, (under << 56) | (past & ((1 << 8 * under) - 1)))
        chance, gain = np.empty_like(counts), np.zeros(len(names))
        for d in range(int(length.max()) + 1):
            level = np.flatnonzero(length == d)
            for i in np.array_split(level, len(level) // 4096 + 1):
                size = counts[i].sum(1, dtype=np.float64).astype(np.float32)[:, None]
                below = chance[suffix[i]] if d else np.full((1, width), np.float32(1 / 256))
                pull = np.float32(strength) * (counts[i] > 0).sum(1, keepdims=True, dtype=np.float32) + np.float32(0.01)  # the more kinds of symbols follow, the more the suffix counts
                chance[i] = (counts[i] + pull * below) / (size + pull)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain[i] = np.where(counts[i] > 0, counts[i] * np.log(counts[i] / (size * below)), 0).sum(1)
        del counts
        keep = gain >= min_gain
        keep[0] = True
        for d in range(int(length.max()), 0, -1):
            keep[suffix[keep & (length == d)]] = True
        old = np.flatnonzero(keep)  # by depth
        inner = int((length[old] < DEPTH).sum())
        place = np.zeros(len(names), np.int64)  # leaves come after the sink, which has number ``inner``
        place[old] = np.arange(len(old)) + (np.arange(len(old)) >= inner)
        self.child = np.full((inner + 1, width), inner, np.int32)
        deep = old[length[old] > 0]
        self.child[place[suffix[deep]], self.number[past[deep] >> 8 * (length[deep] - 1)]] = place[deep]
        self.logs = np.zeros((len(old) + 1, width), np.float32)
        self.logs[place[old]] = np.log10(chance[old])

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """log10 probability of the symbols of each row of ``symbols`` that this tree scores, each from its longest retained suffix."""
        number = self.number[data]
        width, child, logs, sink = self.child.shape[1], self.child.ravel(), self.logs.ravel(), len(self.child) - 1
        total = np.zeros(len(off) - 1)
        where = ragged(off[:-1] + DEPTH, np.diff(off) - DEPTH)
        for a in range(0, len(where), CHUNK):
            at = where[a : a + CHUNK]
            if self.ends != (0, 1 << 24):
                end = (data[at - 3].astype(np.int64) << 16) | (data[at - 2].astype(np.int64) << 8) | data[at - 1]
                at = at[(end >= self.ends[0]) & (end < self.ends[1])]
            node, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for j in range(1, DEPTH + 1):
                node = child[node * width + number[at - j]].astype(np.int64)
                best = np.where(node != sink, node, best)
            total += np.bincount(np.searchsorted(off, at, "right") - 1, weights=logs[best * width + number[at]], minlength=len(total))
        return total


def contexts(told: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(d, past, all, next) of the contexts that occur at least ``min_count`` times in training, and the empty one; ``next`` has 256 entries at most."""
    grams = told.where(F.col("kind") == GRAMS).groupBy("h").agg(F.sum("c").alias("n"))
    depths = F.explode(F.transform(F.sequence(F.lit(0), F.lit(DEPTH)), lambda d: F.struct(d.alias("d"), F.expr("(h div 256)").alias("past"))))
    flat = grams.select("n", (F.col("h") % 256).alias("x"), depths.alias("g"))
    flat = flat.select("n", "x", F.col("g.d").alias("d"), F.expr("g.past & (shiftleft(1L, 8 * g.d) - 1)").alias("past"))
    rows = flat.groupBy("d", "past", "x").agg(F.sum("n").alias("n"))
    groups = rows.groupBy("d", "past").agg(F.sum("n").alias("all"), F.collect_list(F.struct("x", "n")).alias("next"))
    return groups.where((F.col("all") >= min_count) | (F.col("d") == 0))


def block_ends(groups: DataFrame, block_states: int = BLOCK_STATES) -> list[tuple[int, int]]:
    """Ranges of the last three symbols with about ``block_states`` contexts each, which cover everything.

    Contexts of three symbols and more that end alike are 1 + 256 + 65,536 at most, which bounds how far a block goes beyond.
    """
    sizes = groups.where("d >= 3").groupBy(F.expr("past & 16777215").alias("e")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("e").rowsBetween(Window.unboundedPreceding, -1))  # rows: one of each three bytes that occur
    starts = sizes.select("e", (F.coalesce(before, F.lit(0)) / block_states).cast("int").alias("block")).groupBy("block").agg(F.min("e").alias("e")).orderBy("e").collect()
    edges = [0] + [r.e for r in starts[1:]] + [1 << 24]
    return list(zip(edges[:-1], edges[1:]))


def block_tree(groups: DataFrame, ends: tuple[int, int], min_gain: float = MIN_GAIN) -> SuffixTree:
    """The tree of one range: its contexts and all of fewer than three symbols."""
    end = F.expr("past & 16777215")
    mine = groups.where((F.col("d") < 3) | ((end >= ends[0]) & (end < ends[1])))
    got = mine.select("d", "past", F.explode("next").alias("g")).select("d", "past", "g.x", "g.n").toArrow()
    return SuffixTree(*(got.column(i).to_numpy() for i in range(4)), ends=ends, min_gain=min_gain)


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, min_gain: float = MIN_GAIN, block_states: int = BLOCK_STATES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row, logarithms to base 10.

    Learns from rows whose crc32(id as text) mod 10 is not 0; the others are held out. Null and empty texts have one token,
    the end. Without training rows the base is 1 / 0.1 * 0.1 and the tree is 256 equal bytes. Repeated rows count as often as they
    occur and get equal scores; a null id counts as the empty text for the fold; other columns are ignored.
    """
    bounded_batches(docs)
    spark = docs.sparkSession
    src = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULLS_LAST)).alias("id"),
        F.hash(F.col(text_col)).alias("key"),
        (crc_mod(F.col(id_col), 10) != 0).alias("train"),
        F.col(text_col).cast("string").alias("text"),
    )
    told = written(gather_counts(src.select("id", "key", "train", "text")), "unit-counts")
    groups = written(contexts(told, min_count), "contexts")
    word = told.where(F.col("kind") == WORDS).groupBy("h").agg(F.sum("c").alias("c")).where("c > 0").agg(F.count("*"), F.sum("c")).first()
    ends = told.where(F.col("kind") == DOCS).agg(F.sum("c")).first()[0] or 0
    distinct, tokens = word[0] + (ends > 0), (word[1] or 0) + ends

    def scores(tree):
        def score(batches):
            for b in trimmed(batches):
                raw, off = utf8(b.column(4))
                for lo, hi in slices(off):
                    data, at = symbols(Words(raw, off[lo : hi + 1], SPACED, lower=True))
                    part = b.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([part.column(i) for i in range(4)] + [pa.array(tree.value.score(data, at))], names=["doc_id", "id", "key", "train", "score"])

        return src.mapInArrow(score, f"doc_id {kind}, id bigint, key int, train boolean, score double")

    kind = docs.schema[id_col].dataType.simpleString()
    *others, last = block_ends(groups, block_states)
    parts = []
    for i, block in enumerate(others):  # one block's tree at a time: a pass over the texts, whose sums are written
        tree = spark.sparkContext.broadcast(block_tree(groups, block, min_gain))
        parts.append(written(scores(tree).select("id", "key", "score").dropDuplicates(["id", "key"]), f"scores-{i}"))
        tree.destroy()
    scored = scores(spark.sparkContext.broadcast(block_tree(groups, last, min_gain)))
    if parts:
        more = reduce(DataFrame.unionByName, parts).groupBy("id", "key").agg(F.sum("score").alias("more"))
        scored = scored.join(more, ["id", "key"]).withColumn("score", F.col("score") + F.col("more")).drop("more")
    joined = scored.join(_base_sums(told), ["id", "key"], "left")
    base = F.col("logs") + F.lit(math.log10(ends + 0.1)) - F.col("n_tokens") * F.lit(math.log10(tokens + 0.1 * (distinct + 1)))
    return joined.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(int(tokens)).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score"
    )
