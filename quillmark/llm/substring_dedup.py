"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words of one document; its minimiser is its least ``M``-word hash. Consecutive windows
with the same minimiser travel as one packed string (a super-k-mer) to the bucket of the minimiser, where sorting brings
equal windows together and comparing their bytes confirms them. A word goes if a window over it also starts in a
document with a smaller id.

Before anything travels, equal super-k-mers of the documents a task has read meet: only those of the least id travel, since
the windows of the others certainly start in a document with a smaller id. So a passage or a document that a third of all rows
share sends one string per task, not one per row. Strings travel in compressed blobs, one for each target partition and
``FLUSH_BYTES`` of text; there they are sorted by bucket, and only whole buckets are held at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import zstandard
from pyspark.sql import DataFrame

from quillmark.llm._spark import bounded_batches
from quillmark.llm._words import SPACED, U64, Words, binary_array, gather, mix, release, runs, same_bytes, slices, trimmed, utf8, window_starts

M = 4
FLUSH_BYTES = 6_000_000
CHUNK_BYTES = 1_500_000
_STEP = U64(0x2545F4914F6CDD1D)
NULLS_LAST = (1 << 63) - 1


def minimisers(words: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and minimiser of every window that stays in one row."""
    short = runs(h, M)
    start = window_starts(words.first, window)
    least = short[start]
    for j in range(1, window - M + 1):
        np.minimum(least, short[start + j], out=least)
    return start, least


def super_kmers(words: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each super-k-mer."""
    start, least = minimisers(words, h, window)
    if not len(start):
        return start, start, least
    new = np.ones(len(start), bool)
    new[1:] = (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return start[at], np.diff(np.append(at, len(start))), least[at]


def _range_hashes(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of h[first : first + count] for each pair."""
    n = len(h)
    powers = np.cumprod(np.concatenate([[U64(1)], np.full(n, _STEP, U64)]), dtype=U64)
    inverse = U64(pow(int(_STEP), -1, 1 << 64))
    back = np.cumprod(np.concatenate([[U64(1)], np.full(n, inverse, U64)]), dtype=U64)
    c = np.zeros(n + 1, U64)
    np.cumsum(h * powers[:n], out=c[1:])
    return mix((c[first + count] - c[first]) * back[first] ^ count.astype(U64))


class _Buffer:
    """Super-k-mers of up to ``FLUSH_BYTES`` of text, ready to be thinned out and packed."""

    def __init__(self):
        self.parts, self.bytes = [], 0

    def add(self, raw, off, ids, keys, window: int) -> None:
        words = Words(raw, off, SPACED)
        h = words.hashes()
        first, count, least = super_kmers(words, h, window)
        self.bytes += int(off[-1] - off[0])
        if not len(first):
            return
        length = count + window - 1
        data, at = words.joined()
        size = at[first + length] - at[first] - 1
        row = np.searchsorted(words.first, first, "right") - 1
        self.parts.append(
            {
                "id": ids[row], "key": keys[row], "start": (first - words.first[row]).astype(np.int32), "count": count.astype(np.int32), "bucket": (least >> U64(32)).astype(np.int64),
                "hash": _range_hashes(h, first, length), "size": size, "data": gather(data, at[first], size),
            }
        )

    def take(self) -> dict | None:
        parts, self.parts, self.bytes = self.parts, [], 0
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else None


def _settled(x: dict) -> np.ndarray:
    """Super-k-mers equal to one of a smaller id in the same buffer: all their windows go, whatever others hold."""
    order = np.lexsort((x["id"], x["hash"]))
    h, ids = x["hash"][order], x["id"][order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    later = np.flatnonzero((ids > ids[head]) & ~new)
    a, b = order[later], order[head[later]]
    ok = x["size"][a] == x["size"][b]
    a, b = a[ok], b[ok]
    at = np.cumsum(x["size"]) - x["size"]
    out = np.zeros(len(h), bool)
    if len(a):
        out[a[same_bytes(x["data"], at[a], at[b], x["size"][a])]] = True
    return out


def _pack(x: dict, keep: np.ndarray, partitions: int, done: np.ndarray, window: int):
    """(target, blob) rows, two targets for each partition to even them out; what is settled travels as bare ranges."""
    press = zstandard.ZstdCompressor(level=3)
    target = (mix(x["bucket"].astype(U64)) % U64(2 * partitions)).astype(np.int64)
    at = np.cumsum(x["size"]) - x["size"]
    order = keep[np.argsort(target[keep], kind="stable")]
    edges = np.flatnonzero(np.diff(target[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        i = order[a:b]
        fields = [np.diff(x["id"][i], prepend=0), x["key"][i].astype(np.int32), x["start"][i], x["count"][i].astype(np.uint8), x["size"][i].astype(np.int32)]
        body = b"".join(f.tobytes() for f in fields) + gather(x["data"], at[i], x["size"][i]).tobytes()
        yield int(target[i[0]]), press.compress(len(i).to_bytes(8, "little") + body)
    if len(done):  # to one partition by turns; only ranges, nothing to compare
        i = done
        rows = [np.diff(x["id"][i], prepend=0), x["key"][i].astype(np.int32), x["start"][i], (x["start"][i] + x["count"][i] + window - 1).astype(np.int32)]
        yield int(target[i[0]]), press.compress((len(i) | 1 << 62).to_bytes(8, "little") + b"".join(f.tobytes() for f in rows))


def _unpack(blob: bytes) -> tuple[bool, list[np.ndarray]]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(body[:8], "little"), 8, []
    settled, n = bool(n >> 62), n & ((1 << 62) - 1)
    kinds = (np.int64, np.int32, np.int32, np.int32) if settled else (np.int64, np.int32, np.int32, np.uint8, np.int32)
    for kind in kinds:
        out.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    out[0] = np.cumsum(out[0])  # ids travel as differences
    if not settled:
        out.append(np.frombuffer(body, np.uint8, -1, at) if at < len(body) else np.zeros(0, np.uint8))
    return settled, out


def _buckets(data: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The bucket of each packed string: the minimiser of its first window (all its windows share it), computed afresh."""
    out = np.zeros(len(at) - 1, np.int64)
    for lo, hi in slices(at):
        words = Words(data, at[lo : hi + 1], SPACED)
        short, first = runs(words.hashes(), M), words.first[:-1]
        least = short[first]
        for j in range(1, window - M + 1):
            np.minimum(least, short[first + j], out=least)
        out[lo:hi] = least >> U64(32)
    return out


def _repeats(ids, keys, starts, data, at, window: int):
    """Word ranges (id, key, s, e) of windows that an equal window with a smaller id has, among whole buckets."""
    words = Words(data, at, SPACED)
    h = words.hashes()
    first = window_starts(words.first, window)
    if not len(first):
        return None
    wh = runs(h, window)[first]
    row = np.searchsorted(words.first, first, "right") - 1
    owner = ids[row]
    order = np.lexsort((owner, wh))
    sh, so = wh[order], owner[order]
    new = np.ones(len(sh), bool)
    new[1:] = sh[1:] != sh[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(sh)), 0))
    later = np.flatnonzero(so > so[head])
    if not len(later):
        return None
    a, b = order[later], order[head[later]]
    s = words.starts
    size_a, size_b = words.ends[first[a] + window - 1] - s[first[a]], words.ends[first[b] + window - 1] - s[first[b]]
    ok = size_a == size_b
    ok[ok] = same_bytes(words.data, s[first[a[ok]]], s[first[b[ok]]], size_a[ok])
    hit = np.zeros(len(first), bool)
    hit[a[ok]] = True
    for k in np.unique(head[later[~ok]]):  # windows of one hash that differ: settle that hash by the words themselves
        stop = np.searchsorted(sh, sh[k], "right")
        seen: dict[bytes, int] = {}
        for w in order[k:stop]:
            text = words.data[s[first[w]] : words.ends[first[w] + window - 1]].tobytes()
            hit[w] = seen.setdefault(text, int(owner[w])) < owner[w]
    place = starts[row] + (first - words.first[row])
    i = np.flatnonzero(hit)
    row, place = row[i], place[i]
    new = np.ones(len(i), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(i)) - 1
    return ids[row[a]], keys[row[a]], place[a], place[z] + window


def _ranges(ids, keys, s, e) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int32()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["id", "key", "s", "e"])


def repeated_ranges(docs: DataFrame, *, window: int, partitions: int) -> DataFrame:
    """(id, key, s, e): words [s, e) of the row with that id and key go. ``docs`` has (id bigint, key int, text string)."""

    def cut(batches):
        buffer = _Buffer()

        def flush():
            x = buffer.take()
            if x is None:
                return
            settled = _settled(x)
            rows = list(_pack(x, np.flatnonzero(~settled), partitions, np.flatnonzero(settled), window))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["p", "blob"])

        for b in trimmed(batches):
            ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            raw, off = utf8(b.column(2))
            for lo, hi in slices(off):
                buffer.add(raw, off[lo : hi + 1], ids[lo:hi], keys[lo:hi], window)
                if buffer.bytes >= FLUSH_BYTES:
                    yield from flush()
                    release()
        yield from flush()

    def open_blobs(batches):
        empty = np.zeros(0, np.uint8)
        for b in trimmed(batches):
            for blob in b.column(1):
                settled, f = _unpack(blob.as_py())
                if settled:
                    n = len(f[0])
                    arrays = [pa.array(np.full(n, -1), pa.int64()), pa.array(f[0]), pa.array(f[1]), pa.array(f[2]), pa.array(f[3]), binary_array(empty, np.zeros(n + 1, np.int64)).cast(pa.binary())]
                else:
                    at = np.zeros(len(f[4]) + 1, np.int64)
                    np.cumsum(f[4], out=at[1:])
                    arrays = [pa.array(_buckets(f[5], at, window)), pa.array(f[0]), pa.array(f[1]), pa.array(f[2]), pa.array(np.zeros(len(f[0]), np.int32)), binary_array(f[5], at).cast(pa.binary())]
                whole = pa.RecordBatch.from_arrays(arrays, names=["bucket", "id", "key", "s", "e", "words"])
                for i in range(0, whole.num_rows, 8192):
                    yield whole.slice(i, 8192)
            release()

    def settle(batches):
        held, size = [], 0

        def run(table: pa.RecordBatch):
            data, off = utf8(table.column(5))
            got = _repeats(table.column(1).to_numpy(), table.column(2).to_numpy(), table.column(3).to_numpy(), data[int(off[0]) : int(off[-1])], off - off[0], window)
            if got is not None:
                yield _ranges(*got)

        for b in trimmed(batches):
            bucket = b.column(0).to_numpy()
            ready = int(np.searchsorted(bucket, 0))  # settled ranges sort first
            if ready:
                part = b.slice(0, ready)
                yield _ranges(*(part.column(i) for i in range(1, 5)))
                b, bucket = b.slice(ready), bucket[ready:]
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column(5).nbytes
            cut_at = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if size >= CHUNK_BYTES and (cut_at or bucket[-1] != held[0].column(0)[0].as_py()):
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                end = int(np.searchsorted(whole.column(0).to_numpy(), bucket[-1]))
                yield from run(whole.slice(0, end))
                rest = whole.slice(end)
                held, size = ([rest] if rest.num_rows else []), rest.column(5).nbytes if rest.num_rows else 0
        if held:
            yield from run(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    blobs = docs.mapInArrow(cut, "p int, blob binary").repartition(partitions, "p").drop("p").selectExpr("0 as zero", "blob")
    opened = blobs.mapInArrow(open_blobs, "bucket bigint, id bigint, key int, s int, e int, words binary")
    return opened.sortWithinPartitions("bucket").mapInArrow(settle, "id bigint, key int, s int, e int")


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, partitions: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) per row: words of every window that a smaller id has too are taken out.

    Kept words are joined by one space. Null and empty texts have no words. A null id counts as larger than all others and
    comes back null; rows of one id never remove each other's words; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(docs)  # blobs and long texts would fill a batch of 10,000 rows
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULLS_LAST)).alias("id"), F.hash(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    ranges = repeated_ranges(src.select("id", "key", "text"), window=window, partitions=partitions)
    gone = ranges.groupBy("id", "key").agg(F.collect_list(F.struct("s", "e")).alias("gone"))
    joined = src.join(gone, ["id", "key"], "left").select("doc_id", "text", "gone")

    def keep(batches):
        for b in trimmed(batches):
            raw, off = utf8(b.column(1))
            for lo, hi in slices(off):
                words = Words(raw, off[lo : hi + 1], SPACED)
                part = b.column(2).slice(lo, hi - lo)
                n = len(words)
                edge = np.zeros(n + 1, np.int64)
                counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = part.flatten()
                base = np.repeat(words.first[:-1], counts)
                np.add.at(edge, base + flat.field(0).to_numpy(zero_copy_only=False), 1)
                np.add.at(edge, base + flat.field(1).to_numpy(zero_copy_only=False), -1)
                kept = np.cumsum(edge)[:n] == 0
                before = np.concatenate([[0], np.cumsum(kept)])
                left = before[words.first[1:]] - before[words.first[:-1]]
                data, at = words.joined()
                data = data[np.repeat(kept, np.diff(at))]
                size = np.where(kept, np.diff(at), 0)
                stop = np.concatenate([[0], np.cumsum(size)])[words.first]
                whole = data.tobytes()
                texts = [whole[s : max(s, e - 1)].decode() for s, e in zip(stop[:-1], stop[1:])]
                rows = np.diff(words.first)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(rows, pa.int64()), pa.array(rows - left, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(keep, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string")
