"""How the tokens of two tokenizers correspond, with counts of linked id pairs over the whole corpus.

Tokenizer A is byte-level (a file of the tokenizers library), B a sentencepiece model that adds a space before the text. Both
are given the space and the text; tokens are compared by their bytes. Where an A and a B token end at the same byte a group ends; an A
and a B token are linked if their bytes overlap.

1. Each task aligns its documents and packs the distinct linked pairs that it saw, with their numbers, into one row for each of ``SHARDS``
   shards (by hash of the pair).
2. A shard's pairs are united in a tree of tasks, and a minimal perfect hash gives them slots, with the pairs in slot order.
3. Rows of up to 32 tasks at a time are added into a dense vector by slot, and those vectors are summed in a tree: a count for each slot.
4. The highest count of each B id is taken over all shards: a vector as long as B's vocabulary.
5. A second pass aligns the documents again and looks every link up: pair to slot, verified by the pair that is kept there, slot to count.

A lookup needs slots and counts of all pairs in every task. They are broadcast in blocks of whole shards with at most ``block_pairs`` pairs,
one pass over the documents for each block, whatever the number of blocks; a shard has a 256th of the at most
1.6 billion pairs of ids, so 6.3 million at the very most. Both tokenizers end a token before a single space between words and between a letter
and a mark after it, so the pieces between such places are aligned once for each slice of 4 MB, and their ids are kept for later slices.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillmark.llm._perfect_hash import ManyHashes, PerfectHash
from quillmark.llm._pieces import BYTE_LETTERS, Chunks, Kept, cut_bytes, distinct, resting
from quillmark.llm._spark import BATCH_BYTES, bounded_batches, written
from quillmark.llm._vectors import FAN, tree_sum
from quillmark.llm._words import gather, mix, release, slices, trimmed, utf8
from quillmark.llm.bpe import Decoder

SHARDS = 256
BLOCK_PAIRS = 4_000_000
#: Distinct pairs that a task holds before it packs them into rows.
UNIT_PAIRS = 1_000_000
#: A pair is A id x 2^20 + B id.
SHIFT = 20


class Aligner:
    """The ids of both tokenizers for pieces of text that begin with their space, and the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.model = self.a.model
        spec = sentencepiece_model_pb2.ModelProto()
        with open(b_path, "rb") as f:
            spec.ParseFromString(f.read())
        form = spec.normalizer_spec
        # pieces may be encoded on their own if the model leaves texts as they are and knows no token across the cuts
        self.cuts = form.add_dummy_prefix and form.escape_whitespaces and not form.remove_extra_whitespaces and not form.precompiled_charsmap
        self.cuts = self.cuts and not any(p.type == 4 or re.search("[^▁]▁|[A-Za-z][.,;:!?)]", p.piece) for p in spec.pieces)
        form.add_dummy_prefix = form.add_dummy_prefix and not self.cuts
        self.b = SentencePieceProcessor(model_proto=spec.SerializeToString())
        byte = {c: b for b, c in BYTE_LETTERS.items()}
        self.a_table = Decoder(_by_id({i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}))
        self.b_table = Decoder([_piece_bytes(self.b, i) for i in range(self.b.get_piece_size())])
        self.decimals = Decoder([b"%d " % i for i in range(max(len(self.a_table.size), len(self.b_table.size)))])
        self.ids = Kept(self._ask)

    def _ask(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each piece its A and its B ids, 32-bit numbers as bytes."""
        texts = [p.decode() for p in pieces]
        right = self.b.encode(texts if self.cuts else [t[1:] for t in texts], num_threads=1)
        left, others = [None] * len(texts), []
        for i, p in enumerate(pieces):
            if p[0] == 32 and p[1:].isalpha():  # a space and ASCII letters: one pre-token
                left[i] = [t.id for t in self.model.tokenize(BYTE_LETTERS[32] + texts[i][1:])]
            else:
                others.append(i)
        if others:
            for i, e in zip(others, self.a.encode_batch([texts[i] for i in others], add_special_tokens=False)):
                left[i] = e.ids
        return [(array("I", a).tobytes(), array("I", b).tobytes()) for a, b in zip(left, right)]


def _by_id(tokens: dict[int, bytes]) -> list[bytes]:
    return [tokens.get(i, b"") for i in range(max(tokens) + 1)]


def _piece_bytes(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    key = (a_path, b_path)
    if key not in _ALIGNERS:  # once for this Python worker
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


class Slice:
    """Consecutive documents, aligned: the distinct pieces with their tokens and links, and which piece stands where."""

    def __init__(self, align: Aligner, raw: np.ndarray, offsets: np.ndarray):
        c = Chunks(raw, offsets, align.cuts)
        some, self.piece = distinct(c)
        self.align, self.first, self.docs, self.row = align, c.first, len(offsets) - 1, c.rows()
        at, size = c.starts[some], c.ends[some] - c.starts[some]
        ids = align.ids(cut_bytes(c.data, at, at + size))
        whole = np.ones(len(some), bool)
        self.n, tokens, ends = [], [], []
        for side, known in enumerate((align.a_table, align.b_table)):
            own = [x[side] for x in ids]
            n = np.fromiter(map(len, own), np.int64, len(own)) // 4
            t = np.frombuffer(b"".join(own), "<u4").astype(np.int64)
            piece = np.repeat(np.arange(len(n)), n)
            got = np.bincount(piece, known.size[t], len(n)).astype(np.int64)
            whole &= got == size
            tokens.append((t, piece))
            self.n.append(n)
        for (t, piece), known in zip(tokens, (align.a_table, align.b_table)):
            keep = np.flatnonzero(whole)
            t = t[whole[piece]]
            if len(t):
                same = gather(known.data, known.at[t], known.size[t]) == gather(c.data, at[keep], size[keep])
                whole[keep] &= np.logical_and.reduceat(same, np.cumsum(size[keep]) - size[keep])
        self.tokens = [t[whole[piece]] for t, piece in tokens]
        self.n = [np.where(whole, n, 0) for n in self.n]
        size = np.where(whole, size, 0)
        # a document is blank if its only piece is the space before it, and whole if all its pieces are
        blank = (np.diff(self.first) == 1) & (c.ends[self.first[:-1]] - c.starts[self.first[:-1]] == 1) & (np.diff(offsets) == 0)
        self.ok = (np.bincount(self.row[~whole[self.piece]], minlength=self.docs) == 0) & ~blank
        ends = [np.cumsum(known.size[t]) for known, t in zip((align.a_table, align.b_table), self.tokens)]
        cut = np.sort(np.concatenate(ends), kind="stable")
        cut = cut[np.append(True, cut[1:] != cut[:-1])[: len(cut)]]  # a link for each stretch between two cuts
        a, b = (np.searchsorted(e, cut) for e in ends)
        both = (ends[0][a] == cut) & (ends[1][b] == cut)
        self.pairs = self.tokens[0][a] << SHIFT | self.tokens[1][b]
        last = np.searchsorted(cut, np.cumsum(size), "right")
        self.links = np.diff(np.append(0, last))
        self.groups = np.diff(np.append(0, np.append(0, np.cumsum(both))[last]))
        self.group_of = [np.searchsorted(cut[both], e) for e in ends]

    def of_docs(self, per_piece: np.ndarray) -> np.ndarray:
        """The sum over each document's pieces, 0 for documents that aren't whole."""
        total = np.append(0, np.cumsum(per_piece[self.piece]))
        return np.where(self.ok, total[self.first[1:]] - total[self.first[:-1]], 0)

    def of_pieces(self, per_link: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(per_link))
        end = np.cumsum(self.links)
        return total[end] - total[end - self.links]

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of the whole documents, and how many links hold each."""
        times = np.repeat(np.bincount(self.piece[self.ok[self.row]], minlength=len(self.links)), self.links)
        return _summed(self.pairs[times > 0], times[times > 0])

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups, '' for documents that aren't whole."""
        group, side = np.concatenate(self.group_of), np.repeat([0, 1], [len(t) for t in self.tokens])
        order = np.argsort(group * 2 + side, kind="stable")
        token, key = np.concatenate(self.tokens)[order], (group * 2 + side)[order]
        size = self.align.decimals.size[token]
        text = gather(self.align.decimals.data, self.align.decimals.at[token], size)
        end = np.cumsum(size)
        ends_side = np.append(key[1:] != key[:-1], True)[: len(key)]
        text[end - 1] = np.where(ends_side, np.where(key % 2 == 0, ord("|"), ord(";")), ord(","))
        cut = np.append(0, end)[np.append(0, np.cumsum(self.n[0] + self.n[1]))].tolist()
        held = text.tobytes()
        told = [held[a:z] for a, z in zip(cut, cut[1:])]
        piece, first = self.piece.tolist(), self.first.tolist()
        return [hashlib.sha256(b"".join([told[k] for k in piece[a:z]])[:-1]).hexdigest() if ok else "" for a, z, ok in zip(first, first[1:], self.ok.tolist())]


def _summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(pairs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    some, place = np.unique(pairs, return_inverse=True)
    out = np.zeros(len(some), np.int64)
    np.add.at(out, place, counts)
    return some, out


def _shard(pairs: np.ndarray) -> np.ndarray:
    return (mix(pairs.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(40)).astype(np.int64) % SHARDS


def _aligned_slices(batches, column: int, a_path: str, b_path: str):
    """(batch, first row, rows after the last, aligned slice)"""
    with resting():
        align = _aligner(a_path, b_path)
        for b in trimmed(batches):
            raw, off = utf8(b.column(column))
            for lo, hi in slices(off, BATCH_BYTES):
                yield b, lo, hi, Slice(align, raw, off[lo : hi + 1])


def _pair_rows(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(shard, lane, pairs, counts): what each task saw, packed."""
    names = ["shard", "lane", "pairs", "counts"]

    def packed(lane: int, pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        shard = _shard(pairs)
        order = np.argsort(shard, kind="stable")
        some, at = np.unique(shard[order], return_index=True)
        blobs = [[x.tobytes() for x in np.split(v[order], at[1:])] if len(some) else [] for v in (pairs, counts)]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([lane] * len(some), pa.int64()), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())], names=names)

    def run(batches):
        lane, pairs, counts, fresh = TaskContext.get().partitionId(), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        held = 0
        for _, _, _, part in _aligned_slices(batches, 0, a_path, b_path):
            fresh.append(part.counted())
            held += len(fresh[-1][0])
            if held > UNIT_PAIRS // 2:
                pairs, counts = _summed(np.concatenate([pairs, *(x for x, _ in fresh)]), np.concatenate([counts, *(n for _, n in fresh)]))
                fresh, held = [], 0
                if len(pairs) > UNIT_PAIRS:
                    yield packed(lane, pairs, counts)
                    pairs, counts = pairs[:0], counts[:0]
        yield packed(lane, *_summed(np.concatenate([pairs, *(x for x, _ in fresh)]), np.concatenate([counts, *(n for _, n in fresh)])))
        release()

    return texts.mapInArrow(run, "shard int, lane bigint, pairs binary, counts binary")


def _int64(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.int64) for x in column]


def pair_tables(docs: DataFrame, a_path: str, b_path: str, *, text_col: str = "text") -> DataFrame:
    """(shard, n, bits, lengths, pairs, counts): each shard's minimal perfect hash, its pairs and their counts over all documents by slot.

    Null and empty texts, and texts whose bytes a tokenizer changes, count nowhere; an empty table gives no rows.
    """
    bounded_batches(docs)
    texts = docs.select(F.col(text_col).cast("string").alias("t"))
    rows = written(_pair_rows(texts, a_path, b_path), "pair-rows")
    lanes = texts.rdd.getNumPartitions()

    def unite(batch: pa.Table) -> pa.Table:
        some = np.unique(np.concatenate(_int64(batch.column("pairs"))))
        return pa.table({"shard": batch.column("shard")[:1], "lane": batch.column("lane")[:1], "pairs": pa.array([some.tobytes()], pa.binary())})

    keys, left = rows.select("shard", "lane", "pairs"), lanes
    while True:
        keys = keys.select("shard", F.floor(F.col("lane") / FAN).alias("lane"), "pairs").groupBy("shard", "lane").applyInArrow(unite, "shard int, lane bigint, pairs binary")
        left = -(-left // FAN)
        if left <= 1:
            break

    def hashed(batches):
        for b in batches:
            for shard, pairs in zip(b.column(0).to_pylist(), _int64(b.column(1))):
                bits, lengths, order = PerfectHash.build(pairs).dump()
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(pairs)], pa.int64()), *(pa.array([x], pa.binary()) for x in (bits, lengths, order))], names=["shard", "n", "bits", "lengths", "pairs"])

    hashes = written(keys.select("shard", "pairs").mapInArrow(hashed, "shard int, n bigint, bits binary, lengths binary, pairs binary"), "pair-hashes")

    def count(mine: pa.Table, seen: pa.Table) -> pa.Table:
        known = PerfectHash.load(*(mine.column(c)[0].as_py() for c in ("bits", "lengths", "pairs")))
        total = np.zeros(len(known.keys), np.int64)
        pairs, counts = (np.concatenate(_int64(seen.column(c))) for c in ("pairs", "counts"))
        np.add.at(total, known.slots(pairs), counts)
        return pa.table({"slot": mine.column("shard")[:1], "lane": mine.column("lane")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    wide = F.floor(F.col("lane") / FAN).alias("lane")
    spread = hashes.join(rows.select("shard", wide).distinct(), "shard")
    vectors = spread.groupBy("shard", "lane").cogroup(rows.select("shard", wide, "pairs", "counts").groupBy("shard", "lane")).applyInArrow(count, "slot int, lane bigint, counts binary")
    sums = tree_sum(vectors, -(-lanes // FAN)).withColumnRenamed("slot", "shard")
    return written(hashes.join(sums, "shard"), "pair-counts")


def highest(tables: DataFrame, b_size: int) -> np.ndarray:
    """The highest count that a pair of each B id has; as long as B's vocabulary."""

    def run(batches):
        best = np.zeros(b_size, np.int64)
        for b in batches:
            for pairs, counts in zip(_int64(b.column(0)), _int64(b.column(1))):
                np.maximum.at(best, pairs & (1 << SHIFT) - 1, counts)
        used = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(best[used])], names=["b", "n"])

    out = np.zeros(b_size, np.int64)
    found = tables.select("pairs", "counts").mapInArrow(run, "b bigint, n bigint").groupBy("b").agg(F.max("n").alias("n")).toArrow()
    out[found.column("b").to_numpy()] = found.column("n").to_numpy()
    return out


def pair_counts(tables: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best) of every linked pair of ids; ``best``: no A id is linked more often with this B id."""
    one = F.arrays_zip(_numbers("pairs"), _numbers("counts"))
    flat = tables.select(F.explode(one).alias("x")).select(F.col("x.0").alias("pair"), F.col("x.1").alias("n"))
    out = flat.select(F.shiftright("pair", SHIFT).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("b_id"), "n")
    return out.join(out.groupBy("b_id").agg(F.max("n").alias("m")), "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("m")).alias("best"))


def _numbers(name: str):
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<bigint>")
    def read(blobs: pa.Array) -> pa.Array:
        lists = [np.frombuffer(x.as_py(), np.int64) for x in blobs]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in lists])), pa.int32()), pa.array(np.concatenate(lists)))

    return read(F.col(name))


def align_tokens(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    ``n_best``: links whose pair's count is the highest of its B id; ``count_sum``: the sum of the pairs' counts over the links. Null and empty
    texts, and texts whose bytes a tokenizer changes, have zeros and an empty ``groups_sha256``. Repeated rows repeat (and count), other columns are
    ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(docs)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    tables = pair_tables(src, a_path, b_path, text_col="t")
    sizes = {r["shard"]: r["n"] for r in tables.select("shard", "n").collect()}  # a number for each of 256 shards
    best = spark.sparkContext.broadcast(highest(tables, 1 << SHIFT))
    blocks, held = [[]], 0
    for shard, n in sorted(sizes.items()):
        if blocks[-1] and held + n > block_pairs:
            blocks.append([])
            held = 0
        blocks[-1].append(shard)
        held += n
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

    def lookup(shards: list[int], whole: bool) -> DataFrame:
        rows = tables.filter(F.col("shard").isin(shards)).toArrow().to_pylist() if shards else []
        held = spark.sparkContext.broadcast({r["shard"]: (r["bits"], r["lengths"], r["pairs"], r["counts"]) for r in rows})

        def run(batches):
            shards = sorted(held.value)
            known = ManyHashes([held.value[s][:3] for s in shards])
            counts = np.concatenate([np.frombuffer(held.value[s][3], np.int64) for s in shards]) if shards else np.zeros(0, np.int64)
            which = np.full(SHARDS, -1)
            which[shards] = np.arange(len(shards))
            for b, lo, hi, part in _aligned_slices(batches, 2, a_path, b_path):
                pairs, place = np.unique(part.pairs, return_inverse=True)
                at, n = which[_shard(pairs)], np.zeros(len(pairs), np.int64)
                mine = np.flatnonzero(at >= 0)
                slot = known.slots(pairs[mine], at[mine])
                n[mine[slot >= 0]] = counts[slot[slot >= 0]]
                n = n[place]
                top = (n > 0) & (n == best.value[part.pairs & (1 << SHIFT) - 1])
                sums = [part.of_docs(part.of_pieces(top.astype(np.int64))), part.of_docs(part.of_pieces(n))]
                if whole:
                    told = [part.of_docs(x) for x in (*part.n, part.groups, part.links)]
                    digest = part.digests()
                else:
                    told, digest = [np.zeros(hi - lo, np.int64)] * 4, [""] * (hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in told + sums), pa.array(digest, pa.string())], names=names)

        # a row's number is its place in the scan, the same for every block
        return src.select(F.monotonically_increasing_id().alias("row"), "doc_id", "t").mapInArrow(run, schema)

    out = lookup(blocks[0], True)
    if len(blocks) > 1:
        for shards in blocks[1:]:
            out = out.unionByName(lookup(shards, False))
        out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in names[2:-1]), F.max("groups_sha256").alias("groups_sha256"))
    return out.select(names[1:])
