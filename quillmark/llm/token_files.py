"""Token ids of all documents in binary files, in the order of their doc_ids.

An id is written as its rank by frequency over the corpus, so that the commonest 256 take one byte. The coding is aligned to bytes:
ranks are little-endian numbers of one to four bytes without a mark of their own, and control bytes stand apart
from them, each with the sizes of four ranks in two bits apiece. Reading looks a control byte up in a table of 256 x 4
sizes; sums of the sizes are the places of the ranks, which are gathered at once.

A data set is a folder:

* ``vocabulary``: Parquet (rank, id, n), every id of the vocabulary, the commonest first, ties by id;
* ``part-<number>-<unique>.ids``: blocks one after another, each with a header of ``HEAD`` (magic, CRC-32 of the rest, documents, ids, control
  bytes, rank bytes), the doc_ids (8 bytes each), a byte for each that is 1 where the doc_id is null, the numbers of ids (8 bytes each), control
  bytes (a document begins with a new one) and rank bytes;
* ``index``: Parquet, a row for each block (part, file, place, size, n_docs, n_ids, before: ids of the part before it);
* ``parts``: Parquet (part, start: ids of all parts before it).

A task that is run twice writes two files; only the one whose index rows Spark commits is ever read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm._pieces import BYTE_LETTERS, Kept, Marked, cut_bytes, distinct, resting
from quillmark.llm._spark import BATCH_BYTES, bounded_batches, shared_dir
from quillmark.llm._vectors import tree_sum
from quillmark.llm._words import ragged, release, slices, trimmed, utf8

MAGIC = b"QIDS"
HEAD = "<4sIQQQQ"
HEAD_BYTES = struct.calcsize(HEAD)
BLOCK_IDS = 1 << 19
FILE_BYTES = 128 << 20
#: Sizes of the four ranks of each control byte, the lowest bits first.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def opened(path: str):
    """(file system, path) for Python tasks, from a path with a scheme that Spark uses."""
    import pyarrow.fs

    if path.startswith(("s3a://", "s3n://")):
        path = "s3" + path[3:]
    return pyarrow.fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Hadoop resolves it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def pack(ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and rank bytes of documents of ``sizes`` ranks each, one after another."""
    small = ranks.astype("<u4")
    width = 1 + (small > 0xFF).astype(np.uint8) + (small > 0xFFFF) + (small > 0xFFFFFF)
    quads = (sizes + 3) // 4
    code = np.zeros(4 * int(quads.sum()), np.uint8)
    code[ragged(4 * (np.cumsum(quads) - quads), sizes)] = width - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    return control, small.view(np.uint8).reshape(-1, 4)[np.arange(4) < width[:, None]]


def unpack(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranks that ``pack`` has packed."""
    quads = (sizes + 3) // 4
    width = SIZES[control].reshape(-1)[ragged(4 * (np.cumsum(quads) - quads), sizes)]
    at = np.cumsum(width, dtype=np.int64) - width
    out = data[at].astype(np.uint32)
    for k in range(1, int(width.max(initial=1))):
        more = np.flatnonzero(width > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: Letters that are one character in every form and have one lower case: ASCII and Latin ones below U+0250 but for U+0130.
_LATIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?)]*)")


class WordIds(Kept):
    """The ids of words between white space (32-bit numbers as bytes), as the tokenizers library has them.

    Words of Latin letters go straight to the library's model, in the letters of byte-level vocabularies; the marks after them and all other words take the
    library's whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        super().__init__(self._ask, 200_000)

    def _ask(self, words: list[bytes]) -> list[bytes]:
        out, others = [b""] * len(words), []
        for i, word in enumerate(words):
            if word.isalpha():  # ASCII letters, and lower ones (``Marked``) unless asked for otherwise
                out[i] = array("I", [t.id for t in self.model.tokenize(word.decode().lower())]).tobytes()
                continue
            latin = _LATIN.fullmatch(word.decode())
            if latin is None or (latin[2] and len(latin[2]) == len(word)):
                others.append(i)
                continue
            letters = latin[1].lower()
            if not letters.isascii():
                letters = "".join([BYTE_LETTERS[b] for b in letters.encode()])
            ids = [t.id for t in self.model.tokenize(letters)]
            out[i] = array("I", ids).tobytes()
            if latin[2]:
                out[i] += self([latin[2].encode()])[0]
        if others:
            for i, e in zip(others, self.whole.encode_batch([words[i].decode() for i in others], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
        return out


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORD_IDS:  # once for this Python worker
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def encode_words(docs: DataFrame, path: str, *, end_id: int | None = None, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, n bigint, ids binary: little-endian numbers of ``width`` bytes) of each row, as the tokenizers library encodes the whole text
    without adding special tokens, and ``end_id`` after it.

    The tokenizer has to treat words between ASCII white space one by one (a splitting pattern that drops white space, as
    ``word_bpe_49k.json`` has, after lowering letters): each distinct word is encoded once. Null and empty texts have only the end id;
    repeated rows repeat, other columns are ignored, an empty table gives no rows. A doc_id that is no integer is refused.
    """
    _integer(docs, id_col)
    bounded_batches(docs)

    def run(batches):
        ids_of = word_ids(path)
        end = [struct.pack("<I", end_id) if end_id is not None else b""]
        with resting():
            for b in trimmed(batches):
                raw, off = utf8(b.column(1))
                for lo, hi in slices(off, BATCH_BYTES):
                    w = Marked(raw, off[lo : hi + 1])
                    some, piece = distinct(w)
                    lists = ids_of(cut_bytes(w.data, w.starts[some], w.ends[some])) + end
                    count = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
                    at, flat = np.cumsum(count) - count, np.frombuffer(b"".join(lists), "<u4")
                    seen = np.insert(piece, w.first[1:], len(some))  # the end id as a last word
                    ids = flat[ragged(at[seen], count[seen])].astype(f"<u{width}")
                    upto = np.cumsum(np.append(0, count[seen]))[np.append(0, w.first[1:] + np.arange(1, hi - lo + 1))]
                    buffer = pa.py_buffer(ids.tobytes())
                    out = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((width * upto).astype(np.int64)), buffer]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(upto)), out], names=["doc_id", "n", "ids"])

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, "doc_id bigint, n bigint, ids binary")


def _integer(df: DataFrame, name: str) -> None:
    if df.schema[name].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{name} must be an integer column")


def id_counts(encoded: DataFrame, vocab_size: int, width: int, lanes: int) -> np.ndarray:
    """How often each id of the vocabulary occurs: a dense vector in each task, summed in a tree, so its size is the vocabulary's."""

    def count(batches):
        total = np.zeros(vocab_size, np.int64)
        for b in batches:
            raw, off = utf8(b.column(0))
            total += np.bincount(raw[off[0] : off[-1]].view(f"<u{width}"), minlength=vocab_size)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slot", "lane", "counts"])

    rows = tree_sum(encoded.select("ids").mapInArrow(count, "slot int, lane bigint, counts binary"), lanes).collect()
    return np.frombuffer(rows[0]["counts"], np.int64) if rows else np.zeros(vocab_size, np.int64)


def write_token_files(docs: DataFrame, path: str, out: str, *, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, block_ids: int = BLOCK_IDS) -> None:
    """Encodes the texts and writes the data set ``out`` (see the module), a folder that driver and executors share.

    Documents come in ascending doc_id order, nulls first; rows of one doc_id by their number of ids, then by their ids' CRC-32. Texts are
    encoded once, the ids kept in the shared folder until they are counted and sorted. A range of doc_ids is a file; one doc_id with very many rows
    is spread over several. An empty table gives a data set without blocks.
    """
    spark = docs.sparkSession
    out = qualified(spark, out)
    size = word_ids(path).size
    kept = shared_dir(spark, "token-ids")
    width = 2 if size <= 1 << 16 else 4
    encode_words(docs, path, end_id=end_id, width=width, id_col=id_col, text_col=text_col).write.option("compression", "zstd").parquet(kept)
    encoded = spark.read.parquet(kept)
    counts = id_counts(encoded, size, width, encoded.rdd.getNumPartitions())
    order = np.lexsort((np.arange(size), -counts))
    rank_of = np.empty(size, np.uint32)
    rank_of[order] = np.arange(size, dtype=np.uint32)
    spark.createDataFrame(pa.table({"rank": np.arange(size), "id": order, "n": counts[order]})).coalesce(1).write.parquet(f"{out}/vocabulary")
    ranks = spark.sparkContext.broadcast(rank_of)  # as large as the vocabulary

    def block(part: int, stream, name: str, place: int, before: int, ids: list[pa.Array], lists: list[pa.Array]):
        doc = pa.concat_arrays(ids)
        raw, off = utf8(pa.concat_arrays(lists))
        sizes = np.diff(off) // width
        control, data = pack(ranks.value[raw[off[0] : off[-1]].view(f"<u{width}")], sizes)
        body = b"".join((doc.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), doc.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), sizes.astype("<i8").tobytes(), control.tobytes(), data.tobytes()))
        stream.write(struct.pack(HEAD, MAGIC, zlib.crc32(body), len(doc), int(sizes.sum()), len(control), len(data)))
        stream.write(body)
        return part, name, place, HEAD_BYTES + len(body), len(doc), int(sizes.sum()), before

    schema = "part int, file string, place bigint, size bigint, n_docs bigint, n_ids bigint, before bigint"
    types = pa.schema([("part", pa.int32()), ("file", pa.string()), *((n, pa.int64()) for n in ("place", "size", "n_docs", "n_ids", "before"))])

    def write(batches):
        part, stream, rows = TaskContext.get().partitionId(), None, []
        name, place, before, ids, lists, held = f"part-{part:06d}-{uuid.uuid4().hex}.ids", 0, 0, [], [], 0
        for b in trimmed(batches):
            ends = np.cumsum(b.column(1).to_numpy())
            a = 0
            while a < b.num_rows:
                done = int(ends[a - 1]) if a else 0
                z = min(b.num_rows, 1 + int(np.searchsorted(ends, done + block_ids - held)))  # a block ends with the document that fills it
                ids.append(b.column(0).slice(a, z - a))
                lists.append(b.column(2).slice(a, z - a))
                held += int(ends[z - 1]) - done
                a = z
                if held >= block_ids:
                    if stream is None:
                        stream = _file(out, name)
                    rows.append(block(part, stream, name, place, before, ids, lists))
                    place, before, ids, lists, held = place + rows[-1][3], before + rows[-1][5], [], [], 0
        if ids:
            if stream is None:
                stream = _file(out, name)
            rows.append(block(part, stream, name, place, before, ids, lists))
        if stream is not None:
            stream.close()
        release()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)] if rows else [pa.array([], t) for t in types.types], schema=types)

    total = encoded.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // file_bytes))
    keys = ("doc_id", "n", "_crc", "_row")
    dealt = encoded.select("doc_id", "n", "ids", F.crc32("ids").alias("_crc"), F.monotonically_increasing_id().alias("_row")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt.select("doc_id", "n", "ids").mapInArrow(write, schema).write.parquet(f"{out}/index")
    sums = spark.read.parquet(f"{out}/index").groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a number for each file
    starts = np.cumsum([0] + [r["n"] for r in sums])
    spark.createDataFrame([(r["part"], int(s)) for r, s in zip(sums, starts)], "part int, start bigint").coalesce(1).write.parquet(f"{out}/parts")


def _file(folder: str, name: str):
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}")


def read_blocks(spark: SparkSession, path: str, take, schema: str) -> DataFrame:
    """What ``take(doc_ids, starts, sizes, ids)`` makes of each block, as Arrow batches of ``schema``."""
    path = qualified(spark, path)
    words = spark.read.parquet(f"{path}/vocabulary").orderBy("rank").select("id").toArrow().column(0)  # as large as the vocabulary
    ids_of = spark.sparkContext.broadcast(words.to_numpy().astype(np.uint32))
    index = spark.read.parquet(f"{path}/index")

    def run(batches):
        name = stream = None
        for b in batches:
            for row in b.to_pylist():
                if row["file"] != name:
                    name, (system, folder) = row["file"], opened(path)
                    stream = system.open_input_file(f"{folder}/{name}")
                data = stream.read_at(row["size"], row["place"])
                magic, crc, docs, ids, n_control, n_data = struct.unpack_from(HEAD, data)
                if magic != MAGIC or zlib.crc32(memoryview(data)[HEAD_BYTES :]) != crc or len(data) != HEAD_BYTES + 17 * docs + n_control + n_data:
                    raise ValueError(f"damaged block at {row['place']} of {name}")
                at = HEAD_BYTES + 9 * docs
                null = np.frombuffer(data, np.uint8, docs, HEAD_BYTES + 8 * docs).astype(bool)
                doc = pa.array(np.frombuffer(data, "<i8", docs, HEAD_BYTES), pa.int64(), mask=null)
                sizes = np.frombuffer(data, "<i8", docs, at)
                at += 8 * docs
                values = unpack(np.frombuffer(data, np.uint8, n_control, at), np.frombuffer(data, np.uint8, n_data, at + n_control), sizes)
                yield take(doc, row["start"] + row["before"] + np.cumsum(sizes) - sizes, sizes, ids_of.value[values])
                del data, values
        release()

    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), index.rdd.getNumPartitions())
    return index.join(spark.read.parquet(f"{path}/parts"), "part").repartition(spread, "file", "place").sortWithinPartitions("file", "place").mapInArrow(run, schema)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of every document of a data set; a damaged block raises."""

    def take(doc, starts, sizes, ids):
        off = np.append(0, np.cumsum(sizes)).astype(np.int32)
        return pa.RecordBatch.from_arrays([doc, pa.array(starts), pa.array(sizes), pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32)))], names=["doc_id", "start", "n_tokens", "ids"])

    return read_blocks(spark, path, take, "doc_id bigint, start bigint, n_tokens bigint, ids array<int>")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a data set, read from its files."""

    def take(doc, starts, sizes, ids):
        raw, end = memoryview(ids.astype("<u4").tobytes()), 4 * np.cumsum(sizes)
        crc = [zlib.crc32(raw[z - 4 * n : z]) for z, n in zip(end.tolist(), sizes.tolist())]
        return pa.RecordBatch.from_arrays([doc, pa.array(starts), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_blocks(spark, path, take, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_ids(docs: DataFrame, path: str, *, end_id: int | None = 2) -> DataFrame:
    """Writes the documents' ids as a data set in the shared folder and reads it back: (doc_id, start, n_tokens, ids_crc32)."""
    out = shared_dir(docs.sparkSession, "token-files")
    write_token_files(docs, path, out, end_id=end_id)
    return token_digest(docs.sparkSession, out)
