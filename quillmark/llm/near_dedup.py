"""Near duplicates by Order MinHash, verified by banded alignment.

A text's k-mers are its runs of ``K`` words, each labelled with its occurrence number in the text. Each of ``SKETCHES`` hash
functions samples the ``TAKEN`` least labelled k-mers and keeps them in text order, so that equal sketches speak for equal order as
well as equal content. In texts of fewer than ``SHORT`` words one edit can touch every k-mer; they have ``SHORT_SKETCHES`` of single
labelled words as well. Two texts are near duplicates if their edit similarity over words, 1 - distance / longer
length, is ``SIMILARITY`` or more; the distance is computed bit-parallel in the band that this allows, after two exact bounds
that never count more edits than there are: lengths, and runs of two words in common.

Equal texts are one node first (by the hash of their words). Texts with a sketch in common form a bucket. In two rounds the
members of a bucket are compared with one leader, in the second with the text of most links, so that a text and its many copies
meet whatever the copies have in common. What remains is compared pair by pair, except pairs of one class: tiles of
``TILE`` x ``TILE`` members are spread over the tasks, and bags of words and of runs of two words in ``BINS`` bins, which never count more edits than there
are, tell most distant pairs apart without their texts, and a pair of several buckets is told by the least of them. So no bucket is left with an untried pair of two classes. Classes are
the connected components of verified pairs; the first document of a class by id stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from quillmark.llm._spark import bounded_batches, cut_lineage, unused, written
from quillmark.llm._words import SPACED, U64, Words, mix, ragged, runs, slices, trimmed, utf8, window_starts
from quillmark.llm.substring_dedup import _range_hashes

K = 5
SKETCHES = 64
TAKEN = 2
SHORT = 40
SHORT_SKETCHES = 16
SIMILARITY = 0.8
BINS = 1024
COARSE = 128
TILE = 2048
NULLS_LAST = (1 << 63) - 1
_SEEDS = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def labelled_kmers(words: Words, h: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers in text order, and the first of each row; a shorter text is one k-mer."""
    n = np.diff(words.first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1], U64)
    short = np.flatnonzero((n > 0) & (n < k))
    long_at = np.ones(len(out), bool)
    long_at[first[:-1][short]] = False
    out[long_at] = runs(h, k)[window_starts(words.first, k)]
    out[~long_at] = _range_hashes(h, words.first[:-1][short], n[short])
    row = np.repeat(np.arange(len(n)), count)
    own = out ^ mix(row.astype(U64))
    order = np.argsort(own, kind="stable")
    new = np.ones(len(own), bool)
    new[1:] = own[order][1:] != own[order][:-1]
    at = np.arange(len(own))
    times = np.empty(len(own), np.int64)
    times[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(out + times.astype(U64) * U64(0xD1342543DE82EF95)), first


def sketches(x: np.ndarray, first: np.ndarray, count: int = SKETCHES, taken: int = TAKEN) -> np.ndarray:
    """rows x count hashes of the ``taken`` least k-mers in text order; rows must have k-mers."""
    starts, size = first[:-1], np.diff(first)
    out = np.zeros((len(size), count), U64)
    top = U64(0xFFFFFFFFFFFFFFFF)
    low = U64((1 << max(15, int(size.max()).bit_length())) - 1)  # the lowest bits tell the place in the row
    place = ragged(np.zeros(len(size), np.int64), size).astype(U64)
    for j in range(count):
        y = x * _SEEDS[j]
        y &= ~low
        y |= place
        picks: list[np.ndarray] = []
        for _ in range(taken):
            least = np.minimum.reduceat(y, starts)
            one = starts + (least & low).astype(np.int64)
            if picks:
                one = np.where(least == top, picks[-1], one)  # a row of fewer k-mers
            picks.append(one)
            y[one] = top
        order = np.sort(np.stack(picks, 1), 1)
        sketch = np.full(len(size), _SEEDS[j])
        for i in range(taken):
            again = order[:, i] == order[:, i - 1] if i else np.zeros(len(size), bool)
            sketch = np.where(again, sketch, mix(sketch * U64(0x9E3779B97F4A7C15) + x[order[:, i]]))
        out[:, j] = sketch
    return out


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most`` + 1: bit-parallel, in a band of 2 * most + 1 diagonals."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < hi - lo and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    if not m or not n:
        return max(m, n)
    if not most:
        return 1
    most_in = min(most, max(m, n))
    if most_in >= m:  # a band wider than the pattern: turn to rows
        before = list(range(n + 1))
        for i in range(1, m + 1):
            now = [i] + [0] * n
            for j in range(1, n + 1):
                now[j] = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (a[i - 1] != b[j - 1]))
            before = now
        return min(before[n], most + 1)
    width = 2 * most_in + 1
    full = (1 << width) - 1
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    up, down = (full << (width - most_in - 1)) & full, 0  # vertical steps +1 and -1 in the band
    now, top, side = most_in, 1 << (width - 1), 1 << (width - 2)
    give_up = 2 * most_in + n - m
    get = where.get
    for i, w in enumerate(b):
        eq = get(w, 0)
        shift = i - most_in
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        zero = (((eq & up) + up) ^ up | eq | down) & full
        right = (down | ~(zero | up)) & full
        left = zero & up
        if i < m - most_in:
            now += not zero & top
            if now > give_up:
                return most + 1
        else:
            now += bool(right & side) - bool(left & side)
            side >>= 1
        up = (left | ~(zero >> 1 | right)) & full
        down = zero >> 1 & right
    return min(now, most + 1)


def similar(a: list, b: list, similarity: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer + 1e-9)
    return banded_distance(a, b, most) <= most


def bags(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """rows x 2 ``BINS`` counts by hash, 255 at most, of the words and of the runs of two words; and how many of either are beyond that."""
    rows, h = len(words.first) - 1, words.hashes()
    size = np.maximum(np.diff(words.first) - 1, 0)
    parts, beyond = [], []
    for row, x in ((words.rows(), h), (np.repeat(np.arange(rows), size), runs(h, 2)[window_starts(words.first, 2)])):
        full = np.bincount(row * BINS + (x % U64(BINS)).astype(np.int64), minlength=rows * BINS).reshape(rows, BINS)
        parts.append(np.minimum(full, 255))
        beyond.append((full - parts[-1]).sum(1))
    return np.concatenate(parts, 1).astype(np.uint8), np.stack(beyond, 1)


def possible_pairs(n: np.ndarray, root: np.ndarray, bag: np.ndarray, over: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows ``a`` with rows ``b`` of other classes whose lengths and bags allow the similarity: no similar pair is missing.

    Two texts share at most the sum of their bins' lesser counts, the longer has at least as many edits as words beyond those, and
    an edit touches two of its runs of two words at most.
    """
    left, right = [], []
    coarse = bag[:, :BINS].reshape(len(bag), COARSE, BINS // COARSE).sum(2, dtype=np.uint16)
    b = b[np.argsort(n[b], kind="stable")]
    a = a[np.argsort(n[a], kind="stable")]
    for at in range(0, len(a), step):
        x = a[at : at + step]
        lo = np.searchsorted(n[b], int(n[x[0]] * similarity) - 1)
        hi = np.searchsorted(n[b], int(n[x[-1]] / similarity) + 2)
        y = b[lo:hi]
        if not len(y):
            continue
        one, two = np.ascontiguousarray(coarse[x].T), np.ascontiguousarray(coarse[y].T)
        common = np.zeros((len(x), len(y)), np.uint16)
        for i in range(COARSE):
            common += np.minimum(one[i][:, None], two[i])
        longer = np.maximum(n[x][:, None], n[y])
        most = ((1 - similarity) * longer + 1e-9).astype(np.int64)
        ok = (longer - common - np.minimum(over[x, 0][:, None], over[y, 0]) <= most) & (longer - np.minimum(n[x][:, None], n[y]) <= most) & (root[x][:, None] != root[y])
        i, j = np.nonzero(ok)
        most, longer, i, j = most[i, j], longer[i, j], x[i], y[j]
        for s in range(0, len(i), 4096):  # the few that are left, by the fine bins
            p, q = i[s : s + 4096], j[s : s + 4096]
            least, beyond = np.minimum(bag[p], bag[q]), np.minimum(over[p], over[q])
            one, two = (least[:, c : c + BINS].sum(1, dtype=np.int64) + beyond[:, c // BINS] for c in (0, BINS))
            near = (longer[s : s + 4096] - one <= most[s : s + 4096]) & (longer[s : s + 4096] - 1 - two <= 2 * most[s : s + 4096])
            left.append(p[near])
            right.append(q[near])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def sketch_documents(src: DataFrame, *, k: int = K, count: int = SKETCHES, taken: int = TAKEN) -> DataFrame:
    """(doc_id, id, key, node, n, sketch) per row of (doc_id, id, key, text); ``node`` is the hash of the words, null without any."""

    bounded_batches(src)
    def run(batches):
        for b in trimmed(batches):
            raw, off = utf8(b.column(3))
            for lo, hi in slices(off):
                words = Words(raw, off[lo : hi + 1], SPACED)
                n = np.diff(words.first)
                h = words.hashes(double=True)
                told = np.where(n > 0, count, 0) + np.where((n > 0) & (n < SHORT), SHORT_SKETCHES, 0)
                at = np.concatenate([[0], np.cumsum(told)])
                got = np.zeros(at[-1], U64)
                for size, many, from_, rows in ((k, count, 0, np.flatnonzero(n > 0)), (1, SHORT_SKETCHES, count, np.flatnonzero((n > 0) & (n < SHORT)))):
                    if len(rows):
                        x, first = labelled_kmers(words, h, size)
                        kept = np.diff(first)[rows]
                        x = x[ragged(first[:-1][rows], kept)]
                        got[ragged(at[:-1][rows] + from_, np.full(len(rows), many))] = sketches(x, np.append(0, np.cumsum(kept)), many, taken).ravel()
                node = _range_hashes(h, words.first[:-1], n)
                part = b.slice(lo, hi - lo)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(got.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(node.view(np.int64), mask=n == 0), pa.array(n, pa.int64()), lists], names=["doc_id", "id", "key", "node", "n", "sketch"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.select("doc_id", "id", "key", "text").mapInArrow(run, f"doc_id {kind}, id bigint, key int, node bigint, n bigint, sketch array<bigint>")


def _least_neighbours(edges: DataFrame) -> DataFrame:
    """(node, root, links): the least of a node and its neighbours, which is in the same class, and the number of neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"), F.count("*").alias("links")).select("node", F.least("node", "least").alias("root"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of (a, b) edges; the nodes of one component have one root, a node of it.

    Every node takes the least of itself and its neighbours; edges between what they have taken are the next round's graph, until none is left.
    A star ends in one round, and since nodes are hashes a chain shrinks by a constant factor in each.
    """
    now = edges.where("a != b").select("a", "b").distinct()
    found = None
    while True:
        step = cut_lineage(_least_neighbours(now).select("node", "root"))
        if found is None:
            found = step
        else:
            found = cut_lineage(found.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        ends = now.join(step.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        now = cut_lineage(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if now.isEmpty():
            return found


def near_classes(src: DataFrame, *, k: int = K, count: int = SKETCHES, taken: int = TAKEN, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, id, key, n, class_id, class_key, kept) per row of (doc_id, id, key, text)."""
    told = written(sketch_documents(src, k=k, count=count, taken=taken), "sketches")
    place = F.struct("id", "key").alias("place")
    nodes = told.where("node is not null").groupBy("node").agg(F.min(place).alias("place"), F.min_by("n", place).alias("n"), F.min_by("sketch", place).alias("sketch"))
    nodes = written(nodes, "nodes")
    members = nodes.select("node", "n", F.posexplode("sketch").alias("j", "s")).select("node", F.col("n").cast("int").alias("n"), F.xxhash64("j", "s").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x != y").select("bucket")
    active = written(members.join(shared, "bucket", "left_semi"), "buckets")

    touched = active.select("node").distinct().join(nodes.select("node", "place.id", "place.key"), "node")
    texts = src.select("id", "key", "text").join(touched, ["id", "key"]).select("node", "text").dropDuplicates(["node"])
    texts = written(texts, "texts")

    def verify(batches):
        for b in trimmed(batches):
            ok = pa.array(_verified(b.column(2), b.column(3), similarity), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    def compare(pairs):
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        return written(both.select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint"), "links")

    tried = _leader_pairs(active.withColumn("root", F.col("node")).withColumn("links", F.lit(0).cast("bigint")), similarity)
    edges = compare(tried)
    again = _leader_pairs(_with_roots(active, _least_neighbours(edges)), similarity).join(tried, ["a", "b"], "left_anti")
    again = written(again, "pairs")
    tried, edges = tried.unionByName(again), edges.unionByName(compare(again))
    found = components(edges)
    rest = written(_with_roots(active, found), "buckets")
    more = compare(written(_remaining_pairs(rest, texts, similarity).join(tried, ["a", "b"], "left_anti"), "pairs"))
    if not more.isEmpty():
        found = components(more.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    rooted = nodes.select("node", "place").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = rooted.join(rooted.groupBy("root").agg(F.min("place").alias("class")), "root").select("node", "class")
    out = told.drop("sketch").join(classes, "node", "left")
    own = F.coalesce("class", place)
    return out.select("doc_id", "id", "key", "n", own.getField("id").alias("class_id"), own.getField("key").alias("class_key")).withColumn("kept", (F.col("id") == F.col("class_id")) & (F.col("key") == F.col("class_key")))


def _verified(left: pa.Array, right: pa.Array, similarity: float) -> list[bool]:
    """Whether the texts of each pair are similar: bounds by lengths and by labelled runs of two words, then the alignment."""
    sides = []
    for column in (left, right):
        raw, off = utf8(column)
        words = Words(raw, off, SPACED)
        x, first = labelled_kmers(words, words.hashes(), 2)
        data, at = words.joined()
        sides.append((np.diff(words.first), x, first, lambda i, data=data, at=at, f=words.first: data[at[f[i]] : max(at[f[i]], at[f[i + 1]] - 1)].tobytes().split(b" ")))
    (n, x, at_x, text), (m, y, at_y, other) = sides
    longer = np.maximum(n, m)
    most = ((1 - similarity) * longer + 1e-9).astype(np.int64)
    out = []
    for i in range(len(left)):
        ok = longer[i] - min(n[i], m[i]) <= most[i]
        if ok and min(n[i], m[i]) > 1:  # an edit touches two runs of two words at most
            both = np.concatenate([x[at_x[i] : at_x[i + 1]], y[at_y[i] : at_y[i + 1]]])
            both.sort()
            ok = longer[i] - 1 - int((both[1:] == both[:-1]).sum()) <= 2 * most[i]
        out.append(bool(ok) and similar(text(i), other(i), similarity))
    return out


def _leader_pairs(active: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b, of each bucket's leader, the text of most links, with the members of other classes and fitting lengths."""
    first = F.max_by(F.struct("node", "n", "root"), F.struct("links", -F.col("node")))
    leaders = active.groupBy("bucket").agg(first.alias("lead"))
    longer, apart = F.greatest("n", "lead.n"), F.abs(F.col("n") - F.col("lead.n"))
    pairs = active.join(leaders, "bucket").where(F.col("root") != F.col("lead.root")).where(apart <= longer * (1 - similarity) + 1e-9)
    return written(pairs.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct(), "pairs")


def _with_roots(active: DataFrame, found: DataFrame) -> DataFrame:
    """(node, n, bucket, root, links) of the members of buckets that hold two classes."""
    links = "links" if "links" in found.columns else "0L"
    out = active.select("node", "n", "bucket").join(found.select("node", "root", F.expr(links).alias("links")), "node", "left").withColumns({"root": F.coalesce("root", "node"), "links": F.coalesce("links", F.lit(0).cast("bigint"))})
    several = out.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("bucket")
    return out.join(several, "bucket", "left_semi")


def _remaining_pairs(active: DataFrame, texts: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """(a, b) of all members of one bucket and two classes that lengths and bags don't tell apart, a < b."""

    def bagged(batches):
        for b in trimmed(batches):
            raw, off = utf8(b.column(1))
            for lo, hi in slices(off):
                bag, over = bags(Words(raw, off[lo : hi + 1], SPACED))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in bag], pa.binary()), pa.array(over[:, 0]), pa.array(over[:, 1])], names=["node", "bag", "over", "over2"])

    def meet(key, group):
        i, j = key[1].as_py(), key[2].as_py()
        node, n, root, over, over2, chunk = (group[c].to_numpy().astype(np.int64) for c in ("node", "n", "root", "over", "over2", "chunk"))
        bag = np.frombuffer(b"".join(group["bag"].to_pylist()), np.uint8).reshape(-1, 2 * BINS)
        a, b = possible_pairs(n, root, bag, np.stack([over, over2], 1), np.flatnonzero(chunk == i), np.flatnonzero(chunk == j), similarity)
        mine = group["mine"].combine_chunks()
        here = _first_meeting(mine.offsets.to_numpy() - mine.offsets[0].as_py(), mine.flatten().to_numpy(), key[0].as_py(), a, b)
        a, b = node[a[here]], node[b[here]]
        once = (a < b) | (i != j)
        a, b = a[once], b[once]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    some = texts.join(active.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(bagged, "node bigint, bag binary, over bigint, over2 bigint")
    sizes = active.groupBy("bucket").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks"))
    chunked = active.select("node", "n", "bucket", "root").join(sizes, "bucket").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
    dealt = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("node", "n", "root", "bucket", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    buckets = active.groupBy("node").agg(F.sort_array(F.collect_list("bucket")).alias("mine"))  # as many as sketches at most
    return dealt.join(some.join(buckets, "node"), "node").groupBy("bucket", "i", "j").applyInArrow(meet, "a bigint, b bigint").distinct()


def _first_meeting(off: np.ndarray, buckets: np.ndarray, bucket: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows have ``bucket`` as the least bucket in common; a row's buckets are sorted. So each pair is told once."""
    size = np.diff(off)
    left, right = (np.full((len(size), int(size.max(initial=1))), pad, np.int64) for pad in (-(1 << 63), -(1 << 63) + 1))
    row, place = np.repeat(np.arange(len(size)), size), ragged(np.zeros(len(size), np.int64), size)
    left[row, place] = right[row, place] = buckets
    out = np.zeros(len(a), bool)
    for s in range(0, len(a), 2048):
        p, q = left[a[s : s + 2048]], right[b[s : s + 2048]]
        common = (p[:, :, None] == q[:, None, :]).any(2)
        out[s : s + 2048] = p[np.arange(len(p)), common.argmax(1)] == bucket
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULLS_LAST)).alias("id"), F.hash(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, class_id, kept, n_words) per row; ``class_id`` is the least id of the class, and that document is kept.

    Texts without words (null, empty, blank) are alone in their classes and kept. A null id counts as larger than all others (its own
    class id is null). Rows of the same id and text are one document, kept or not together; rows of one id and different
    texts are ordered by a hash. Other columns are ignored.
    """
    found = near_classes(_keyed(docs, id_col, text_col), **options)
    return found.select("doc_id", F.when(F.col("class_id") != NULLS_LAST, F.col("class_id")).alias("class_id"), "kept", F.col("n").alias("n_words"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    names = unused(docs, "id", "key")
    gone = near_classes(_keyed(docs, id_col, text_col), **options).where(~F.col("kept")).select(F.col("id").alias(names[0]), F.col("key").alias(names[1])).distinct()
    keyed = docs.withColumns({names[0]: F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULLS_LAST)), names[1]: F.hash(F.col(text_col))})
    return keyed.join(gone, names, "left_anti").select(*docs.columns)
