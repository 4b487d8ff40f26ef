"""Line dedup by a deletion-neighbourhood join.

The edit distance is counted in words. A line goes if an earlier line, by (document id, line number), has the same words or, when
both have at least ``min_edit_words`` words, differs by one word put in, left out or replaced (so 0.8 or more of
the words agree). Lines of fewer than ``min_words`` words, blank ones among them, always stay, and kept lines stay as they are.

The lines of ``UNIT_BYTES`` of text meet in their task first, so that a line, a half or a variant that everyone shares travels
once for each unit and not once for each document. Equal lines (128 bits of hash) then meet in one sort, where all but the first
go. For the rest, every distinct line tells hashes of the halves of which one must be untouched by a single edit; only lines that share a
half with another line emit their neighbourhood: the line without its i-th word, for all i, as hashed keys. Equal variants with
equal i are one replacement apart, a variant equal to a whole line is one word longer. The variants are sorted once, and reading
them in order holds one row of a group at a time, however large it is. The edit distance of the two texts is verified
before a line goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from quillmark.llm._spark import bounded_batches, unused, written
from quillmark.llm._words import SPACED, U64, Words, mix, ragged, slices, trimmed, utf8
from quillmark.llm.substring_dedup import _range_hashes

MIN_WORDS = 3
MIN_EDIT_WORDS = 5
UNIT_BYTES = 8_000_000
NULLS_LAST = (1 << 63) - 1
PLACE = ["id", "key", "line"]
_SECOND = U64(0xA24BAED4963EE407)
_STEP = 0x2545F4914F6CDD1D  # as in _range_hashes


def line_words(raw: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words by line, and the row and the number of each line; lines end at line feeds."""
    feeds = np.flatnonzero(raw[off[0] : off[-1]] == 10) + off[0]
    before = np.searchsorted(feeds, off)
    count = np.diff(before) + 1
    first = before[:-1] + np.arange(len(count))  # each row's first line
    starts = np.empty(int(count.sum()), np.int64)
    later = np.ones(len(starts), bool)
    later[first] = False
    starts[first], starts[later] = off[:-1], feeds + 1
    return Words(raw, np.append(starts, off[-1]), SPACED), np.repeat(np.arange(len(count)), count), ragged(np.zeros(len(count), np.int64), count)


def _halves(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Four keys: first and last half as a line of n words, and as the longer of a pair whose shorter line has n - 1."""
    out = []
    for c in (n, n - 1):
        half = c // 2
        out.append(mix(_range_hashes(h, first, half) ^ c.astype(U64) * U64(0x9E3779B97F4A7C15)))
        out.append(mix(_range_hashes(h, first + n - (c - half), c - half) ^ c.astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
    return np.stack(out, 1) if len(n) else np.zeros((0, 4), U64)


def neighbourhoods(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word of each line the hash of the line without it, as ``_range_hashes`` would give for the shorter line."""
    n = np.diff(first)
    inverse = pow(_STEP, -1, 1 << 64)
    power = np.cumprod(np.concatenate([[U64(1)], np.full(len(h), U64(_STEP))]), dtype=U64)
    back = np.cumprod(np.concatenate([[U64(1)], np.full(len(h), U64(inverse))]), dtype=U64)
    c = np.concatenate([[U64(0)], np.cumsum(h * power[: len(h)], dtype=U64)])
    s, e = np.repeat(first[:-1], n), np.repeat(first[1:], n)
    return mix(((c[:-1] - c[s]) + (c[e] - c[1:]) * U64(inverse)) * back[s] ^ (np.repeat(n, n) - 1).astype(U64))


def word_edits(a: list, b: list, most: int = 1) -> int:
    """Edit distance in words if it is at most ``most``, else ``most`` + 1; only the band around the diagonal is looked at."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo, same = 0, min(len(a), len(b))
    while lo < same and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < same - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    if not a or not b:
        return max(len(a), len(b))
    before = {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            now[j] = i if j == 0 else min(before.get(j, most + 1) + 1, now.get(j - 1, most + 1) + 1, before.get(j - 1, most + 1) + (a[i - 1] != b[j - 1]))
        if min(now.values()) > most:
            return most + 1
        before = now
    return min(before.get(len(b), most + 1), most + 1)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """For each place of sorted keys the place where its group starts."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


class _Unit:
    """The lines of ``UNIT_BYTES`` of text: one row for each distinct line, and the places of those that repeat it."""

    def __init__(self):
        self.parts, self.bytes = [], 0

    def add(self, raw, off, ids, keys, min_words: int, min_edit: int) -> None:
        words, row, line = line_words(raw, off)
        self.bytes += int(off[-1] - off[0])
        h = words.hashes(double=True)
        n = np.diff(words.first)
        i = np.flatnonzero(n >= min_words)
        far = n[i] >= min_edit
        halves = np.zeros((len(i), 4), U64)
        halves[far] = _halves(h, words.first[:-1][i[far]], n[i[far]])
        first = words.first[:-1][i]
        self.parts.append((_range_hashes(h, first, n[i]), _range_hashes(mix(h ^ _SECOND), first, n[i]), ids[row[i]], keys[row[i]], line[i], far, halves))

    def rows(self) -> pa.RecordBatch:
        h, g, ids, keys, line, far, halves = (np.concatenate([p[k] for p in self.parts]) for k in range(7))
        order = np.lexsort((line, keys, ids, g, h))
        h, g, ids, keys, line, far, halves = (x[order] for x in (h, g, ids, keys, line, far, halves))
        head = _heads(h, g) if len(h) else np.zeros(0, np.int64)
        at = np.arange(len(h))
        again = (ids != ids[head]) | (keys != keys[head]) | (line != line[head])  # a document that is read twice doesn't repeat itself
        one = np.flatnonzero(at == head)
        # of the lines with a half in common, the first tells it; all of them are flagged
        flat, whose = halves[one][far[one]].ravel(), np.repeat(one[far[one]], 4)
        order = np.lexsort((line[whose], keys[whose], ids[whose], flat))
        start = _heads(flat[order]) if len(order) else np.zeros(0, np.int64)
        leads = np.zeros(len(flat), bool)
        leads[order[start == np.arange(len(order))]] = True
        other = whose[order] != whose[order[start]] if len(order) else np.zeros(0, bool)
        flag = np.zeros(len(h), bool)
        flag[whose[order[other]]] = True
        flag[whose[order[start[other]]]] = True
        told = np.zeros((len(h), 4), bool)
        told[one[far[one]]] = leads.reshape(-1, 4)
        rest = np.flatnonzero(again)
        i = np.concatenate([one, rest])
        gone = np.repeat([False, True], [len(one), len(rest)])
        h, g = h[i].copy(), g[i].copy()
        h[gone] = mix(ids[rest].astype(U64) * _SECOND + (keys[rest].astype(np.int64).astype(U64) << U64(32)) + line[rest].astype(U64))  # spread: nothing is looked for
        columns = [pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(ids[i]), pa.array(keys[i], pa.int32()), pa.array(line[i], pa.int32()), pa.array(gone), pa.array(flag[i])]
        columns += [pa.array(halves[i, k].view(np.int64), mask=~told[i, k]) for k in range(4)]
        return pa.RecordBatch.from_arrays(columns, names=["h", "g", "id", "key", "line", "gone", "flag", "k0", "k1", "k2", "k3"])


def _lines(src: DataFrame, min_words: int, min_edit: int) -> DataFrame:
    """(h, g, id, key, line, gone, flag, k0..k3) per distinct line of a unit, and per place that repeats one of them (gone)."""

    def scan(batches):
        unit = _Unit()
        for b in trimmed(batches):
            ids, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            raw, off = utf8(b.column(2))
            for lo, hi in slices(off):
                unit.add(raw, off[lo : hi + 1], ids[lo:hi], keys[lo:hi], min_words, min_edit)
                if unit.bytes >= UNIT_BYTES:
                    yield unit.rows()
                    unit = _Unit()
        if unit.parts:
            yield unit.rows()

    return src.mapInArrow(scan, "h bigint, g bigint, id bigint, key int, line int, gone boolean, flag boolean, k0 bigint, k1 bigint, k2 bigint, k3 bigint")


def _shared_halves(batches):
    """(id, key, line) of lines that share ``k`` with another line, from rows sorted by ``k``; only the first row of a group is held."""
    last = None
    for b in trimmed(batches):
        k, ids, keys, line = (b.column(c).to_numpy() for c in range(4))
        if last is not None:
            k, ids, keys, line = (np.concatenate([x[None], y]) for x, y in zip(last, (k, ids, keys, line)))
        if not len(k):
            continue
        head = _heads(k)
        other = np.flatnonzero((ids != ids[head]) | (keys != keys[head]) | (line != line[head]))
        i = np.union1d(other, head[other])
        end = head[-1]
        last = k[end], ids[end], keys[end], line[end]
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(keys[i], pa.int32()), pa.array(line[i], pa.int32())], names=PLACE)


_VARIANT = ["v", "w", "i", *PLACE, "id2", "key2", "line2"]


def _vary(batches):
    """Variants of lines as (v, w, i, place), i = -1 the whole line, and pairs of a line with an earlier one of the same slice that has an equal variant."""
    for b in trimmed(batches):
        ids, keys, line = (b.column(c).to_numpy() for c in range(3))
        raw, off = utf8(b.column(3))
        for lo, hi in slices(off, 400_000):
            words = Words(raw, off[lo : hi + 1], SPACED)
            h = words.hashes(double=True)
            n, first = np.diff(words.first), words.first
            hashes = []
            for x in (h, mix(h ^ _SECOND)):
                hashes.append(np.concatenate([_range_hashes(x, first[:-1], n), neighbourhoods(x, first)]))
            v, w = hashes
            i = np.concatenate([np.full(len(n), -1), np.arange(len(h)) - np.repeat(first[:-1], n)])
            row = np.concatenate([np.arange(len(n)), np.repeat(np.arange(len(n)), n)]) + lo
            rank = np.empty(b.num_rows, np.int64)
            rank[np.lexsort((line, keys, ids))] = np.arange(b.num_rows)
            order = np.lexsort((rank[row], i, w, v))
            v, w, i, row = v[order], w[order], i[order], row[order]
            head = _heads(v, w, i) if len(v) else np.zeros(0, np.int64)
            pair = row != row[head]
            one = np.flatnonzero(head == np.arange(len(head)))
            two = np.flatnonzero(pair)
            least = np.unique(np.stack([row[two], row[head[two]]], 1), axis=0) if len(two) else np.zeros((0, 2), np.int64)
            at = np.concatenate([row[one], least[:, 0]])
            none = np.repeat([True, False], [len(one), len(least)])
            by = np.concatenate([np.zeros(len(one), np.int64), least[:, 1]])
            spread = mix(ids[least[:, 0]].astype(U64) * _SECOND + line[least[:, 0]].astype(U64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([v[one], spread]).view(np.int64)), pa.array(np.concatenate([w[one], spread]).view(np.int64)), pa.array(np.concatenate([i[one], np.full(len(least), -2)]), pa.int32())]
                + [pa.array(ids[at]), pa.array(keys[at], pa.int32()), pa.array(line[at], pa.int32())]
                + [pa.array(ids[by], mask=none), pa.array(keys[by], pa.int32(), mask=none), pa.array(line[by], pa.int32(), mask=none)],
                names=_VARIANT,
            )


def _meet(batches):
    """(place, place2) of lines with an earlier line of an equal variant, from variants sorted by (v, w, i, place).

    Of a group that goes on in the next batch, the whole line and the first variant with the last i are held.
    """
    last = None
    for b in trimmed(batches):
        if not b.num_rows:
            continue
        told = b.filter(pa.array(b.column(2).to_numpy() == -2))
        x = [b.column(c).filter(pa.array(b.column(2).to_numpy() != -2)).to_numpy() for c in range(6)]
        if last is not None:
            x = [np.concatenate([p, y]) for p, y in zip(last, x)]
        out = [told.column(c) for c in range(3, 9)]
        if len(x[0]):
            v, w, i, ids, keys, line = x
            group, same = _heads(v, w), _heads(v, w, i)
            at = np.arange(len(v))
            later = lambda p, q: (ids[p] > ids[q]) | (ids[p] == ids[q]) & ((keys[p] > keys[q]) | (keys[p] == keys[q]) & (line[p] > line[q]))
            a = np.flatnonzero((at != same) & (i >= 0))
            c = np.flatnonzero((i[group] == -1) & (i >= 0))
            left, right = np.concatenate([a, c, group[c]]), np.concatenate([same[a], group[c], c])
            ok = later(left, right)
            left, right = left[ok], right[ok]
            out = [pa.concat_arrays([p, pa.array(q, p.type)]) for p, q in zip(out, (ids[left], keys[left], line[left], ids[right], keys[right], line[right]))]
            hold = np.unique([group[-1], same[-1]]) if i[group[-1]] == -1 else same[-1:]
            last = [y[hold] for y in x]
        yield pa.RecordBatch.from_arrays(out, names=[*PLACE, "id2", "key2", "line2"])


def _verify(batches):
    for b in trimmed(batches):
        pairs = []
        for c in (3, 4):
            raw, off = utf8(b.column(c))
            words = Words(raw, off, SPACED)
            parts = [words.data[s:e].tobytes() for s, e in zip(words.starts, words.ends)]
            pairs.append([parts[s:e] for s, e in zip(words.first[:-1], words.first[1:])])
        ok = pa.array([word_edits(x, y) <= 1 for x, y in zip(*pairs)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in range(3)], names=PLACE)


def gone_lines(src: DataFrame, *, min_words: int = MIN_WORDS, min_edit_words: int = MIN_EDIT_WORDS) -> DataFrame:
    """(id, key, line) of every line that goes; ``src`` has (id bigint, key int, text string)."""
    bounded_batches(src)
    equal = Window.partitionBy("h", "g", "gone")
    lines = _lines(src, min_words, min_edit_words)
    first = (F.rank().over(equal.orderBy(*PLACE)) == 1) & ~F.col("gone")
    lines = written(lines.select(*PLACE, (~first).alias("gone"), F.max("flag").over(equal).alias("flag"), *(F.when(first, F.col(k)).alias(k) for k in ("k0", "k1", "k2", "k3"))), "lines")

    halves = lines.where("not gone").select(F.explode(F.array("k0", "k1", "k2", "k3")).alias("k"), *PLACE).where("k is not null")
    shared = halves.repartition("k").sortWithinPartitions("k").mapInArrow(_shared_halves, "id bigint, key int, line int")
    wanted = lines.where("flag and not gone").select(*PLACE).unionByName(shared).groupBy("id", "key").agg(F.collect_set("line").alias("want"))

    def pick(batches):
        for b in trimmed(batches):
            for ident, key, text, want in zip(*(b.column(i).to_pylist() for i in range(4))):
                every, want = text.split("\n"), sorted(want)
                yield pa.RecordBatch.from_arrays([pa.array([ident] * len(want), pa.int64()), pa.array([key] * len(want), pa.int32()), pa.array(want, pa.int32()), pa.array([every[k] for k in want], pa.string())], names=[*PLACE, "text"])

    joined = src.join(wanted, ["id", "key"]).select("id", "key", "text", "want")
    texts = written(joined.mapInArrow(pick, "id bigint, key int, line int, text string").dropDuplicates(PLACE), "flagged")

    variants = texts.mapInArrow(_vary, "v bigint, w bigint, i int, id bigint, key int, line int, id2 bigint, key2 int, line2 int")
    met = variants.repartition("v", "w").sortWithinPartitions("v", "w", "i", *PLACE).mapInArrow(_meet, "id bigint, key int, line int, id2 bigint, key2 int, line2 int")
    partner = met.groupBy(*PLACE).agg(F.min(F.struct("id2", "key2", "line2")).alias("by")).select(*PLACE, "by.*")
    pairs = partner.join(texts, PLACE).join(texts.select(F.col("id").alias("id2"), F.col("key").alias("key2"), F.col("line").alias("line2"), F.col("text").alias("text2")), ["id2", "key2", "line2"])
    near = pairs.select(*PLACE, "text", "text2").mapInArrow(_verify, "id bigint, key int, line int")
    return lines.where("gone").select(*PLACE).unionByName(near)


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_edit_words: int = MIN_EDIT_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) per row, ``text`` without the lines that go.

    A null text counts as empty: one blank line, which stays, and comes back as the empty text. A null id counts as larger than all
    others. Equal lines of one document: the first stays. Repeated rows (same id and text) are one document and
    get one result each. Rows of one id but different texts are ordered by a hash. Other columns are ignored.
    """
    bounded_batches(docs)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULLS_LAST)).alias("id"), F.hash(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    gone = gone_lines(src.select("id", "key", "text"), min_words=min_words, min_edit_words=min_edit_words)
    per = gone.groupBy("id", "key").agg(F.collect_set("line").alias("gone"))
    joined = src.join(per, ["id", "key"], "left")

    def keep(batches):
        for b in trimmed(batches):
            n, out, texts = [], [], []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                n.append(text.count("\n") + 1)
                out.append(len(gone or ()))
                if gone:
                    drop = set(gone)
                    text = "\n".join([x for i, x in enumerate(text.split("\n")) if i not in drop])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(out, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_removed", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.select("doc_id", "text", "gone").mapInArrow(keep, f"doc_id {kind}, n_lines bigint, n_removed bigint, text string")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, min_words: int = MIN_WORDS, min_edit_words: int = MIN_EDIT_WORDS) -> DataFrame:
    """``docs`` with the lines taken out of the text column, every row kept; ``size_col`` becomes the number of characters left.

    Texts without lines that go stay as they are, null ones too; other cases as for ``line_dedup``.
    """
    bounded_batches(docs)
    names = unused(docs, "id", "key", "gone")
    keyed = docs.withColumns({names[0]: F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULLS_LAST)), names[1]: F.hash(F.col(text_col))})
    src = keyed.select(F.col(names[0]).alias("id"), F.col(names[1]).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    gone = gone_lines(src, min_words=min_words, min_edit_words=min_edit_words)
    per = gone.groupBy(F.col("id").alias(names[0]), F.col("key").alias(names[1])).agg(F.collect_set("line").alias(names[2]))
    joined = keyed.join(per, names[:2], "left").select(*docs.columns, names[2])
    at, names = docs.columns.index(text_col), docs.columns

    def keep(batches):
        for b in trimmed(batches):
            texts = b.column(at).to_pylist()
            for i, gone in enumerate(b.column(len(names)).to_pylist()):
                if gone:
                    drop = set(gone)
                    texts[i] = "\n".join([x for k, x in enumerate((texts[i] or "").split("\n")) if k not in drop])
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = joined.mapInArrow(keep, docs.schema)
    return out.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType)) if size_col else out
