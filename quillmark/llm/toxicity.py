"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The model is fitted on a bounded sample of the training rows: for each label those with the smallest hashes of their ids, at most
2 * ``INDEX_ROWS`` + ``CALIBRATION_ROWS`` in all, whose ids are broadcast. Terms are lower-cased runs of letters and digits. The
vocabulary is all terms of the index, which holds at most ``INDEX_ROWS`` rows of each label. A term's weight is (1 + log of its count)
times its inverse document frequency, counted over all documents, times its evidence: near 1 for a term whose
frequency in the sample depends on the label (G statistic), down to 1 / ``EVIDENCE`` for one that says nothing. Without the evidence
the many rare words of a text decide who is near, and the few that matter don't.

The index is inverted: postings by term in blocks of ``BLOCK`` rows, with the largest weight of each block; rows of the same heaviest
term are neighbours, so that blocks differ. A query bounds all blocks, visits those with at least half of the best bound, and then those
whose bound reaches the k-th similarity: the neighbours are exact, ties go to the earlier row. Memory follows the postings.

The vote of the ``k`` neighbours is weighted by similarity and turned into a probability by isotonic steps over the rows of
the index, each without itself, and at most ``CALIBRATION_ROWS`` other training rows, weighted to the shares of the labels. The
votes are taken in the tasks; numbers alone return. Texts without any term of the vocabulary are one group with
its own rate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from quillmark.llm._spark import bounded_batches, crc_mod, written
from quillmark.llm._words import ALNUM, Words, ragged, slices, trimmed, utf8

INDEX_ROWS = 2_000
CALIBRATION_ROWS = 20_000
K = 15
BLOCK = 256
EVIDENCE = 400.0
THRESHOLD = 0.7


def _row_words(raw, off) -> tuple[Words, np.ndarray]:
    words = Words(raw, off, ALNUM, lower=True)
    return words, words.hashes(double=True)


class Vocabulary:
    """Terms by hash, and rows of a text's term counts."""

    def __init__(self, hashes: np.ndarray):
        self.hash = np.sort(hashes.astype(np.int64).view(np.uint64))

    def counts(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, times) of the vocabulary's terms in the rows."""
        if not len(self.hash) or not len(h):
            return (np.zeros(0, np.int64),) * 3
        at = np.searchsorted(self.hash, h).clip(0, len(self.hash) - 1)
        i = np.flatnonzero(self.hash[at] == h)
        row = np.searchsorted(words.first, i, "right") - 1
        cell, times = np.unique(row * len(self.hash) + at[i], return_counts=True)
        return cell // len(self.hash), cell % len(self.hash), times


def distinct_terms(rows: DataFrame) -> Vocabulary:
    """All terms of the texts of a bounded number of rows."""

    def distinct(batches):
        for b in trimmed(batches):
            raw, off = utf8(b.column(0))
            for lo, hi in slices(off):
                _, h = _row_words(raw, off[lo : hi + 1])
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).view(np.int64))], names=["h"])

    return Vocabulary(rows.select("text").mapInArrow(distinct, "h bigint").distinct().toArrow()["h"].to_numpy())


def term_counts(rows: DataFrame, terms: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """In how many rows of (part 0 or 1, text) each term occurs, by part, and the numbers of rows; summed in the tasks first."""

    def count(batches):
        seen, n = np.zeros((2, len(terms.hash)), np.int64), np.zeros(2, np.int64)
        for b in trimmed(batches):
            part = b.column(0).to_numpy(zero_copy_only=False)
            n += np.bincount(part, minlength=2)
            raw, off = utf8(b.column(1))
            for lo, hi in slices(off):
                row, term, _ = terms.counts(*_row_words(raw, off[lo : hi + 1]))
                for k in (0, 1):
                    seen[k] += np.bincount(term[part[lo:hi][row] == k], minlength=len(terms.hash))
        some = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32())] + [pa.array(np.append(seen[k, some], n[k])) for k in (0, 1)], names=["term", "n0", "n1"])

    got = rows.select(F.col("part").cast("int"), "text").mapInArrow(count, "term int, n0 bigint, n1 bigint").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    term, n = got["term"].to_numpy(), np.stack([got["n0"].to_numpy(), got["n1"].to_numpy()])
    out = np.zeros((2, len(terms.hash)), np.int64)
    out[:, term[term >= 0]] = n[:, term >= 0]
    return out, n[:, term < 0].sum(1)


def evidence_of(seen: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each term, from how many rows of either label have it, how much its presence depends on the label: 1 / ``EVIDENCE`` to 1."""
    n = rows.sum()
    if not rows.all():
        return np.full(seen.shape[1], 1.0)
    g = np.zeros(seen.shape[1])
    for k in (0, 1):
        for x, whole in ((seen[k], seen.sum(0)), (rows[k] - seen[k], n - seen.sum(0))):
            with np.errstate(divide="ignore", invalid="ignore"):
                g += np.where(x > 0, 2 * x * np.log(x * n / (whole * rows[k])), 0)
    return (1 + g**2) / (EVIDENCE + g**2)


class Index:
    """Labelled unit vectors as postings by term, in blocks of ``block`` rows with the largest weight of each block."""

    def __init__(self, terms: Vocabulary, idf: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray, labels: np.ndarray, ids: list, block: int = BLOCK):
        self.terms, self.idf, self.labels, self.ids, self.rows = terms, idf, labels, ids, len(labels)
        weight = (1 + np.log(times)) * idf[term] if len(term) else np.zeros(0)
        norm = np.sqrt(np.bincount(row, weights=weight**2, minlength=self.rows)) if self.rows else np.ones(1)
        heaviest = np.zeros(self.rows, np.int64)
        order = np.lexsort((weight, row))
        heaviest[row[order]] = term[order]  # the last of a row stays
        self.place = np.argsort(heaviest, kind="stable")  # position -> row
        position = np.empty(self.rows, np.int64)
        position[self.place] = np.arange(self.rows)
        at = position[row] if self.rows else row
        order = np.lexsort((at, term))
        self.at, term = at[order], term[order]
        self.value = weight[order] / np.maximum(norm[row[order]], 1e-12)
        of = self.at // block
        new = np.ones(len(order), bool)  # a block of a term's postings starts
        new[1:] = (term[1:] != term[:-1]) | (of[1:] != of[:-1])
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(order)))
        self.block = of[self.start]
        self.blocks = -(-self.rows // block)
        self.bound = np.maximum.reduceat(self.value, self.start) if len(self.start) else np.zeros(0)
        self.first = np.searchsorted(term[self.start], np.arange(len(terms.hash) + 1))
        self.whole = np.append(self.start, len(order))[self.first]  # where each term's postings start

    def nearest(self, term: np.ndarray, times: np.ndarray, k: int = K, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar rows with a similarity above 0 and the similarities; ties go to the earlier row."""
        weight = (1 + np.log(times)) * self.idf[term]
        norm = np.sqrt((weight**2).sum())
        if not norm or not self.rows:
            return np.zeros(0, np.int64), np.zeros(0)
        weight = weight / norm
        parts = self.first[term + 1] - self.first[term]
        part = ragged(self.first[term], parts)
        block = self.block[part]
        bound = np.bincount(block, weights=np.repeat(weight, parts) * self.bound[part], minlength=self.blocks)
        seen = bound >= bound.max() / 3
        rows, sims = self._visit(seen, block, part, term, weight, k, skip)
        rest = ~seen & (bound > 0)
        if len(sims) >= k:
            rest &= bound >= sims[k - 1] - 1e-9
        if rest.any():
            more = self._visit(rest, block, part, term, weight, k, skip)
            rows, sims = np.concatenate([rows, more[0]]), np.concatenate([sims, more[1]])
            top = np.lexsort((rows, -sims))[:k]
            rows, sims = rows[top], sims[top]
        return rows, sims

    def _visit(self, blocks: np.ndarray, block: np.ndarray, part: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows of some blocks."""
        if blocks.all():  # whole lists, one after another
            spans = list(zip(self.whole[term].tolist(), self.whole[term + 1].tolist()))
            per = self.whole[term + 1] - self.whole[term]
            value, at = np.concatenate([self.value[a:b] for a, b in spans]), np.concatenate([self.at[a:b] for a, b in spans])
        else:
            parts = self.first[term + 1] - self.first[term]
            size = np.where(blocks[block], self.size[part], 0)
            ends = np.cumsum(size)
            posting = np.arange(ends[-1]) + np.repeat(self.start[part] - (ends - size), size)
            per = np.diff(np.append(0, ends)[np.append(0, np.cumsum(parts))])  # postings of each term
            value, at = self.value[posting], self.at[posting]
        value *= np.repeat(weight, per)
        sims = np.bincount(at, weights=value, minlength=self.rows)
        near = np.flatnonzero(sims)
        if len(near) > 4 * k:
            found = sims[near]
            near = near[found >= np.partition(found, -k - 1)[-k - 1] - 1e-9]
        rows, sims = self.place[near], np.round(sims[near], 12)
        top = np.lexsort((rows, -sims))
        top = top[(rows[top] != skip) & (sims[top] > 0)][:k]
        return rows[top], sims[top]

    def vote(self, term: np.ndarray, times: np.ndarray, skip: int = -1) -> tuple[float, str]:
        """Similarity-weighted share of label 1 among the neighbours (-1 without any), and the evidence."""
        rows, sims = self.nearest(term, times, skip=skip)
        if not len(rows):
            return -1.0, ""
        return float(sims @ self.labels[rows] / sims.sum()), ",".join(f"{self.ids[r]}:{s:.4f}" for r, s in zip(rows[:3], sims[:3]))

    def votes(self, raw: np.ndarray, off: np.ndarray, skip: np.ndarray | None = None) -> list[tuple[float, str]]:
        row, term, times = self.terms.counts(*_row_words(raw, off))
        edge = np.searchsorted(row, np.arange(len(off)))
        return [self.vote(term[a:b], times[a:b], -1 if skip is None else int(skip[i])) if b > a else (-1.0, "") for i, (a, b) in enumerate(zip(edge[:-1], edge[1:]))]


class Calibration:
    """Isotonic steps from vote to probability; each step's rate is pooled with one row of the overall rate."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, sample: np.ndarray):
        base = float(np.average(labels, weights=sample)) if len(labels) else 0.5
        none = votes < 0
        self.none = float((labels[none] @ sample[none] + base) / (sample[none].sum() + 1)) if len(labels) else base
        order = np.argsort(votes[~none], kind="stable")
        steps: list[list[float]] = []  # [vote, label sum, weight]
        for v, y, w in zip(votes[~none][order], labels[~none][order], sample[~none][order]):
            if steps and steps[-1][0] == v:
                steps[-1][1] += y * w
                steps[-1][2] += w
            else:
                steps.append([v, y * w, w])
        pooled: list[list[float]] = []
        for s in steps:
            pooled.append(s)
            while len(pooled) > 1 and pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]:
                v, y, w = pooled.pop()
                pooled[-1] = [pooled[-1][0], pooled[-1][1] + y, pooled[-1][2] + w]
        self.start = np.array([p[0] for p in pooled])
        self.rate = np.array([(p[1] + base) / (p[2] + 1) for p in pooled])

    def __call__(self, vote: float) -> float:
        if vote < 0 or not len(self.start):
            return self.none
        i = int(np.searchsorted(self.start, vote, "right")) - 1
        return float(self.rate[max(i, 0)])


class Model:
    def __init__(self, index: Index, calibration: Calibration):
        self.index, self.calibration = index, calibration

    def scores(self, raw, off) -> tuple[list[float], list[str]]:
        votes = self.index.votes(raw, off)
        return [self.calibration(v) for v, _ in votes], [e for _, e in votes]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", index_rows: int = INDEX_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Learns from labelled rows whose crc32(id as text) mod 3 is not 1; rows without a label of 0 or 1 teach nothing.

    Of several rows with a sampled id, the one of the least hash of its text is the sample.
    """
    bounded_batches(docs)
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), 3) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    ids = None
    for label, most in ((1, index_rows), (0, index_rows)):
        best = marks.where(F.col("toxic") == label).orderBy(*order)
        some = best.limit(most).withColumn("role", F.lit(1))
        rest = best.offset(most).limit(calibration_rows // 5 if label else calibration_rows - calibration_rows // 5).withColumn("role", F.lit(0))
        ids = some.unionByName(rest) if ids is None else ids.unionByName(some).unionByName(rest)
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    picked = text.join(F.broadcast(ids), "doc_id")  # 2 * index_rows + calibration_rows ids at most
    picked = written(picked.groupBy("doc_id", "toxic", "role").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")
    indexed = picked.where("role = 1")
    terms = distinct_terms(indexed)
    counted, rows = term_counts(docs.select(F.lit(0).alias("part"), F.col(text_col).cast("string").alias("text")), terms)
    idf = np.log((rows[0] + 1) / (counted[0] + 1)) + 1.0
    idf = idf * evidence_of(*term_counts(picked.select(F.col("toxic").alias("part"), "text"), terms))

    def vectors(batches):
        for b in trimmed(batches):
            raw, off = utf8(b.column(2))
            for lo, hi in slices(off):
                row, term, times = terms.counts(*_row_words(raw, off[lo : hi + 1]))
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(term, pa.int32())), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(times, pa.int32()))], names=["doc_id", "toxic", "term", "times"])

    table = indexed.select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", "text").mapInArrow(vectors, "doc_id string, toxic int, term array<int>, times array<int>").toArrow().sort_by("doc_id")
    names, lists = table["doc_id"].to_pylist(), [table[c].combine_chunks() for c in ("term", "times")]
    size = lists[0].value_lengths().to_numpy(zero_copy_only=False)
    index = Index(terms, idf, np.repeat(np.arange(len(names)), size), *(x.flatten().to_numpy().astype(np.int64) for x in lists), table["toxic"].to_numpy().astype(np.float64), names)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    place = {n: i for i, n in enumerate(names)}

    def votes(batches):
        for b in trimmed(batches):
            raw, off = utf8(b.column(3))
            skip = np.array([place[n] if role else -1 for n, role in zip(b.column(0).to_pylist(), b.column(2).to_pylist())], np.int64)
            for lo, hi in slices(off):
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array([v for v, _ in shared.value.votes(raw, off[lo : hi + 1], skip[lo:hi])], pa.float64())], names=["toxic", "vote"])

    got = picked.select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", "role", "text").mapInArrow(votes, "toxic int, vote double").toArrow().sort_by([("vote", "ascending"), ("toxic", "ascending")])
    label, vote = got["toxic"].to_numpy().astype(np.int64), got["vote"].to_numpy()
    share = np.array([totals.get(k, 0) / max(int((label == k).sum()), 1) for k in (0, 1)])  # the index holds labels in other shares than the rows
    return Model(index, Calibration(vote, label.astype(np.float64), share[label] if len(label) else np.zeros(0)))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) per row of ``docs``.

    Null and empty texts, and texts without any known term, get the rate of such texts. Without labels all scores are 0.5.
    Repeated rows repeat; labels, languages, sources and ids are no input of a score; other columns are ignored.
    """
    bounded_batches(docs)
    model = model or fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in trimmed(batches):
            raw, off = utf8(b.column(2))
            for lo, hi in slices(off):
                scores, evidence = shared.value.scores(raw, off[lo : hi + 1])
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array(evidence, pa.string())], names=["doc_id", "held_out", "score", "evidence"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), (crc_mod(F.col(id_col), 3) == 1).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = src.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, evidence string")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score below the threshold, with all their columns; cases as for ``toxicity``."""
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))
    at = docs.columns.index(text_col)

    def run(batches):
        for b in trimmed(batches):
            raw, off = utf8(b.column(at))
            for lo, hi in slices(off):
                scores, _ = shared.value.scores(raw, off[lo : hi + 1])
                yield b.slice(lo, hi - lo).filter(pa.array(np.array(scores) < threshold))

    return docs.mapInArrow(run, docs.schema)
