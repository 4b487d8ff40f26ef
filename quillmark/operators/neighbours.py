"""Exact nearest neighbours of a table of queries, in blocks of queries that candidates stream past.

Candidates are clustered around pivots, a sample of themselves (at most ``PIVOTS`` vectors, so they can be broadcast), with the least and the greatest
angle to the pivot known for each cluster. Angles obey the triangle inequality: a vector of cluster c is at least
``max(angle(q, c) - greatest(c), least(c) - angle(q, c))`` away from q. So

1. every query is compared with a sample of at most ``SAMPLE`` candidates, whose k-th score no worse candidate has to reach;
2. queries are cut into blocks of neighbouring clusters and candidates into slices, and a task reads the candidates of one slice past one block, the clusters
   nearest to the block first. A query is compared with a cluster only if the cluster's bound is within the k-th score that the query has by then.

A task holds one block of queries (``BLOCK_VALUES`` numbers, ``BLOCK_ROWS`` rows at most), k hits for each and an Arrow batch of candidates. Blocks and slices
are chosen so that little is copied: candidates travel once for each block, queries once for each slice, and a slice gives k rows for each query at most. The
number of pairs is what it is: where clusters rule nothing out, all of them are compared. Settings may differ from query to query: see ``nearest_many``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from quillmark.functions.vectors import SMALL
from quillmark.operators.store import shared_path

DIGITS = 6
PIVOTS = 1024
#: Candidates for each pivot, while there are pivots.
CLUSTER_ROWS = 512
#: Candidates that give the first bounds; fewer where vectors are long.
SAMPLE, SAMPLE_VALUES = 4096, 1 << 22
BLOCK_ROWS, BLOCK_VALUES = 1 << 17, 1 << 23
#: Pairs that a task compares, at most, and scores that are held at once.
TASK_PAIRS, TILE_PAIRS = 1 << 35, 1 << 20
#: Scores are rounded, and angles of nearly equal vectors aren't exact.
SLACK = 1e-6

_QUERY = "query_id string, query_vec array<float>, own string, k int, folder string, kind string, least double"
_CANDIDATE = "entity_key string, source_path string, entity_type string, vec array<float>"
_FOUND = "query_id string, entity_key string, source_path string, score double"


def _values(column: pa.Array, width: int) -> np.ndarray:
    """Vectors, all of this length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _usable(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of vectors that have a direction, the lengths of these)"""
    wide = raw.astype(np.float64)
    norm = np.sqrt((wide * wide).sum(1))
    rows = np.flatnonzero(np.isfinite(norm) & (norm >= SMALL))
    return rows, norm[rows]


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


class Clusters:
    """Pivots and, once known, how many candidates each has and how near and far they are; the sample of candidates that gives bounds."""

    def __init__(self, pivots: np.ndarray, sample: pa.RecordBatch):
        self.pivots, self.sample = pivots, sample
        self.width = pivots.shape[1]
        self.rows = np.zeros(len(pivots), np.int64)
        self.near, self.far = np.zeros(len(pivots)), np.zeros(len(pivots))

    @staticmethod
    def of(candidates: DataFrame, width: int, pivots: int | None = None) -> "Clusters":
        """The sample has the candidates with the least hashes of their keys; its first ones are pivots, one for each ``CLUSTER_ROWS`` rows, ``PIVOTS`` at most."""
        total = candidates.count()
        n = pivots or min(PIVOTS, max(1, total // CLUSTER_ROWS))
        most = max(n, min(SAMPLE, SAMPLE_VALUES // width))
        at = F.pmod(F.xxhash64("entity_key"), F.lit(1 << 30))
        few = candidates.where(at < (1 << 30) * 2 * most // total) if total > 4 * most else candidates
        rows = few.orderBy(at, "entity_key").limit(most).toArrow().combine_chunks()  # at most ``most`` rows
        sample = pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns], names=rows.column_names)
        if not sample.num_rows:
            return Clusters(np.eye(1, width), sample)
        raw = _values(sample.column(3), width)[:n]
        some, norm = _usable(raw)
        return Clusters(np.unique(raw[some].astype(np.float64) / norm[:, None], axis=0) if len(some) else np.eye(1, width), sample)

    def assigned(self, candidates: DataFrame) -> DataFrame:
        """Candidates that have a direction, with their cluster and the angle to its pivot."""
        pivots, width = self.pivots, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw = _values(b.column(3), width)
                rows, norm = _usable(raw)
                home, angle = np.zeros(len(rows), np.int32), np.zeros(len(rows))
                for a in range(0, len(rows), 1024):
                    cos = (raw[rows[a : a + 1024]].astype(np.float64) / norm[a : a + 1024, None]) @ pivots.T
                    home[a : a + 1024] = cos.argmax(1)
                    angle[a : a + 1024] = np.arccos(np.clip(cos.max(1, initial=-1.0), -1.0, 1.0))
                kept = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(home), pa.array(angle)], names=[*kept.schema.names, "cluster", "angle"])

        return candidates.mapInArrow(run, _CANDIDATE + ", cluster int, angle double")

    def measure(self, assigned: DataFrame) -> None:
        for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.min("angle").alias("a"), F.max("angle").alias("z")).collect():  # a row for each pivot
            self.rows[r["cluster"]], self.near[r["cluster"]], self.far[r["cluster"]] = r["n"], r["a"], r["z"]

    def bounded(self, queries: DataFrame) -> DataFrame:
        """Queries that have a direction, with their ``home`` cluster and the k-th score in the sample as ``bound`` (null: fewer than k)."""
        me = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a in range(0, b.num_rows, 4096):
                    part = b.slice(a, 4096)
                    part = part.take(pa.array(_usable(_values(part.column(1), me.width))[0]))
                    block = Block(part, me.width)
                    block.compare(me.sample)
                    block.settle()
                    home = (block.unit @ me.pivots.T).argmax(1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home), pa.array(np.where(np.isfinite(block.floor), block.floor, np.nan), from_pandas=True)], names=[*part.schema.names, "home", "bound"])

        return queries.mapInArrow(run, _QUERY + ", home int, bound double")


class Block:
    """Some queries (columns as ``_QUERY``, perhaps with home and bound) and the best candidates found for each so far."""

    def __init__(self, queries: pa.RecordBatch | pa.Table, width: int):
        text = lambda i: queries.column(i).to_pandas()
        number = lambda c: queries.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) if c in queries.schema.names else np.full(queries.num_rows, np.nan)
        vec = queries.column(1)
        self.ids, self.width = queries.column(0), width
        self.raw = _values(vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec, width)
        self.norm = _usable(self.raw)[1]
        self.unit = self.raw.astype(np.float64) / self.norm[:, None]
        self.unit32 = self.unit.astype(np.float32)
        self.margin = SLACK + 1.2e-7 * (width + 8)  # of products of float32
        self.k = queries.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
        self.own, owners = pd.factorize(text(2))
        self.owners = {p: i for i, p in enumerate(owners)}
        group, self.groups = pd.factorize(pd.MultiIndex.from_arrays([text(4).fillna(""), text(4).notna(), text(5).fillna(""), text(5).notna()]))
        self.members = [np.flatnonzero(group == g) for g in range(len(self.groups))] if len(self.groups) < 64 else np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])
        self.least = np.where(np.isnan(least := number("least")), -np.inf, least)
        self.floor = np.fmax(self.least, np.where(np.isnan(bound := number("bound")), -np.inf, bound))
        self.compared = np.zeros(queries.num_rows, np.int64)
        self.fresh, self.new, self.pool, self.pooled = [], 0, [], 0
        self.q, self.s, self.c = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def reached(self, clusters: Clusters, some: np.ndarray) -> np.ndarray:
        """Angles to the pivots of these clusters, one column for each."""
        return _angles(self.unit, clusters.pivots[some])

    def within(self, clusters: Clusters, c: int, angle: np.ndarray) -> np.ndarray:
        reach = np.arccos(np.clip(np.maximum(self.floor, -1.0) - SLACK, -1.0, 1.0)) + SLACK
        return (np.maximum(angle - clusters.far[c], clusters.near[c] - angle) <= reach) & (self.k > 0)

    def stream(self, batch: pa.RecordBatch, clusters: Clusters, count_only: bool = False) -> None:
        """Compares a batch (columns as ``_CANDIDATE``, and cluster) whose clusters come in runs."""
        cluster = batch.column(4).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(cluster[1:] != cluster[:-1]) + 1).tolist(), batch.num_rows]
        runs = [(a, z) for a, z in zip(cuts, cuts[1:]) if z > a]
        for i in range(0, len(runs), 16):
            angles = self.reached(clusters, cluster[[a for a, _ in runs[i : i + 16]]])
            for j, (a, z) in enumerate(runs[i : i + 16]):
                need = self.within(clusters, cluster[a], angles[:, j])
                if need.any():
                    self.compare(batch.slice(a, z - a), need)

    def compare(self, batch: pa.RecordBatch, need: np.ndarray | None = None) -> None:
        """Compares the queries that ``need`` it with candidates that all have this length of vector."""
        raw = _values(batch.column(3), self.width)
        some, norm = _usable(raw)
        if not len(some) or not len(self.ids):
            return
        order = np.asarray(pc.sort_indices(batch.select([0, 1]).take(pa.array(some)), sort_keys=[(batch.schema.names[0], "ascending"), (batch.schema.names[1], "ascending")], null_placement="at_start"))
        some, norm = some[order], norm[order]
        wide = raw[some].astype(np.float64)
        narrow = (wide / norm[:, None]).astype(np.float32)
        paths, kinds = batch.column(1).take(pa.array(some)), batch.column(2).take(pa.array(some))
        owned = np.array([self.owners.get(p, -1) for p in paths.to_pylist()], np.int64) if self.owners else np.full(len(some), -1)
        first = len(self.fresh)
        for (folder, inside, kind, typed), rows in zip(self.groups, self.members):
            fit = np.ones(len(some), bool)
            if inside:
                fit &= pc.starts_with(paths, folder + "/").fill_null(False).to_numpy(zero_copy_only=False)
            if typed:
                fit &= pc.equal(kinds, kind).fill_null(False).to_numpy(zero_copy_only=False)
            rows = rows if need is None or need.all() else rows[need[rows]]
            self.compared[rows] += len(some)
            cols = np.flatnonzero(fit)
            if not len(cols) or not len(rows):
                continue
            a, b, n, mine = (narrow, wide, norm, owned) if len(cols) == len(some) else (narrow[cols], wide[cols], norm[cols], owned[cols])
            step = max(16, TILE_PAIRS // len(cols))
            for i in range(0, len(rows), step):
                self._tile(rows[i : i + step], cols, a, b, n, mine)
        if len(self.fresh) > first:
            used, place = np.unique(np.concatenate([c for _, _, c in self.fresh[first:]]), return_inverse=True)
            cut = np.cumsum([len(c) for _, _, c in self.fresh[first:]])[:-1]
            for i, c in enumerate(np.split(place, cut)):
                self.fresh[first + i] = (*self.fresh[first + i][:2], c + self.pooled)
            self.pool.append(pa.table([x.take(pa.array(some[used])) for x in batch.columns[:2]], names=["key", "path"]))
            self.pooled += len(used)
            if self.new > max(100_000, len(self.q) // 2):
                self.settle()

    def _tile(self, rows: np.ndarray, cols: np.ndarray, narrow: np.ndarray, wide: np.ndarray, norm: np.ndarray, owned: np.ndarray) -> None:
        whole = len(rows) and rows[-1] - rows[0] + 1 == len(rows)
        near = (self.unit32[rows[0] : rows[-1] + 1] if whole else self.unit32[rows]) @ narrow.T
        over = near >= (np.maximum(self.floor[rows], -2.0) - self.margin).astype(np.float32)[:, None]
        hits = np.count_nonzero(over, axis=1)
        many = hits > self.k[rows]
        few = np.flatnonzero((hits > 0) & ~many)
        if len(few):
            r, c = np.nonzero(over[few])
            q = rows[few[r]]
            score = np.round(np.einsum("ij,ij->i", self.raw[q].astype(np.float64), wide[c]) / (self.norm[q] * norm[c]), DIGITS)
            self._keep(q, score, c, cols, owned)
        big = np.flatnonzero(many)
        for i in range(0, len(big), 256):
            q = rows[big[i : i + 256]]
            s = np.round((self.raw[q].astype(np.float64) @ wide.T) / (self.norm[q, None] * norm[None, :]), DIGITS)
            s[(s < self.floor[q, None]) | ((self.own[q, None] == owned[None, :]) & (owned >= 0)[None, :]) | np.isnan(s)] = -np.inf
            k = self.k[q]
            if s.shape[1] > k.min():
                for size in np.unique(k[k < s.shape[1]]):  # of equal scores the first keys stay: columns are in their order
                    at = np.flatnonzero(k == size)
                    part = s[at]
                    kth = np.partition(part, s.shape[1] - size, axis=1)[:, s.shape[1] - size]
                    equal = part == kth[:, None]
                    room = size - (part > kth[:, None]).sum(1)
                    part[equal & (np.cumsum(equal, axis=1) > room[:, None])] = -np.inf
                    s[at] = part
                    self.floor[q[at]] = np.maximum(self.floor[q[at]], kth)
            r, c = np.nonzero(np.isfinite(s))
            self._keep(q[r], s[r, c], c, cols, owned)

    def _keep(self, q: np.ndarray, s: np.ndarray, c: np.ndarray, cols: np.ndarray, owned: np.ndarray) -> None:
        good = (s >= self.floor[q]) & ~((self.own[q] == owned[c]) & (owned[c] >= 0))
        if good.any():
            self.fresh.append((q[good], s[good], cols[c[good]]))
            self.new += int(good.sum())

    def settle(self) -> None:
        """Only the best k of each query stay."""
        if not self.fresh:
            return
        q, s, c = (np.concatenate([old, *(f[i] for f in self.fresh)]) for i, old in enumerate((self.q, self.s, self.c)))
        some = s >= self.floor[q]
        used, c = np.unique(c[some], return_inverse=True)
        q, s, pool = q[some], s[some], pa.concat_tables(self.pool).take(pa.array(used)).combine_chunks()
        place = np.empty(len(used), np.int64)
        place[np.asarray(pc.sort_indices(pool, sort_keys=[("key", "ascending"), ("path", "ascending")], null_placement="at_start"))] = np.arange(len(used))
        order = np.lexsort((place[c], -s, q))
        q, s, c = q[order], s[order], c[order]
        at = np.arange(len(q)) - np.searchsorted(q, q)
        last = at == self.k[q] - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        kept = at < self.k[q]
        self.q, self.s, self.c = q[kept], s[kept], c[kept]
        self.pool, self.pooled, self.fresh, self.new = [pool], len(used), [], 0

    def found(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for i in range(0, len(self.q), 100_000):
            q, c = pa.array(self.q[i : i + 100_000]), pa.array(self.c[i : i + 100_000])
            pool = self.pool[0].take(c)
            arrays = [self.ids.take(q), pool.column(0), pool.column(1), pa.array(self.s[i : i + 100_000])]
            yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in arrays], names=["query_id", "entity_key", "source_path", "score"])

    def counted(self) -> Iterator[pa.RecordBatch]:
        ids = self.ids.combine_chunks() if isinstance(self.ids, pa.ChunkedArray) else self.ids
        yield pa.RecordBatch.from_arrays([ids, pa.array(self.compared)], names=["query_id", "n"])


def _best(found: DataFrame) -> DataFrame:
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_key", "source_path")
    return found.withColumn("rank", F.row_number().over(rank)).where("rank <= k")


def _settings(queries: DataFrame, k: int, own: str | None, min_score: float | None) -> DataFrame:
    has = lambda name, other, kind: (F.coalesce(F.col(name).cast(kind), F.lit(other).cast(kind)) if name in queries.columns else F.lit(other).cast(kind)).alias(name)
    return queries.select(
        F.col("query_id").cast("string").alias("query_id"), F.col("vec").cast("array<float>").alias("query_vec"), (F.col(own).cast("string") if own else F.lit(None).cast("string")).alias("own"),
        has("k", k, "int"), has("folder", None, "string"), has("kind", None, "string"), has("least", min_score, "double"),
    )


def shape(queries: int, candidates: int, width: int, k: int, cores: int) -> tuple[int, int]:
    """(blocks, slices): enough tasks, blocks that fit, and the fewest bytes to copy."""
    tasks = max(2 * cores, -(-queries * candidates // TASK_PAIRS), 1)
    least = max(1, -(-queries // max(64, min(BLOCK_ROWS, BLOCK_VALUES // width))))
    cost = lambda b, s: candidates * (4 * width + 80) * b + queries * (4 * width + 100 + 60 * k) * s
    return min(((b, -(-tasks // b)) for b in range(least, max(least, tasks) + 1)), key=lambda x: cost(*x))


def _compared(queries: DataFrame, assigned: DataFrame, clusters: Clusters, count_only: bool = False) -> DataFrame:
    """The best of each block and slice: ``_FOUND``, or (query_id, n) pairs compared. ``queries`` as of ``Clusters.bounded``."""
    spark = queries.sparkSession
    homes = np.zeros(len(clusters.pivots), np.int64)
    most = 1
    for r in queries.groupBy("home").agg(F.count("*").alias("n"), F.max("k").alias("k")).collect():  # a row for each pivot
        homes[r["home"]], most = r["n"], max(most, r["k"] or 1)
    total = max(1, int(homes.sum()))
    blocks, slices = shape(total, int(clusters.rows.sum()), clusters.width, most, spark.sparkContext.defaultParallelism)
    centred = clusters.pivots - clusters.pivots.mean(0)
    chain = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")  # along the axis on which they differ most
    start = np.zeros(len(homes), np.int64)
    start[chain] = np.cumsum(homes[chain]) - homes[chain]
    share = np.clip(np.minimum(start[None, :] + homes, (np.arange(blocks) + 1)[:, None] * total / blocks) - np.maximum(start[None, :], np.arange(blocks)[:, None] * total / blocks), 0, None)
    place = np.argsort(np.argsort(-(share @ clusters.pivots) @ clusters.pivots.T, axis=1, kind="stable"), axis=1)  # for each block, its nearest clusters first

    part = lambda key: F.pmod(F.xxhash64(key), F.lit(1 << 20))
    at = F.broadcast(spark.createDataFrame([(i, int(s), int(n)) for i, (s, n) in enumerate(zip(start, homes))], "home int, start bigint, held bigint"))
    block: Column = F.least(F.lit(blocks - 1), F.floor((F.col("start") + part("query_id") / (1 << 20) * F.col("held")) * blocks / total)).cast("int")
    left = queries.join(at, "home").withColumn("task", F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: block * slices + s))).withColumn("place", F.lit(-1))
    turns = F.broadcast(spark.createDataFrame([(c, [int(x) for x in place[:, c]]) for c in range(len(homes))], "cluster int, turns array<int>"))
    right = assigned.drop("angle").join(turns, "cluster").select("*", F.posexplode("turns").alias("block", "place")).withColumn("task", F.col("block") * slices + F.pmod(part("entity_key"), F.lit(slices)).cast("int"))
    q_names, c_names = [c.split()[0] for c in (_QUERY + ", home int, bound double").split(", ")], [c.split()[0] for c in (_CANDIDATE + ", cluster int").split(", ")]
    rows = left.select("task", "place", *q_names).unionByName(right.select("task", "place", *c_names), allowMissingColumns=True)
    sorted_rows = rows.repartitionById(blocks * slices, "task").sortWithinPartitions("task", "place", "home")
    width, split = clusters.width, 2 + len(q_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, now = None, [], None
        done = lambda x: x.counted() if count_only else x.found()
        for b in batches:
            tasks, places = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = (tasks[1:] != tasks[:-1]) | ((places[1:] < 0) != (places[:-1] < 0))
            cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                if z <= a:
                    continue
                if tasks[a] != task:
                    if held and count_only and now is None:
                        now = Block(pa.Table.from_batches(held), width)
                    if now is not None:
                        yield from done(now)
                    task, held, now = tasks[a], [], None
                mine = b.slice(a, z - a)
                if places[a] < 0:
                    held.append(mine.select(list(range(2, split))))
                elif held:
                    now = now or Block(pa.Table.from_batches(held), width)
                    now.stream(mine.select(list(range(split, split + len(c_names)))), clusters)
        if now is not None:
            yield from done(now)

    return sorted_rows.mapInArrow(run, "query_id string, n bigint" if count_only else _FOUND)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once, in the folder that the cluster shares."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan(queries: DataFrame, candidates: DataFrame, k: int = 10, *, own: str | None = None, min_score: float | None = None, pivots: int | None = None, count_only: bool = False) -> DataFrame:
    """``nearest_many``'s rows or, if ``count_only``, (query_id, n): candidates that a query is compared with, after the sample."""
    spark = queries.sparkSession
    if "entity_type" not in candidates.columns:
        candidates = candidates.withColumn("entity_type", F.lit(None).cast("string"))
    names = [c.split()[0] for c in _CANDIDATE.split(", ")]
    wanted = _kept(_settings(queries, k, own, min_score).where(F.size("query_vec") > 0), "queries")
    every = _kept(candidates.select(*names[:3], F.col("vec").cast("array<float>").alias("vec")).where(F.size("vec") > 0), "candidates")
    widths = [r["n"] for r in wanted.select(F.size("query_vec").alias("n")).distinct().collect()]  # lengths of vectors: a few
    out = None
    for width in sorted(widths):
        like = every.where(F.size("vec") == width)
        clusters = Clusters.of(like, width, pivots)
        assigned = clusters.assigned(like)
        clusters.measure(assigned)
        mine = _kept(clusters.bounded(wanted.where(F.size("query_vec") == width)), "bounded")
        rows = _compared(mine, assigned, clusters, count_only)
        if not count_only:
            rows = _best(rows.join(mine.select("query_id", "k"), "query_id")).drop("k").select("query_id", "entity_key", "source_path", "score", "rank")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "query_id string, n bigint" if count_only else _FOUND + ", rank int") if out is None else out


def nearest_many(queries: DataFrame, candidates: DataFrame, k: int = 10, *, own: str | None = None, min_score: float | None = None, pivots: int | None = None) -> DataFrame:
    """(query_id, entity_key, source_path, score, rank): the k best of all candidates for every row of ``queries`` (query_id, vec).

    Query columns of these names override what is given for all: ``k``, ``folder`` (only candidates inside it), ``kind`` (only of this entity_type),
    ``least`` (the least score). Candidates whose source_path equals the query's column ``own`` don't count. Query ids are unique; empty
    and zero vectors find nothing and are never found, nor are vectors of another length.
    """
    return plan(queries, candidates, k, own=own, min_score=min_score, pivots=pivots)


def share_compared(queries: DataFrame, candidates: DataFrame, k: int = 10, **settings) -> DataFrame:
    """(compared, possible, share): pairs that ``nearest_many`` looks at, against all of them."""
    asked = plan(queries, candidates, k, **settings, count_only=True)
    n = candidates.count()
    pairs = queries.agg((F.count("*") * F.lit(n)).alias("possible"))
    return asked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared")).join(pairs).select("compared", "possible", (F.col("compared") / F.greatest("possible", F.lit(1))).alias("share"))
