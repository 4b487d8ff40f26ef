"""Nearest neighbours and note-level ranking.

Scores are cosines in double precision over float32 values, ranked by the score rounded to ``DIGITS`` digits and then by key. A few query
vectors are broadcast, with their norms, and scored in the JVM. Tables of queries go through ``neighbours``, which forms only the tiles of
pairs that can matter.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window

from quillmark.functions.vectors import SMALL, dot, l2_norm
from quillmark.operators.jobs import Embedder, embed
from quillmark.operators.neighbours import nearest_many

DIGITS = 6
OVERFETCH_NOTES, OVERFETCH_CONNECTIONS = 4, 3
NEAREST_LIMIT = 50
SUM_LANES = 64


def key_filters(candidates: DataFrame, *, include: DataFrame | None = None, exclude: DataFrame | None = None, starts_with: str | None = None, not_starts_with: str | None = None) -> DataFrame:
    """Filters on keys, before any arithmetic."""
    out = candidates
    if starts_with is not None:
        out = out.where(F.startswith("entity_key", F.lit(starts_with)))
    if not_starts_with is not None:
        out = out.where(~F.startswith("entity_key", F.lit(not_starts_with)))
    if include is not None:
        out = out.join(include.select("entity_key"), "entity_key", "left_semi")
    if exclude is not None:
        out = out.join(exclude.select("entity_key"), "entity_key", "left_anti")
    return out


def scored(candidates: DataFrame, vector: list[float], min_score: float | None = None, where: Column | None = None) -> DataFrame:
    """Candidates with their score against one vector, cast to float32; a zero vector finds nothing, zero candidates are skipped."""
    query = np.asarray(vector, np.float32).astype(np.float64)
    norm = float(np.sqrt((query * query).sum()))
    if norm < SMALL:
        return candidates.limit(0).withColumn("score", F.lit(None).cast("double"))
    q = F.array(*[F.lit(float(x)) for x in query])
    own = l2_norm(F.col("vec"))
    out = candidates.where((F.size("vec") == len(query)) & (own >= SMALL)).withColumn("score", F.round(dot(F.col("vec"), q) / (own * norm), DIGITS))
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    return out.where(where) if where is not None else out


def nearest(candidates: DataFrame, vector: list[float], limit: int = NEAREST_LIMIT, *, min_score: float | None = None, where: Column | None = None, overfetch: int | None = None, **filters) -> DataFrame:
    """(entity_key, ..., score) best first. ``overfetch`` applies ``where`` only to the best overfetch * limit rows."""
    hits = scored(key_filters(candidates, **filters), vector, min_score, None if overfetch else where)
    order = (F.desc("score"), F.col("entity_key"))
    if overfetch and where is not None:
        hits = hits.orderBy(*order).limit(overfetch * limit).where(where)
    return hits.orderBy(*order).limit(limit)


def nearest_to(candidates: DataFrame, key: str, limit: int = NEAREST_LIMIT, **filters) -> DataFrame:
    """``nearest`` to an entity's own vector, without the entity; an entity without a vector is an error."""
    own = candidates.where((F.col("entity_key") == key) & (F.size("vec") > 0)).select("vec").head(1)
    if not own:
        raise ValueError(f"{key} has no vector")
    return nearest(candidates.where(F.col("entity_key") != key), list(own[0].vec), limit, **filters)


def scope(entities: DataFrame, which: str = "all") -> DataFrame:
    """``all``, or only ``notes`` or ``blocks``."""
    kinds = {"all": ("source", "block"), "notes": ("source",), "blocks": ("block",)}[which]
    return entities.where(F.col("entity_type").isin(*kinds))


def lookup(text: str, embed: Callable[[list[str], str], list], collections: list[DataFrame], limit: int = 20) -> DataFrame:
    """The best of all collections for a text, which is embedded as a query; a text without a vector is an error."""
    vector = (embed([text], "query") or [None])[0]
    if vector is None or not len(vector):
        raise ValueError("no vector for the text")
    return merge_results([nearest(c, [float(x) for x in vector], limit) for c in collections], limit)


def by_score(hits: DataFrame, *, ascending: bool = False) -> DataFrame:
    """By score, where scores that agree to nine digits are ties, and then by key."""
    score = F.round("score", 9)
    return hits.orderBy(score.asc() if ascending else score.desc(), "entity_key")


def best_per_source(hits: DataFrame, by: tuple = ()) -> DataFrame:
    """The best block of each note."""
    rank = Window.partitionBy(*by, "source_path").orderBy(F.desc("score"), "entity_key")
    return hits.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")


def search_notes(candidates: DataFrame, vector: list[float], limit: int) -> DataFrame:
    hits = nearest(candidates, vector, OVERFETCH_NOTES * limit)
    return best_per_source(hits).orderBy(F.desc("score"), "entity_key").limit(limit)


def average_vectors(blocks: DataFrame, by: str = "source_path") -> DataFrame:
    """(by, vec): the element-wise mean, cast to float32; vectors of a group are of one length.

    Vectors of a group that meet in a batch are added there, so a row for each group and batch is shuffled; those of ``SUM_LANES`` shares of the tasks
    are added first, then the shares.
    """
    kind = blocks.schema[by].dataType.simpleString()

    def add(batches):
        lane = TaskContext.get().partitionId() % SUM_LANES
        for b in batches:
            groups, at = np.unique(np.array(b.column(0).dictionary_encode().indices), return_inverse=True)
            values = b.column(1)
            sizes = np.diff(values.offsets.to_numpy()) if len(values) else np.zeros(0, int)
            for width in np.unique(sizes):
                rows = np.flatnonzero(sizes == width)
                flat = values.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width).astype(np.float64)
                own, place = np.unique(at[rows], return_inverse=True)
                sums = np.zeros((len(own), width))
                np.add.at(sums, place, flat)
                first = np.full(len(groups), -1)
                first[at[rows[::-1]]] = rows[::-1]
                cut = pa.array(np.arange(len(own) + 1) * width, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first[own])), pa.ListArray.from_arrays(cut, pa.array(sums.ravel())), pa.array(np.bincount(place), pa.int64()), pa.array([lane] * len(own), pa.int32())], names=["by", "sums", "n", "lane"])

    rows = blocks.where((F.size("vec") > 0) & F.col(by).isNotNull()).select(F.col(by).alias("by"), F.col("vec").cast("array<double>").alias("vec"))
    parts = rows.mapInArrow(add, f"by {kind}, sums array<double>, n bigint, lane int")
    total = F.aggregate(F.collect_list("sums"), F.array().cast("array<double>"), lambda a, x: F.when(F.size(a) == 0, x).otherwise(F.zip_with(a, x, lambda i, j: i + j)))
    for keys in (("by", "lane"), ("by",)):
        parts = parts.groupBy(*keys).agg(total.alias("sums"), F.sum("n").alias("n"))
    return parts.select(F.col("by").alias(by), F.transform("sums", lambda x: (x / F.col("n")).cast("float")).alias("vec"))


def connections(candidates: DataFrame, source: str, limit: int) -> DataFrame:
    """Notes related to one note: its mean vector against the blocks of all others."""
    own = candidates.where(F.col("source_path") == source)
    mean = average_vectors(own).collect()  # one row
    if not mean:
        return candidates.limit(0).withColumn("score", F.lit(None).cast("double"))
    hits = nearest(candidates.where(F.col("source_path") != source), list(mean[0].vec), OVERFETCH_CONNECTIONS * limit)
    return best_per_source(hits).orderBy(F.desc("score"), "entity_key").limit(limit)


def connections_all(candidates: DataFrame, limit: int) -> DataFrame:
    """``connections`` of every note at once."""
    means = average_vectors(candidates).select(F.col("source_path").alias("query_id"), F.col("source_path").alias("own"), "vec")
    hits = nearest_many(means, candidates, OVERFETCH_CONNECTIONS * limit, own="own").drop("rank")
    best = best_per_source(hits, ("query_id",))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_key")
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= limit)


def embedded_connections(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """(path, n, entity_key, source_path, score, rank) for every query block of ``chunk.embedded_queries``: the notes related to its own note.

    Each block has its own limit, and may name a folder and a least score (``min_score``) in its settings. A note's mean vector asks all blocks of
    other notes; notes without vectors find nothing.
    """
    setting = lambda name: F.try_element_at("settings", F.lit(name))
    asked = found.select("path", "n", "row_limit", F.nullif(setting("folder"), F.lit("")).alias("folder"), setting("min_score").try_cast("double").alias("least"))
    own = average_vectors(candidates.join(asked.select(F.col("path").alias("source_path")), "source_path", "left_semi"))
    queries = asked.join(own.withColumnRenamed("source_path", "path"), "path").withColumn("query_id", F.concat_ws(":", F.col("n").cast("string"), "path")).withColumn("k", OVERFETCH_CONNECTIONS * F.col("row_limit"))
    hits = best_per_source(nearest_many(queries, candidates, own="path").drop("rank"), ("query_id",))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_key")
    ranked = hits.withColumn("rank", F.row_number().over(rank)).join(queries.select("query_id", "path", "n", "row_limit"), "query_id").where("rank <= row_limit")
    return ranked.select("path", "n", "entity_key", "source_path", "score", "rank")


def lookup_many(texts: DataFrame, found: Embedder, entities: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(hits, failed) for many texts (query_id, text, scope): scope is all, notes or blocks.

    Texts are embedded over the partitions as queries; ``entities`` has (entity_key, entity_type, source_path, vec). ``hits``: (query_id, entity_key, score, rank),
    each key once for a text, though notes and blocks may share it; ``failed``: (query_id, error) of texts without a vector.
    """
    got = embed(texts.select(F.col("query_id").alias("entity_key"), "text"), found, role="query", halt=False).withColumnRenamed("entity_key", "query_id")
    kind = F.when(F.col("scope") == "notes", "source").when(F.col("scope") == "blocks", "block").alias("kind")
    queries = got.where("status = 'ok'").select("query_id", "vec").join(texts.select("query_id", kind), "query_id")
    hits = nearest_many(queries, entities, 2 * limit)  # a key may come twice, once as a note and once as a block
    each = hits.groupBy("query_id", "entity_key").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_key")
    return each.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= limit), got.where("status <> 'ok'").select("query_id", F.coalesce("error", F.lit("no text")).alias("error"))


def merge_results(results: list[DataFrame], limit: int) -> DataFrame:
    """The best of several result sets, each key once."""
    parts = [r.select("entity_key", "score").orderBy(F.desc("score"), "entity_key").limit(limit) for r in results]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("entity_key").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "entity_key").limit(limit)


def with_metadata(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Hits with path, headings and a preview; hits without metadata keep defaults."""
    from quillmark.functions.text import preview

    joined = hits.select("entity_key", "score").join(meta.select("entity_key", "path", "headings", "text"), "entity_key", "left")
    return joined.select("entity_key", "score", F.coalesce("path", F.substring_index("entity_key", "#", 1)).alias("path"), F.coalesce("headings", F.array().cast("array<string>")).alias("headings"), preview(F.coalesce("text", F.lit(""))).alias("preview"))


def pinned_first(hits: DataFrame, pinned: list[str]) -> DataFrame:
    return hits.orderBy(F.col("entity_key").isin(*pinned).desc(), F.desc("score"), "entity_key")


def result_filter(hits: DataFrame, hidden: list[str], folder: str | None = None) -> DataFrame:
    out = hits.where(~F.col("entity_key").isin(*hidden)) if hidden else hits
    return out.where(F.startswith("source_path", F.lit(folder + "/"))) if folder else out


def folder_facets(hits: DataFrame) -> DataFrame:
    return hits.where(F.contains("source_path", F.lit("/"))).groupBy(F.split_part("source_path", F.lit("/"), F.lit(1)).alias("folder")).agg(F.count("*").alias("n"))


def random_related(hits: DataFrame, seed: int) -> DataFrame:
    return hits.orderBy(F.rand(seed)).limit(1)
