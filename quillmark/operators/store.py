"""The stored tables: entities, and embeddings by (entity_key, model_key).

Merges are joins; ``VersionedTable`` writes each version beside the last and then moves a pointer, so that a reader sees a whole
version or the one before.
"""

from __future__ import annotations

import json
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

ENTITIES = "entity_key string, entity_type string, path string, source_path string, last_read_hash string, last_read_size bigint, last_read_mtime bigint, text_len bigint, extra string"
EMBEDDINGS = "entity_key string, model_key string, vec array<float>, tokens int, embed_hash string, dims int, updated_at bigint, embed_size bigint, embed_mtime bigint, adapter string"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (``spark.checkpoint.dir``); a local one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table that only its writer knows, wherever it is stored; nothing happens where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def load_entities(entities: DataFrame, embeddings: DataFrame, entity_type: str, model: str) -> DataFrame:
    """All entities of a type with the stamp of one model; the vectors aren't read."""
    stamp = embeddings.where(F.col("model_key") == model).select("entity_key", "tokens", "embed_hash", "dims", "updated_at")
    return entities.where(F.col("entity_type") == entity_type).join(stamp, "entity_key", "left")


def load_vectors(embeddings: DataFrame, keys: DataFrame, model: str) -> DataFrame:
    return embeddings.where(F.col("model_key") == model).join(keys.select("entity_key"), "entity_key", "left_semi").select("entity_key", "vec", "tokens", "embed_hash", "dims", "updated_at")


def searchable_vectors(entities: DataFrame, embeddings: DataFrame, model: str, entity_type: str, dims: int, keep_minor_changes: int | None = None) -> DataFrame:
    """Vectors of the right length that stand for the present content: equal hashes, or, with ``keep_minor_changes`` and an embed_size in
    the embeddings, a size that changed by less."""
    held = entities.where(F.col("entity_type") == entity_type).select("entity_key", "path", "source_path", "last_read_hash", "last_read_size")
    joined = embeddings.where((F.col("model_key") == model) & (F.size("vec") == dims) & (F.coalesce("dims", F.lit(dims)) == dims)).join(held, "entity_key")
    current = F.col("embed_hash") == F.col("last_read_hash")
    if keep_minor_changes and "embed_size" in embeddings.columns:
        current = current | F.coalesce(F.abs(F.col("last_read_size") - F.col("embed_size")) < keep_minor_changes, F.lit(False))
    return joined.where(F.col("last_read_hash").isNotNull() & F.col("embed_hash").isNotNull() & current).select("entity_key", "source_path", "vec")


def load_block_meta(entities: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    kept = F.from_json("extra", "headings array<string>, text string")
    joined = entities.where("entity_type = 'block'").join(embeddings.where(F.col("model_key") == model).select("entity_key"), "entity_key", "left_semi").withColumn("x", kept)
    source = F.coalesce("source_path", F.substring_index("entity_key", "#", 1))
    return joined.select("entity_key", "path", source.alias("source_path"), F.coalesce("x.headings", F.array().cast("array<string>")).alias("headings"), F.coalesce("x.text", F.lit("")).alias("text"))


def detect_dims(embeddings: DataFrame, model: str) -> DataFrame:
    found = embeddings.where((F.col("model_key") == model) & F.col("dims").isNotNull()).agg(F.min("dims").alias("dims"), F.count_distinct("dims").alias("n"))
    return found.select(F.when(F.col("n") > 1, F.raise_error(F.lit("several lengths in one model")).cast("int")).otherwise(F.col("dims")).alias("dims"))


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], latest: str | None = None) -> DataFrame:
    """Rows of the batch replace stored rows of the same keys. Of a key that the batch repeats the row of the greatest ``latest`` stays, any
    one without it."""
    if latest:
        batch = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.col(latest)).alias("_row")).select("_row.*")
    else:
        batch = batch.dropDuplicates(keys)
    return stored.join(batch.select(*keys), keys, "left_anti").unionByName(batch)


def upsert_embeddings(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch has (entity_key, model_key, vec, tokens, meta_hash, active_hash, read_hash, dims, updated_at)."""
    rows = batch.select("entity_key", "model_key", "vec", "tokens", F.coalesce("meta_hash", "active_hash", "read_hash").alias("embed_hash"), F.coalesce("dims", F.size("vec")).alias("dims"), "updated_at")
    return upsert(stored, rows, ["entity_key", "model_key"], "updated_at")


def update_stamps(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows without a vector change hash, length and time only."""
    new = batch.select("entity_key", "model_key", *(F.col(c).alias(f"_{c}") for c in ("embed_hash", "dims", "updated_at")))
    joined = stored.join(new, ["entity_key", "model_key"], "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in ("embed_hash", "dims", "updated_at") else F.col(c) for c in stored.columns))


def delete_entities(entities: DataFrame, embeddings: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(t.join(keys.select("entity_key"), "entity_key", "left_anti") for t in (entities, embeddings))


def clear_embeddings(embeddings: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return embeddings.limit(0) if keys is None else embeddings.join(keys.select("entity_key"), "entity_key", "left_anti")


def valid_rows(rows: DataFrame) -> DataFrame:
    return rows.where((F.coalesce("entity_key", F.lit("")) != "") & (F.coalesce("path", F.lit("")) != ""))


def parse_extra(column: str) -> F.Column:
    """A JSON object as a map; anything else is the empty map."""
    return F.coalesce(F.when(F.trim(column).startswith("{"), F.from_json(column, "map<string,string>")), F.create_map().cast("map<string,string>"))


def pack_extra(rows: DataFrame, drop: tuple = ("path", "embeddings", "embedding_meta", "last_read", "last_embed", "entity_key")) -> DataFrame:
    kept = [c for c in rows.columns if c not in drop]
    return rows.withColumn("extra", F.to_json(F.struct(*kept))).withColumn("text_len", F.coalesce("length", F.length("text")).cast("bigint"))


def vectors_from_blobs(df: DataFrame, column: str = "vec", out: str = "vec") -> DataFrame:
    """Little-endian float32 bytes to arrays; null, empty or broken bytes give null."""
    names = df.columns
    at = names.index(column)

    def run(batches):
        for b in batches:
            values = [np.frombuffer(x, "<f4") if x and len(x) % 4 == 0 else None for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.list_(pa.float32()))], names=[*names, "_v"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, _v array<float>").drop(column).withColumnRenamed("_v", out)


def blobs_from_vectors(df: DataFrame, column: str = "vec", out: str = "blob") -> DataFrame:
    names = df.columns
    at = names.index(column)

    def run(batches):
        for b in batches:
            values = [np.asarray(x, "<f4").tobytes() if x else None for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.binary())], names=[*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, `{out}` binary")


def removed_blocks(stored: DataFrame, current: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored blocks of the sources that are no longer among their blocks."""
    return stored.join(sources.select("source_path"), "source_path", "left_semi").join(current.select("entity_key"), "entity_key", "left_anti")


def sources_without_blocks(sources: DataFrame, blocks: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` by path, and (imported, remaining, total)."""
    lacking = sources.select("path").join(blocks.select(F.col("source_path").alias("path")), "path", "left_anti")
    total = F.count("*")
    counts = lacking.agg(F.least(total, F.lit(limit)).cast("bigint").alias("imported"), F.greatest(total - limit, F.lit(0)).cast("bigint").alias("remaining"), total.alias("total"))
    return lacking.orderBy("path").limit(limit), counts


def stale_sources(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Stored sources whose file has another time or size; missing files and missing stamps don't count."""
    return stored.join(files.select("path", F.col("mtime").alias("file_mtime"), F.col("size").alias("file_size")), "path").where("mtime <> file_mtime or size <> file_size").select("path")


def changed_sources(stored: DataFrame, files: DataFrame) -> DataFrame:
    """(path, read_hash, changed): the first import stamps time and size; later ones the content if time or size moved."""
    from quillmark.functions.text import content_hash

    joined = files.select("path", "text", "mtime", "size").join(stored.select("path", F.col("read_hash").alias("old"), F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size")), "path", "left")
    same = F.col("old").isNotNull() & F.col("old_mtime").eqNullSafe(F.col("mtime")) & F.col("old_size").eqNullSafe(F.col("size"))
    new = F.when(F.col("old").isNull(), F.concat_ws("-", F.col("mtime").cast("string"), F.col("size").cast("string"))).when(same, F.col("old")).otherwise(content_hash(F.col("text")))
    return joined.select("path", new.alias("read_hash"), (~new.eqNullSafe(F.col("old"))).alias("changed"))


def paths_inside(paths: DataFrame, folders: DataFrame, column: str = "path") -> DataFrame:
    """The distinct paths that are one of ``folders`` (folder) or lie inside one: a path's own name and all folders above it are joined by equality."""
    names = F.split(column, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "/"))
    each = paths.where(F.col(column).isNotNull()).select(column).distinct().select(column, F.explode(above).alias("folder"))
    return each.join(folders.where("folder <> ''").select("folder").distinct(), "folder", "left_semi").select(column).distinct()


def cascade_excluded(rows: DataFrame, folders: DataFrame, column: str = "source_path") -> DataFrame:
    """Rows whose source is outside all of ``folders`` (folder); rows without a source stay."""
    return rows.join(paths_inside(rows, folders, column), column, "left_anti").select(*rows.columns)


def readmitted(files: DataFrame, removed: DataFrame, excluded: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, action) to be handled again when the folders ``removed`` (folder) are no longer excluded: files inside them, unless the exclusions that stay
    (``excluded``) hold them or their sources are stored already. ``changes.apply_changes`` and the embedding queue take these rows like any others."""
    back = paths_inside(files, removed)
    kept = back.join(paths_inside(back, excluded), "path", "left_anti").join(stored.select("path"), "path", "left_anti")
    return kept.select("path", F.lit("upsert").alias("action"))


class VersionedTable:
    """A Parquet table in versions: a new one is written in full before the pointer names it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointer(self) -> str | None:
        fs, p = self._fs(f"{self.path}/CURRENT")
        if not fs.exists(p):
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/CURRENT").collect()))["version"]

    def read(self) -> DataFrame:
        version = self._pointer()
        if version is None:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/{version}")

    def write(self, df: DataFrame, partition_by: tuple = ()) -> None:
        version = f"v-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{version}")
        fs, new = self._fs(f"{self.path}/CURRENT.{version}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"version": version}).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = self.spark.sparkContext._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        context.rename(fs.makeQualified(new), fs.makeQualified(self._fs(f"{self.path}/CURRENT")[1]), overwrite)  # at no time is there no pointer
