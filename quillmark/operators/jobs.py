"""The embedding job: what is stale, batches, embedders, retries, stamps and run summaries."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from quillmark.functions.text import bounded_batches, read_hash_or_own

BATCH, RETRIES = 10, 3


# --- staleness ---------------------------------------------------------------------------------------------------------


def has_embed(vec: Column, read_hash: Column, embed_hash: Column) -> Column:
    return F.coalesce((F.size(vec) > 0) | ((read_hash != "") & (read_hash == embed_hash)), F.lit(False))


def is_unembedded(read_hash: Column, embed_hash: Column, size: Column, embed_size: Column, dims: Column, expected_dims: Column, min_change: Column, loaded: bool = False) -> Column:
    """Stale: no hash on either side, other content that isn't a small change of a known size, or the same content with another length of
    vector. Where the vectors are ``loaded`` a wrong length counts whatever the content; lengths of 0 are unknown."""
    none = F.coalesce(read_hash, F.lit("")) == ""
    never = F.coalesce(embed_hash, F.lit("")) == ""
    small = F.coalesce((min_change > 0) & (F.abs(size - embed_size) < min_change), F.lit(False))
    wrong = F.coalesce((expected_dims > 0) & (dims > 0) & (dims != expected_dims), F.lit(False))
    other = read_hash != embed_hash
    return none | never | (wrong | (other & ~small) if loaded else F.when(other, ~small).otherwise(wrong))


def embed_queue(blocks: DataFrame, stamps: DataFrame, model: str, *, expected_dims: int | None = None, min_change: int = 0) -> DataFrame:
    """Eligible and stale blocks; ``blocks`` has should_embed, read_hash and length, ``stamps`` the embeddings' metadata.

    ``min_change`` needs the stamps' embed_size, the length of what was embedded; without it every change counts."""
    size = F.col("embed_size") if "embed_size" in stamps.columns else F.lit(None)
    own = stamps.where(F.col("model_key") == model).select("entity_key", "embed_hash", F.col("dims").alias("_dims"), size.cast("bigint").alias("_size"))
    joined = blocks.where("should_embed").join(own, "entity_key", "left")
    stale = is_unembedded(F.col("read_hash"), F.col("embed_hash"), F.col("length"), F.col("_size"), F.col("_dims"), F.lit(expected_dims).cast("int"), F.lit(min_change))
    return joined.where(stale).drop("embed_hash", "_dims", "_size")


def switch_model(entities: DataFrame, embeddings: DataFrame, model: str, force: bool = False) -> DataFrame:
    """(entity_key, model_key, embed_hash): empty stamps that queue all entities for a model they lack, or all if forced."""
    rows = entities.select("entity_key")
    if not force:
        rows = rows.join(embeddings.where(F.col("model_key") == model).select("entity_key"), "entity_key", "left_anti")
    return rows.select("entity_key", F.lit(model).alias("model_key"), F.lit("").alias("embed_hash"))


def recheck(queue: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): rows whose content changed since they were queued are skipped."""
    joined = queue.join(expected.select("entity_key", F.col("expected_hash")), "entity_key", "left")
    same = F.col("expected_hash").isNull() | (F.col("expected_hash") == F.col("read_hash"))
    return joined.where(same).drop("expected_hash"), joined.where(~same).drop("expected_hash")


# --- batches -----------------------------------------------------------------------------------------------------------


def token_batches(rows: DataFrame, budget: int, *, shard: str = "shard", order: str = "pos", tokens: str = "tokens") -> DataFrame:
    """Adds ``batch``: in order, a new batch starts when the running sum would pass the budget; every row counts 1 at least.

    Shards are sorted within the tasks (Spark spills what doesn't fit) and read as a stream, of which only the running sum of the open batch is kept, so
    the rows of a shard are never held together. Where a batch ends is found by binary search in the sums of an Arrow batch. Ties of
    ``order`` are ordered by the tokens.
    """
    n = F.greatest(F.coalesce(F.col(tokens), F.lit(0)).cast("bigint"), F.lit(1).cast("bigint"))
    names = [c for c in rows.columns if c != shard]
    sorted_rows = rows.select(shard, *names, n.alias("_n")).repartition(shard).sortWithinPartitions(shard, order, "_n")
    width = len(names) + 1

    def run(batches: Iterator[pa.RecordBatch]):
        last, held, batch = None, 0, 0
        for b in batches:
            keys = b.column(0).dictionary_encode()
            code = keys.indices.fill_null(-1).to_numpy()
            out = np.zeros(b.num_rows, np.int32)
            upto = np.cumsum(b.column(width).to_numpy())
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for a, z in zip(cuts, cuts[1:]):
                if last != (keys[a].as_py(),):
                    last, held, batch = (keys[a].as_py(),), 0, 0
                while a < z:
                    done = int(upto[a - 1]) if a else 0
                    end = min(z, int(np.searchsorted(upto, done + budget - held, "right")))
                    if end <= a and not held:
                        end = a + 1  # a row over the budget is a batch of its own
                    if end > a:
                        out[a:end] = batch
                        held += int(upto[end - 1]) - done
                        a = end
                    if a < z:
                        batch, held = batch + 1, 0
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(out)], names=[*b.schema.names[:width], "batch"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema.fields[:width])
    return sorted_rows.mapInArrow(run, f"{schema}, batch int")


def fixed_batches(rows: DataFrame, n: int = BATCH, *, shard: str = "shard", order: str = "pos") -> DataFrame:
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(shard).orderBy(order)) - 1) / n).cast("int"))


# --- embedders -----------------------------------------------------------------------------------------------------------


class Transient(Exception):
    """A failure that may pass; ``retry_after`` seconds if the other side says so."""

    def __init__(self, message: str = "", retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


class Fatal(Exception):
    """A failure that trying again doesn't mend."""


@dataclass
class Embedder:
    """``embed`` takes (texts, role) and gives a vector or None for each; it is built once for each partition."""

    build: Callable[[], Callable[[list[str], str], list]]
    dims: int
    models: dict[str, int] = field(default_factory=dict)


@dataclass
class Model:
    """What is known of a model before it is loaded."""

    key: str
    name: str
    dims: int
    max_tokens: int
    batch_size: int = 1
    size_mb: int | None = None


def catalogue(spark: SparkSession, models: list[Model]) -> DataFrame:
    """(model_key, model_name, dims, max_tokens, batch_size, size_mb, shown): a row for each model, the last of a key wins."""
    rows = [(m.key, m.name, m.dims, m.max_tokens, m.batch_size, m.size_mb) for m in {m.key: m for m in models}.values()]
    out = spark.createDataFrame(rows, "model_key string, model_name string, dims int, max_tokens int, batch_size int, size_mb int")
    return out.withColumn("shown", F.concat("model_name", F.lit(" ("), F.col("dims").cast("string"), F.lit("d)")))


def models_that_fit(needs: DataFrame, models: DataFrame) -> DataFrame:
    """Adds to (entity_key, tokens) the smallest model of a ``catalogue`` that takes so many tokens (ties: by key), null where none does."""
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("size_mb", F.lit(2**31 - 1)).alias("size"), "model_key", "max_tokens", "dims", "batch_size")))
    every = F.broadcast(models.agg(order.alias("_models")))  # one row, as long as the catalogue
    fit = F.try_element_at(F.filter("_models", lambda m: m["max_tokens"] >= F.col("tokens")), F.lit(1))
    return needs.join(every).withColumn("_m", fit).select(*needs.columns, F.col("_m.model_key"), F.col("_m.dims"), F.col("_m.batch_size"))


_REGISTRY: dict[str, Embedder] = {}


def register(name: str, embedder: Embedder) -> None:
    """The last registration of a name wins."""
    _REGISTRY[name] = embedder


def embedder(name: str, model: str | None = None, setting_dims: int | None = None) -> tuple[Embedder, int]:
    """The embedder and its dims: the model's, else the setting's, else its own default."""
    if name not in _REGISTRY:
        raise KeyError(f"unknown embedder {name}")
    found = _REGISTRY[name]
    if model is not None and found.models and model not in found.models:
        raise KeyError(f"unknown model {model}")
    return found, found.models.get(model or "") or setting_dims or found.dims


def hashing_embedder(dims: int = 16) -> Embedder:
    """Deterministic vectors: counts of words by hash, normalised."""
    import zlib

    def build():
        def embed(texts: list[str], role: str) -> list:
            out = []
            for t in texts:
                v = np.zeros(dims)
                for w in t.lower().split():
                    v[zlib.crc32(w.encode()) % dims] += 1.0
                norm = float(np.sqrt((v * v).sum()))
                out.append((v / norm).astype(np.float32) if norm else None)
            return out

        return embed

    return Embedder(build, dims)


def with_retry(call: Callable[[], list], retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> list:
    """Tries again after transient failures, waiting as asked or 2, 4, 8 ... seconds; others pass on."""
    for n in range(retries + 1):
        try:
            return call()
        except Transient as e:
            if n == retries:
                raise
            sleep(e.retry_after if e.retry_after is not None else 2.0 ** (n + 1))
    raise AssertionError


def by_key(keys: list[str], answer: list) -> dict[str, object]:
    """The vector of each key from an embedder's answer to a batch of them: vectors in order, or mappings with ``vec`` and a ``key`` or an ``index``
    (its key wins), in any order. An answer of another length, without identity, for an unknown key, for one key twice, or whose key and index
    disagree is ``Fatal``."""
    if len(answer) != len(keys):
        raise Fatal(f"{len(answer)} results for {len(keys)} texts")
    if not any(isinstance(x, Mapping) for x in answer):
        return dict(zip(keys, answer))
    out: dict[str, object] = {}
    for x in answer:
        at, key = x.get("index"), x.get("key")
        at = at if isinstance(at, int) and not isinstance(at, bool) else None
        named = keys[at] if at is not None and 0 <= at < len(keys) else None
        key = key if isinstance(key, str) and key else named
        if not key:
            raise Fatal("a result without key or index")
        if key not in keys:
            raise Fatal(f"a result for the unknown key {key}")
        if at is not None and named != key:
            raise Fatal(f"the result of index {at} is for {key}")
        if key in out:
            raise Fatal(f"two results for {key}")
        out[key] = x.get("vec")
    return out


def embed(df: DataFrame, found: Embedder, *, role: str = "passage", batch: int = BATCH, retries: int = RETRIES, halt: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(entity_key, vec, tokens, status, error) of (entity_key, text): ok, skipped (empty text) or failed. The columns ``keep`` go along unchanged.

    Answers are checked by ``by_key``; what is wrong with them ends the run, as other fatal errors do. A batch without any usable vector is tried again, and
    once it is out of retries it ends the run too (what was stored before stays), or is failed if not ``halt``; in a batch with some, rows without are
    failed and stay queued. Keys are unique.
    """

    def answer(call: Callable, keys: list[str], texts: list[str]) -> dict[str, object]:
        got = by_key(keys, call(texts, role))
        if not any(v is not None and len(v) for v in got.values()):
            raise Transient("no vector in the batch")
        return got

    def run(batches: Iterator[pa.RecordBatch]):
        call = found.build()
        for b in batches:
            for i in range(0, b.num_rows, batch):  # only a batch's texts are Python objects at once
                part = b.slice(i, batch)
                k, t = part.column(0).to_pylist(), [x or "" for x in part.column(1).to_pylist()]
                full = [j for j, x in enumerate(t) if x.strip()]
                error, got = None, {}
                if full:
                    try:
                        got = with_retry(lambda: answer(call, [str(j) if k[j] is None else k[j] for j in full], [t[j] for j in full]), retries)
                    except Transient as e:
                        error = str(e) or type(e).__name__
                        if halt:
                            raise Fatal(f"{error}, after {retries} retries, at {k[full[0]]}") from e
                vec = [got.get(str(j) if k[j] is None else k[j]) if j in full else None for j in range(len(k))]
                vec = [np.asarray(v, np.float32) if v is not None and len(v) else None for v in vec]
                status = ["skipped" if j not in full else "failed" if vec[j] is None else "ok" for j in range(len(k))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.string()), pa.array(vec, pa.list_(pa.float32())), pa.array([-(-len(x) * 10 // 37) for x in t], pa.int32()), pa.array(status), pa.array([error if s == "failed" else None for s in status], pa.string()), *part.columns[2:]],
                    names=["entity_key", "vec", "tokens", "status", "error", *keep],
                )

    bounded_batches(df.sparkSession)
    kept = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select("entity_key", "text", *keep).mapInArrow(run, f"entity_key string, vec array<float>, tokens int, status string, error string{kept}")


def check_results(queue: DataFrame, results: DataFrame) -> DataFrame:
    """(missing, unknown, repeated) counts; all must be 0."""
    many = results.groupBy("entity_key").agg(F.count("*").alias("n"))
    both = queue.select("entity_key", F.lit(1).alias("q")).join(many, "entity_key", "full_outer")
    one = lambda c: F.count_if(c)
    return both.agg(one(F.col("n").isNull()).alias("missing"), one(F.col("q").isNull()).alias("unknown"), one(F.col("n") > 1).alias("repeated"))


READ_STAMP = ("embed_hash", "embed_size", "embed_mtime")


def read_stamp(blocks: DataFrame) -> list[Column]:
    """``READ_STAMP``: what is embedded is what was read last, so its hash, size and time are the block's (``read_hash``, ``length``, ``mtime``,
    the last two where there are such columns). Blocks without a read hash get that of the text that is embedded, without size and time."""
    read = F.coalesce(F.col("read_hash"), F.lit("")) != ""
    own = ((F.when(read, F.col(c)) if c in blocks.columns else F.lit(None)).cast("bigint") for c in ("length", "mtime"))
    return [c.alias(name) for name, c in zip(READ_STAMP, (read_hash_or_own(F.col("read_hash"), F.col("text")), *own))]


def stamp(results: DataFrame, blocks: DataFrame | None, model: str, updated_at: int, *, adapter: str | None = None) -> DataFrame:
    """Rows for the store, stamped by ``read_stamp`` of their blocks. Without ``blocks`` the results have these columns already."""
    ok = results.where("status = 'ok'")
    if blocks is not None:
        ok = ok.select("entity_key", "vec", "tokens").join(blocks.select("entity_key", "text", "read_hash", *(c for c in ("length", "mtime") if c in blocks.columns)), "entity_key")
        ok = ok.select("entity_key", "vec", "tokens", *read_stamp(blocks))
    size, at = READ_STAMP[1:]
    return ok.select("entity_key", F.lit(model).alias("model_key"), "vec", "tokens", "embed_hash", F.size("vec").alias("dims"), F.lit(updated_at).cast("bigint").alias("updated_at"), size, at, F.lit(adapter).cast("string").alias("adapter"))


def refresh(spark: SparkSession, blocks: DataFrame, store, found: Embedder, model: str, *, updated_at: int = 0, rounds: int = 10, save_rows: int | None = None, min_change: int = 0, adapter: str | None = None) -> int:
    """Queues, embeds and stores until nothing more gets done; the number of blocks left.

    Blocks are stale as in ``embed_queue``: vectors of another length than the embedder's, and changes of ``min_change`` characters or more. With
    ``save_rows`` the queue is cut by hash into parts of about that many rows, and each part is stored when it is done, so that a run that ends (a batch out of
    retries, a wrong answer) or is lost keeps the parts before. Each save writes the table anew: choose parts that are large beside it."""
    from quillmark.operators.store import EMBEDDINGS, upsert

    def queued(stored: DataFrame) -> DataFrame:
        return embed_queue(blocks, stored, model, expected_dims=found.models.get(model, found.dims), min_change=min_change)

    left = -1
    for _ in range(rounds):
        try:
            stored = store.read()
        except FileNotFoundError:
            stored = spark.createDataFrame([], EMBEDDINGS)
        queue = queued(stored)
        now = queue.count()
        if not now or now == left:
            return now
        left = now
        parts = -(-now // save_rows) if save_rows else 1
        for part in range(parts):
            mine = queue.where(F.pmod(F.xxhash64("entity_key"), F.lit(parts)) == part) if parts > 1 else queue
            store.write(upsert(stored, stamp(embed(mine, found), blocks, model, updated_at, adapter=adapter).select(*stored.columns), ["entity_key", "model_key"]))
            stored = store.read()
    return queued(store.read()).count()


def bucket_of(key: Column, buckets: int) -> Column:
    """A key's bucket, from its md5, so that other engines find the same."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 7), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def refresh_buckets(
    spark: SparkSession, blocks: DataFrame, path: str, found: Embedder, model: str, *, updated_at: int = 0, buckets: int = 64, at_once: int = 8, saves: int | None = None, min_change: int = 0, adapter: str | None = None
) -> DataFrame:
    """Queues, embeds and stores what is stale of one model, ``at_once`` buckets of keys after the other; the vectors stored afterwards.

    The table at ``path`` is Parquet partitioned by ``bucket``. Every save replaces the buckets that it embedded for (dynamic partition overwrite) and
    leaves the others' files alone, so a refresh writes each touched bucket once, however many saves it makes, and a bucket without stale blocks never. A run that
    ends, is stopped after a number of ``saves`` or is lost keeps what it saved; the next one goes on from there, and a save made twice gives the same
    rows. Blocks whose keys are null are never stale. A bucket holds about the rows of the table / ``buckets``: choose so many that ``at_once`` of them are a job
    worth losing. Keep ``buckets`` for the life of a table.

    ``blocks`` is read twice, however many saves there are: for the numbers of the stale buckets, and for the queue, which is written beside the table by save
    with all that a save needs. A save reads its own part of it only, embeds it once and joins nothing; the queue goes when the run ends.
    """
    from quillmark.operators.store import EMBEDDINGS, drop_path

    schema = EMBEDDINGS + ", bucket int"
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("bucket").parquet(path)
    at = bucket_of(F.col("entity_key"), buckets)
    mine = blocks.where(F.col("entity_key").isNotNull()).withColumn("bucket", at)

    def stored() -> DataFrame:
        return spark.read.schema(schema).parquet(path)

    def queued(where: Column) -> DataFrame:
        return embed_queue(mine.where(where), stored().where(where).drop("bucket"), model, expected_dims=found.models.get(model, found.dims), min_change=min_change)

    stale = sorted(r[0] for r in queued(F.lit(True)).select("bucket").distinct().collect())  # at most ``buckets`` numbers
    groups = [stale[i : i + at_once] for i in range(0, len(stale), at_once)][:saves]
    if not groups:
        return stored().drop("bucket")
    queue = f"{path.rstrip('/')}-queue-{uuid.uuid4().hex}"
    save = F.create_map(*(F.lit(x) for i, group in enumerate(groups) for b in group for x in (b, i)))[F.col("bucket")]
    waiting = queued(F.col("bucket").isin(*(b for group in groups for b in group))).select("entity_key", "text", *read_stamp(blocks), save.alias("save"))
    try:
        waiting.write.partitionBy("save").parquet(queue)
        waiting = spark.read.schema(waiting.schema).parquet(queue)
        for i, group in enumerate(groups):
            old = stored().where(F.col("bucket").isin(*group))
            made = stamp(embed(waiting.where(F.col("save") == i), found, keep=READ_STAMP), None, model, updated_at, adapter=adapter).withColumn("bucket", at)
            both = old.withColumn("_new", F.lit(0)).unionByName(made.withColumn("_new", F.lit(1))).repartition("bucket")
            last = both.groupBy("bucket", "entity_key", "model_key").agg(F.max_by(F.struct(*(c for c in old.columns if c != "bucket")), "_new").alias("_row"))
            last.select("_row.*", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    finally:
        drop_path(spark, queue)
    return stored().drop("bucket")


def run_summary(results: DataFrame) -> DataFrame:
    """Per run_id: total, success, failed, skipped, duration and outcome of (run_id, status, started, finished, fatal, halted)."""
    n = lambda s: F.count_if(F.col("status") == s).alias({"ok": "success"}.get(s, s))
    out = results.groupBy("run_id").agg(F.count("*").alias("total"), n("ok"), n("failed"), n("skipped"), (F.max("finished") - F.min("started")).alias("duration_ms"), F.bool_or("fatal").alias("fatal"), F.bool_or("halted").alias("halted"))
    return out.withColumn("outcome", F.when(F.col("fatal"), "failed").when(F.col("halted"), "halted").otherwise("completed")).drop("fatal", "halted")
