"""The change feed: events to upserts and deletes, debounced sessions, and incremental refresh."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from quillmark.functions.text import file_type

GAP = "13 seconds"


def change_stream(events: DataFrame) -> DataFrame:
    """(ts, action, path) of (ts, op, path, old_path): create and modify are upserts, a rename is a delete and an upsert.

    Only notes count; works on batch and streaming frames alike.
    """
    one = lambda action, path: F.struct(F.lit(action).alias("action"), path.alias("path"))
    actions = F.when(F.col("op") == "rename", F.array(one("delete", F.col("old_path")), one("upsert", F.col("path")))).when(F.col("op") == "delete", F.array(one("delete", F.col("path")))).otherwise(F.array(one("upsert", F.col("path"))))
    out = events.select("ts", F.explode(actions).alias("a")).select("ts", "a.action", "a.path")
    return out.where(F.col("path").isNotNull() & F.lower(file_type(F.col("path"))).isin("md", "txt"))


def debounce(changes: DataFrame, gap: str = GAP, watermark: str | None = None, by: tuple = ()) -> DataFrame:
    """(session, n, paths): events less than a gap apart are handled once, as a set."""
    src = changes.withWatermark("ts", watermark) if watermark else changes
    return src.groupBy(F.session_window("ts", gap).alias("session"), *by).agg(F.count("*").alias("n"), F.collect_set("path").alias("paths"))


def _sessions(ticks: DataFrame, gap: str, chunk: int = 512) -> DataFrame:
    """Sessions of a batch's ticks: those of each chunk of ``chunk`` gaps, then those that can touch a neighbour's, two a chunk at most, together."""
    micros = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {gap}"))
    at = F.unix_micros("at")
    rows = ticks.select(F.window_time("tick").alias("at"), "n")
    each = rows.groupBy(F.session_window("at", f"{gap} -1 microseconds").alias("session"), (at - F.pmod(at, micros * chunk)).alias("chunk")).agg(F.sum("n").alias("upserts"), F.min(at).alias("first"), F.max(at).alias("last"))
    # by sums, not by the session: a filter on the session would be pushed below its merging
    edge = (F.col("first") <= F.col("chunk") + micros) | (F.col("last") + micros >= F.col("chunk") + micros * chunk)
    long = F.make_interval(secs=((F.col("last") - F.col("first") + micros - 1) / 1_000_000).cast("decimal(18,6)"))
    merged = each.where(edge).groupBy(F.session_window("session.start", long).alias("session")).agg(F.sum("upserts").alias("upserts"))
    return each.where(~edge).select("session", "upserts").unionByName(merged.select("session", "upserts"))


def firings(changes: DataFrame, gap: str = GAP, *, tick: str = "1 millisecond", watermark: str | None = None, salts: int = 8) -> DataFrame:
    """(session, path, action, ts): which changes of (ts, action, path) each firing of one debounce over the whole feed finds.

    Upserts put the firing off until a gap after the last one; what comes when it is due is for the next. The feed itself never meets in one place: its ticks with an upsert are counted by window, and only
    those, a row for each, are merged into sessions (in a batch by chunks of time first, after which only the sessions at a chunk's ends meet; in a stream all
    ticks that are still open do). Changes are joined with the sessions by slot of time (eight gaps; as sessions last a gap at least,
    a slot meets nine of them at most) and by one of ``salts`` parts of the paths, so that a burst in one slot is shared by that many tasks. Times are taken to
    the ``tick``. Batch and streaming frames alike (a stream needs a watermark); ``last_of_firing`` makes sets of paths of it.
    """
    src = changes.withWatermark("ts", watermark) if watermark else changes
    ticks = src.where("action = 'upsert'").groupBy(F.window("ts", tick).alias("tick")).agg(F.count("*").alias("n"))
    if changes.isStreaming:  # streams want a key beside the session
        sessions = ticks.groupBy(F.session_window(F.window_time("tick"), f"{gap} -1 microseconds").alias("session"), (F.col("n") < 0).alias("all")).agg(F.sum("n").alias("upserts"))
    else:
        sessions = _sessions(ticks, gap)
    # a tick's time is its end less a microsecond, and sessions that touch are one, hence the gap less a microsecond
    back, one = F.expr(f"interval {tick} -1 microseconds"), F.expr("interval 1 microsecond")
    width = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {gap}")) * 8

    def slot(ts: Column) -> Column:
        at = F.unix_micros(ts)
        return ((at - F.pmod(at, width)) / width).cast("bigint")

    slots = F.sequence(slot(F.col("session.start") - back), slot(F.col("session.end")))
    each = sessions.select("session", F.explode(slots).alias("slot")).select("session", "slot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    mine = src.select("ts", "action", "path", slot(F.col("ts")).alias("slot"), F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int").alias("salt"))
    inside = (F.col("c.slot") == F.col("s.slot")) & (F.col("c.salt") == F.col("s.salt")) & (F.col("c.ts") >= F.col("s.session.start") - back) & (F.col("c.ts") < F.col("s.session.end") - back + one)
    return mine.alias("c").join(each.alias("s"), inside).select("s.session", "c.path", "c.action", "c.ts")


def last_of_firing(rows: DataFrame) -> DataFrame:
    """(session, path): what each firing imports again, a path once; paths whose last change was a delete are gone from it."""
    last = rows.groupBy("session", "path").agg(F.max(F.struct("ts", "action")).alias("last"))
    return last.where("last.action = 'upsert'").select("session", "path")


def latest_change(changes: DataFrame, by: tuple = ()) -> DataFrame:
    """The last action of each path; of actions at one moment a delete gives way."""
    return changes.groupBy(*by, "path").agg(F.max(F.struct("ts", "action")).alias("last")).select(*by, "path", "last.action", "last.ts")


def pending(*changes: DataFrame) -> DataFrame:
    out = changes[0].select("path")
    for c in changes[1:]:
        out = out.union(c.select("path"))
    return out.distinct()


def after_discovery(changes: DataFrame, ended: DataFrame) -> DataFrame:
    """Changes of (ts, ...) later than the one row of ``ended`` (ts): those during the first import are dropped, ``catch_up`` finds them."""
    limit = F.broadcast(ended.agg(F.max("ts").alias("_ended")))  # one row
    return changes.join(limit, F.col("_ended").isNull() | (F.col("ts") > F.col("_ended"))).drop("_ended")


def catch_up(stored: DataFrame, files: DataFrame) -> DataFrame:
    """(path, action) for what changed unseen: files without a stored source or with another time or size, and sources without a file."""
    from quillmark.operators.store import stale_sources

    new = files.join(stored.select("path"), "path", "left_anti").select("path")
    gone = stored.join(files.select("path"), "path", "left_anti").select("path", F.lit("delete").alias("action"))
    return new.unionByName(stale_sources(stored, files)).withColumn("action", F.lit("upsert")).unionByName(gone)


def held_until_discovered(changes: DataFrame, *, marker: str = "discovered", shards: int = 64) -> DataFrame:
    """Changes of a stream (ts, action, path) that are later than the row whose action is ``marker``: (ts, action, path, shard).

    Until discovery ends, creations and modifications are dropped, as it finds the files itself; deletes pass. The marker goes to every shard of
    paths, whose only state is the marker's time, and comes out once for each shard, asking for the ``catch_up`` of that shard's paths.
    """
    shard = F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int")
    everywhere = F.when(F.col("action") == marker, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(shard))
    rows = changes.select("ts", "action", "path", F.explode(everywhere).alias("shard"))
    out = "ts timestamp, action string, path string, shard int"

    def step(key, parts, state):
        rows = pd.concat(list(parts)).sort_values(["ts", "action"], kind="stable")
        ended = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        marks = rows.loc[rows["action"] == marker, "ts"]
        told = rows.iloc[:0]
        if ended is None and len(marks):
            ended = marks.min()
            state.update((int(ended.value // 1000),))
            told = rows[(rows["action"] == marker) & (rows["ts"] == ended)].iloc[:1]
        pass_on = (rows["action"] == "delete") if ended is None else (rows["action"] == "delete") | (rows["ts"] > ended)
        yield pd.concat([told, rows[pass_on & (rows["action"] != marker)]])[["ts", "action", "path", "shard"]]

    return rows.groupBy("shard").applyInPandasWithState(step, out, "ended long", "append", "NoTimeout")


def in_shard(path: Column, shards: list[int], n: int = 64) -> Column:
    """Whether a path is of one of the shards of ``held_until_discovered``."""
    return F.pmod(F.xxhash64(path), F.lit(n)).cast("int").isin(*shards)


def apply_changes(notes: DataFrame, changes: DataFrame, contents: DataFrame) -> DataFrame:
    """Notes after the changes; ``contents`` has (path, text) of what is upserted."""
    last = latest_change(changes)
    rest = notes.join(last.select("path"), "path", "left_anti")
    return rest.unionByName(contents.join(last.where("action = 'upsert'").select("path"), "path", "left_semi").select(*notes.columns))


def refresh_blocks(blocks: DataFrame, changes: DataFrame, contents: DataFrame, chunk: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Blocks after the changes: only the touched notes are chunked again."""
    last = latest_change(changes)
    rest = blocks.join(last.select(F.col("path").alias("source_path")), "source_path", "left_anti")
    again = contents.join(last.where("action = 'upsert'").select("path"), "path", "left_semi")
    return rest.unionByName(chunk(again).select(*rest.columns))


def incremental_refresh(stream: DataFrame, store, chunk: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A query that folds every micro-batch of (ts, op, path, old_path, text) into a versioned table of blocks."""

    def step(batch: DataFrame, _: int) -> None:
        changes = change_stream(batch)
        last = batch.where("text is not null").groupBy("path").agg(F.max_by("text", "ts").alias("text"))
        store.write(refresh_blocks(store.read(), changes, last, chunk))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)


class BlockTable:
    """Blocks with their vectors as Parquet, partitioned by a hash of source_path into ``buckets``, so that a change rewrites its buckets only.

    A bucket is replaced as a whole when a write commits (dynamic partition overwrite), and a batch that is applied twice gives the same rows. Each written
    bucket has a row without an entity_key, so that a bucket whose last block goes is written as well; ``read`` leaves these out.
    """

    COLUMNS = "entity_key string, source_path string, text string, read_hash string, embed_hash string, embed_size bigint, vec array<float>"

    def __init__(self, spark, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, source: str) -> Column:
        return F.pmod(F.xxhash64(source), F.lit(self.buckets)).cast("int")

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self.COLUMNS + ", bucket int").parquet(self.path)

    def create(self) -> None:
        self.spark.createDataFrame([], self.COLUMNS + ", bucket int").write.mode("ignore").partitionBy("bucket").parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().where("entity_key is not null").drop("bucket")

    def apply(self, changes: DataFrame, contents: DataFrame, chunk: Callable[[DataFrame], DataFrame], embedder) -> list[int]:
        """Chunks what (path, action) upserts from (path, text), drops what it deletes, embeds blocks whose content is new to the table, and
        writes the touched buckets, whose numbers are returned. A block that couldn't be embedded is kept without a vector and tried with its next change."""
        from quillmark.functions.text import content_hash
        from quillmark.operators.jobs import embed

        touched = changes.select(F.col("path").alias("source_path")).distinct()
        buckets = sorted(r[0] for r in touched.select(self._bucket("source_path")).distinct().collect())  # at most ``buckets`` numbers
        if not buckets:
            return buckets
        old = self._all().where(F.col("bucket").isin(*buckets) & F.col("entity_key").isNotNull())
        again = contents.join(changes.where("action = 'upsert'").select("path"), "path", "left_semi")
        new = chunk(again).select("entity_key", "source_path", "text", content_hash(F.col("text")).alias("read_hash"))
        known = old.select("entity_key", "embed_hash", "embed_size", "vec")
        joined = new.join(known, "entity_key", "left")
        fresh = F.col("vec").isNotNull() & F.col("embed_hash").eqNullSafe(F.col("read_hash"))
        stale = joined.where(~fresh).select("entity_key", "source_path", "text", "read_hash")
        got = embed(stale, embedder).where("status = 'ok'").select("entity_key", "vec")
        made = stale.join(got, "entity_key", "left").select("entity_key", "source_path", "text", "read_hash", F.when(F.col("vec").isNotNull(), F.col("read_hash")).alias("embed_hash"), F.when(F.col("vec").isNotNull(), F.length("text").cast("bigint")).alias("embed_size"), "vec")
        rest = old.drop("bucket").join(touched, "source_path", "left_anti")
        rows = rest.select(*made.columns).unionByName(joined.where(fresh).select(*made.columns)).unionByName(made).withColumn("bucket", self._bucket("source_path"))
        marks = self.spark.createDataFrame([(b,) for b in buckets], "bucket int").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "bucket"), "bucket")
        rows.unionByName(marks).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return buckets


def embedding_refresh(stream: DataFrame, table: BlockTable, chunk: Callable[[DataFrame], DataFrame], embedder, checkpoint: str):
    """A query that folds every micro-batch of (ts, op, path, old_path, text) into a ``BlockTable``, with the vectors of what changed."""

    def step(batch: DataFrame, _: int) -> None:
        last = batch.where("text is not null").groupBy("path").agg(F.max_by("text", "ts").alias("text"))
        table.apply(latest_change(change_stream(batch)), last, chunk, embedder)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def progress_stream(runs: DataFrame) -> DataFrame:
    """Per run of (run_id, ts, done, total, started): the latest counts, percent and elapsed time."""
    last = runs.groupBy("run_id").agg(F.max(F.struct("ts", "done", "total", "started")).alias("x"))
    return last.select("run_id", "x.done", "x.total", F.floor(F.col("x.done") / F.greatest(F.col("x.total"), F.lit(1)) * 100 + 0.5).cast("bigint").alias("pct"), (F.col("x.ts") - F.col("x.started")).alias("elapsed"))
