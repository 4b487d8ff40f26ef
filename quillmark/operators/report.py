"""Counts, progress, and the analysis of run logs."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from quillmark.functions.text import percent
from quillmark.operators.percentiles import percentiles

SLOW_MS = 1000

# States whose latency is judged apart, and what a run's output says.
STARTUP_STATES = ("startup-core", "startup-embedding-init")
BACKGROUND_STATES = ("startup-background-import", "new-note-debounce-reimport", "active-leaf-debounce")
FROZEN = "(?i)FREEZE_DETECTED|UI FREEZE detected|frozen or not loaded|possible freeze|freeze detected"
SEVERITY = {"freeze_detected": 4, "failed": 3, "partial": 2, "passed": 1, "unknown": 0}


def collection_stats(sources: DataFrame, blocks: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row: sources, sources with an embedded block, blocks, embedded blocks."""
    joined = blocks.select("entity_key", "source_path").join(embedded.select("entity_key").distinct().withColumn("e", F.lit(True)), "entity_key", "left")
    counts = joined.agg(F.count("*").alias("block_count"), F.count_if(F.col("e")).alias("embedded_block_count"), F.count_distinct(F.when(F.col("e"), F.col("source_path"))).alias("embedded_source_count"))
    return F.broadcast(sources.agg(F.count("*").alias("source_count"))).join(counts, F.lit(True)).select("source_count", "embedded_source_count", "block_count", "embedded_block_count")


def status_report(stats: DataFrame, *, model: str, dims: int, ready: bool = True, embed_ready: bool = True, state: str = "idle", runtime_state: str | None = None, endpoint: str | None = None) -> DataFrame:
    """``collection_stats`` in one row with the model and the states of the run."""
    said = {"ready": ready, "embed_ready": embed_ready, "status_state": state, "runtime_state": runtime_state, "endpoint_url": endpoint, "model_key": model, "dims": dims}
    kinds = {"ready": "boolean", "embed_ready": "boolean", "dims": "int"}
    return stats.select(*(F.lit(v).cast(kinds.get(k, "string")).alias(k) for k, v in said.items()), *stats.columns)


def embedding_counts(rows: DataFrame, by: tuple = ()) -> DataFrame:
    """total, embedded, embeddable, effective total of (should_embed, has_embed)."""
    out = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("has_embed").alias("embedded"), F.count_if("should_embed").alias("embeddable"))
    return out.withColumn("effective_total", F.when(F.col("embeddable") > 0, F.col("embeddable")).otherwise(F.col("total")))


def progress(rows: DataFrame) -> DataFrame:
    """Adds pending and pct to (total, embedded)."""
    return rows.withColumn("pending", F.greatest(F.lit(0), F.col("total") - F.col("embedded")).cast("bigint")).withColumn("pct", F.when(F.col("total") > 0, percent(F.col("embedded") / F.col("total"))).otherwise(F.lit(0).cast("bigint")))


def tokens_per_item(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tokens_per_item", F.col("batch_tokens") / F.count("*").over(Window.partitionBy("batch")))


def latency_summary(samples: DataFrame, by: tuple = ("state",)) -> DataFrame:
    """Per state of (state, ms, trigger_ms, settled_ms, timeouts, empty_polls, frozen): count, medians, p95 from three samples on, maxima, sums.

    ``settled`` is the longest time to a settled view, ``ms`` where a sample has none.
    """
    one = lambda c: F.round(c, 1)
    sums = samples.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count("ms").alias("_ms"),
        one(F.max("ms")).alias("worst"),
        one(F.max("trigger_ms")).alias("trigger_worst"),
        F.max(F.coalesce("settled_ms", "ms")).alias("settled"),
        F.coalesce(F.sum("timeouts"), F.lit(0)).alias("timeouts"),
        F.coalesce(F.sum("empty_polls"), F.lit(0)).alias("empty_polls"),
        F.coalesce(F.bool_or("frozen"), F.lit(False)).alias("frozen"),
    )
    out = sums
    for column, shares in (("ms", {"median": 0.5, "p95": 0.95}), ("trigger_ms", {"trigger_median": 0.5})):
        found = percentiles(samples, by, column, shares)
        same = [out[c].eqNullSafe(found[c]) for c in by]
        out = out.join(found, same, "left").select(out["*"], *(one(found[c]).alias(c) for c in shares))
    p95 = F.when(F.col("_ms") >= 3, F.col("p95")).alias("p95")
    return out.select(*by, "n", "median", p95, "worst", "trigger_median", "trigger_worst", "settled", "timeouts", "empty_polls", "frozen")


def latency_impact(summary: DataFrame) -> DataFrame:
    """Time-outs block whatever the state. Empty polls degrade a start-up state, mean nothing in the background, and block elsewhere;
    there a settled time beyond ``SLOW_MS``, or none at all, degrades. A freeze is reported, it isn't judged here."""
    empty = F.col("empty_polls") > 0
    impact = (
        F.when(F.col("timeouts") > 0, "interactive-blocker")
        .when(F.col("state").isin(*STARTUP_STATES), F.when(empty, "responsive-but-degraded").otherwise("background"))
        .when(F.col("state").isin(*BACKGROUND_STATES), "background")
        .when(empty, "interactive-blocker")
        .when(F.col("settled").isNull() | (F.col("settled") > SLOW_MS), "responsive-but-degraded")
        .otherwise("background")
    )
    return summary.withColumn("impact", impact)


def timing_stats(samples: DataFrame) -> DataFrame:
    return samples.groupBy("command").agg(F.round(F.avg("ms"), 1).alias("mean"), F.round(F.min("ms"), 1).alias("least"), F.round(F.max("ms"), 1).alias("most"))


def batch_report(batches: DataFrame) -> DataFrame:
    return batches.groupBy("run_id").agg(F.count("*").alias("batches"), F.count_if("failed").alias("failed_batches"), F.max("mean_ms").alias("slowest_mean"))


def last_json(text: Column) -> Column:
    """The shortest tail of a text that begins with a brace and is JSON, null without one."""
    cut = F.split(text, r"\{")
    tails = F.transform(F.sequence(F.size(cut) - 1, F.lit(1), F.lit(-1)), lambda k: F.trim(F.concat(F.lit("{"), F.array_join(F.slice(cut, k + 1, F.size(cut)), "{"))))

    def whole(t: Column) -> Column:  # the parser stops after a value, so something has to follow that it must reach
        read = F.try_parse_json(F.concat(F.lit("["), t, F.lit(", 7]")))
        return F.coalesce(F.try_variant_get(read, "$[1]", "int") == 7, F.lit(False)) & F.try_variant_get(read, "$[2]", "variant").isNull()

    found = F.filter(tails, whole)
    return F.when(F.size(cut) > 1, F.try_element_at(found, F.lit(1)))


def batch_reports(runs: DataFrame) -> DataFrame:
    """Per run log (run_id, out, err, code, ms, timed_out): what the JSON at the end of its output says of its batches.

    (run_id, status, severity, ms, artifact, batches, failed_batches, slowest_mean, code, timed_out). A log without JSON has no batches; means that are missing
    count as 0.
    """
    told = "artifactPath string, batches array<struct<status: string, timing: struct<connectionsView: struct<meanMs: double>>>>"
    read = runs.withColumn("_told", F.from_json(last_json(F.coalesce("out", F.lit(""))), told)).withColumn("status", classify_log(F.col("out"), F.col("err"), F.col("code")))
    batches = F.coalesce("_told.batches", F.array().cast("array<struct<status: string, timing: struct<connectionsView: struct<meanMs: double>>>>"))
    severity = F.lit(0)
    for name, value in SEVERITY.items():
        severity = F.when(F.col("status") == name, value).otherwise(severity)
    means = F.transform(batches, lambda b: F.coalesce(b["timing"]["connectionsView"]["meanMs"], F.lit(0.0)))
    return read.select(
        "run_id", "status", severity.alias("severity"), "ms", F.col("_told.artifactPath").alias("artifact"), F.size(batches).cast("bigint").alias("batches"),
        F.size(F.filter(batches, lambda b: b["status"] == "failed")).cast("bigint").alias("failed_batches"), F.greatest(F.lit(0.0), F.coalesce(F.array_max(means), F.lit(0.0))).alias("slowest_mean"), "code", F.coalesce("timed_out", F.lit(False)).alias("timed_out"),
    )


def stage_durations(events: DataFrame) -> DataFrame:
    """A stage of (run_id, ts, seq, state) ends when another begins; beginning the active stage again changes nothing, so such rows go."""
    run = Window.partitionBy("run_id").orderBy("ts", "seq")
    begun = events.withColumn("_again", F.lag("state").over(run).eqNullSafe(F.col("state"))).where("not _again").drop("_again")
    after = F.lead("ts").over(run)
    return begun.withColumn("finished", after).withColumn("duration_ms", F.greatest(F.lit(0), F.coalesce(after - F.col("ts"), F.lit(0))).cast("bigint"))


def last_stages(events: DataFrame, n: int = 12) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("seq")))
    return events.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def classify_log(out: Column, err: Column, code: Column) -> Column:
    """A freeze before all; then what the run says of its result, PASS whatever the exit code; a null code is 0."""
    text = F.concat_ws("\n", F.coalesce(out, F.lit("")), F.coalesce(err, F.lit("")))
    said = lambda word: text.rlike(rf"(?i)RESULT:\s*{word}")
    failed = said("FAIL") | (F.coalesce(code, F.lit(0)) != 0)
    return F.when(text.rlike(FROZEN), "freeze_detected").when(said("PASS"), "passed").when(said("PARTIAL"), "partial").when(failed, "failed").otherwise("unknown")


def extract_metrics(out: Column) -> dict[str, Column]:
    """The first figure of each kind in a run's output, null without one."""
    number = lambda p: F.regexp_extract(out, p, 1).try_cast("bigint")
    adapter = F.trim(F.regexp_extract(out, r"(?im)Adapter:\s*(.+)$", 1))
    return {
        "seconds": number(r"(?i)(?:Completed in|Time:|embed_ready after)\s+(\d+)s"),
        "checks": number(r"(?i)Checks:\s*(\d+)/"),
        "queries": number(r"(?i)Queries with results:\s*(\d+)"),
        "connections": number(r"(?i)Connections:\s*count=(\d+)"),
        "adapter": F.when(adapter != "", adapter),
    }


def rank_runs(runs: DataFrame) -> DataFrame:
    """Worst first: severity, then cost in seconds, as told or from the run's own time, then that time."""
    severity = F.lit(0)
    for name, value in SEVERITY.items():
        severity = F.when(F.col("class") == name, value).otherwise(severity)
    took = F.coalesce("ms", F.lit(0.0))
    return runs.withColumn("severity", severity).withColumn("cost", F.coalesce("seconds", F.floor(took / 1000 + 0.5))).orderBy(F.desc("severity"), F.desc("cost"), F.desc(took))


def runtime_state(phase: Column, fingerprint: Column) -> dict[str, Column]:
    """States of model, backfill and serving, the one-word status, and whether the model is ready."""
    failed, running = phase == "error", phase == "running"
    model = F.when(F.coalesce(fingerprint, F.lit("")) != "", "ready").when(failed, "unavailable").otherwise("warming_up")
    backfill = F.when(running, "running").when(failed, "failed").otherwise("idle")
    serving = F.when(fingerprint.isNull(), F.when(failed, "unavailable").otherwise("loading")).when(failed, "degraded").otherwise("ready")
    status = F.when(running, "embedding").when(serving.isin("degraded", "unavailable"), "error").otherwise("idle")
    return {"model": model, "backfill": backfill, "serving": serving, "status": status, "ready": (model == "ready") & (backfill != "failed")}


def context_text(hits: DataFrame) -> DataFrame:
    """Per query (query_id, name) one markdown text: a heading with the note's name, and its ranked links without file extension."""
    line = F.concat(F.lit("- [["), F.regexp_replace("path", r"\.md$", ""), F.lit("]] ("), percent(F.coalesce("score", F.lit(0.0))).cast("string"), F.lit("%)"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n")
    return hits.groupBy("query_id", "name").agg(lines.alias("lines")).select("query_id", F.concat(F.lit("## Smart Context: "), "name", F.lit("\n\n"), "lines").alias("text"))
