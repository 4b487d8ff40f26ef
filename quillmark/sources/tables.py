"""Notes, blocks, stamps, changes and samples derived from the given tables, so that queries grow with them.

Each has its SQL twin, used by the oracle strings.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"), (F.col("doc_id") * 1000).alias("mtime"), "n_chars")


NOTES = "notes AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS path, replace(text, chr(10), chr(10) || chr(10)) AS text, doc_id * 1000 AS mtime, n_chars FROM documents)"


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notes with headings; a conversation's turns are few."""
    turn = F.concat(F.when(F.col("role") == "user", "## ").otherwise("### "), "role", F.lit("-"), F.col("turn").cast("string"), F.lit("\n\n"), "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda s: s["t"]), "\n\n")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("# start\n\n"), joined).alias("text")).select(F.concat(F.lit("talk/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), "text")


TALKS = """talks AS (SELECT 'talk/' || conv_id || '.md' AS path, '# start' || chr(10) || chr(10) ||
  string_agg(CASE WHEN role = 'user' THEN '## ' ELSE '### ' END || role || '-' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""


def vector_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as blocks: five to a note, ten folders."""
    n = F.floor(F.col("vec_id") / 5)
    source = F.concat(F.lit("folder"), (n % 10).cast("string"), F.lit("/note-"), n.cast("string"), F.lit(".md"))
    out = table(spark, sf_dir, "embeddings").select("vec_id", source.alias("source_path"), F.col("embedding").alias("vec"), "label")
    return out.withColumn("entity_key", F.concat("source_path", F.lit("#paragraph-"), (F.col("vec_id") % 5 + 1).cast("string")))


VECTORS = "vecs AS (SELECT vec_id, source_path, source_path || '#paragraph-' || (vec_id % 5 + 1) AS entity_key, embedding AS vec, label FROM (SELECT *, 'folder' || ((vec_id // 5) % 10) || '/note-' || (vec_id // 5) || '.md' AS source_path FROM embeddings))"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block per document with its stamp, and every fifth one a source."""
    base = notes(spark, sf_dir)
    key = F.concat("path", F.lit("#paragraph-1"))
    kind = F.when(F.col("doc_id") % 5 == 0, "source").otherwise("block")
    extra = F.to_json(F.struct(F.array(F.lit("paragraph-1")).alias("headings"), F.substring("text", 1, 20).alias("text")))
    return base.select(
        F.when(kind == "source", F.col("path")).otherwise(key).alias("entity_key"), kind.alias("entity_type"), "path", F.col("path").alias("source_path"), F.sha2("text", 256).alias("last_read_hash"),
        F.col("n_chars").alias("last_read_size"), F.col("mtime").alias("last_read_mtime"), F.length("text").cast("bigint").alias("text_len"), extra.alias("extra"), "doc_id",
    )


ENTITIES = (
    NOTES
    + """, entities AS (SELECT CASE WHEN doc_id % 5 = 0 THEN path ELSE path || '#paragraph-1' END AS entity_key, CASE WHEN doc_id % 5 = 0 THEN 'source' ELSE 'block' END AS entity_type,
  path, path AS source_path, sha256(text) AS last_read_hash, n_chars AS last_read_size, mtime AS last_read_mtime, CAST(length(text) AS BIGINT) AS text_len, substr(text, 1, 20) AS head, doc_id FROM notes)"""
)


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of most entities for model m1; some outdated, some of another length, some for m2 as well."""
    e = entities(spark, sf_dir).where("doc_id % 11 != 0")
    vec = F.array(*[((F.col("doc_id") + i) % 7).cast("float") for i in range(4)])
    one = e.select("entity_key", F.lit("m1").alias("model_key"), vec.alias("vec"), (F.col("doc_id") % 9).cast("int").alias("tokens"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("last_read_hash")).alias("embed_hash"), F.when(F.col("doc_id") % 13 == 0, 3).otherwise(4).alias("dims"), (F.col("doc_id") * 10).alias("updated_at"), "doc_id")
    return one.unionByName(one.where("doc_id % 4 = 0").withColumn("model_key", F.lit("m2")))


STAMPS = (
    ENTITIES
    + """, one AS (SELECT entity_key, 'm1' AS model_key, [CAST((doc_id + i) % 7 AS FLOAT) FOR i IN [0, 1, 2, 3]] AS vec, CAST(doc_id % 9 AS INT) AS tokens, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE last_read_hash END AS embed_hash,
  CASE WHEN doc_id % 13 = 0 THEN 3 ELSE 4 END AS dims, doc_id * 10 AS updated_at, doc_id FROM entities WHERE doc_id % 11 <> 0),
stamps AS (SELECT * FROM one UNION ALL SELECT * REPLACE ('m2' AS model_key) FROM one WHERE doc_id % 4 = 0)"""
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of the notes look like now: some times moved, some texts grown, some files gone."""
    n = notes(spark, sf_dir).where("doc_id % 19 != 0")
    return n.select("path", F.when(F.col("doc_id") % 13 == 0, F.col("mtime") + 5).otherwise(F.col("mtime")).alias("mtime"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 26 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))


FILES = "files AS (SELECT path, CASE WHEN doc_id % 13 = 0 THEN mtime + 5 ELSE mtime END AS mtime, n_chars AS size, CASE WHEN doc_id % 26 = 0 THEN text || '!' ELSE text END AS text FROM notes WHERE doc_id % 19 <> 0)"


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir).where("doc_id % 3 != 0")
    return n.select("path", F.sha2("text", 256).alias("read_hash"), F.when(F.col("doc_id") % 17 != 0, F.col("mtime")).alias("mtime"), F.col("n_chars").alias("size"))


KNOWN = "known AS (SELECT path, sha256(text) AS read_hash, CASE WHEN doc_id % 17 <> 0 THEN mtime END AS mtime, n_chars AS size FROM notes WHERE doc_id % 3 <> 0)"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "purchase", "rename").when(F.col("event_type") == "error", "delete").otherwise("modify")
    path = lambda x: F.concat(F.lit("n/"), x.cast("string"), F.when(x % 10 == 3, ".png").otherwise(".md"))
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), op.alias("op"), path(F.col("user_id")).alias("path"), path(F.col("user_id") + 1).alias("old_path"), "user_id")


CHANGES = """changes AS (SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'rename' WHEN 'error' THEN 'delete' ELSE 'modify' END AS op,
  'n/' || user_id || CASE WHEN user_id % 10 = 3 THEN '.png' ELSE '.md' END AS path, 'n/' || (user_id + 1) || CASE WHEN (user_id + 1) % 10 = 3 THEN '.png' ELSE '.md' END AS old_path, user_id FROM events),
actions AS (SELECT ts, user_id, 'delete' AS action, CASE op WHEN 'rename' THEN old_path ELSE path END AS path FROM changes WHERE op IN ('rename', 'delete')
  UNION ALL SELECT ts, user_id, 'upsert', path FROM changes WHERE op <> 'delete'),
acts AS (SELECT * FROM actions WHERE path LIKE '%.md')"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("state"), F.col("value").alias("ms"), (F.col("value") / 2).alias("trigger_ms"), F.when(F.col("event_id") % 3 == 0, F.col("value") * 16).alias("settled_ms"), (F.col("event_id") % 50 == 0).cast("bigint").alias("timeouts"), (F.col("event_id") % 20 == 0).cast("bigint").alias("empty_polls"), (F.col("event_id") % 997 == 0).alias("frozen"), F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))


SAMPLES = "samples AS (SELECT event_type AS state, value AS ms, value / 2 AS trigger_ms, CASE WHEN event_id % 3 = 0 THEN value * 16 END AS settled_ms, CAST(event_id % 50 = 0 AS BIGINT) AS timeouts, CAST(event_id % 20 = 0 AS BIGINT) AS empty_polls, event_id % 997 = 0 AS frozen, user_id AS run_id, event_id AS seq, epoch_us(ts) // 1000 AS ts FROM events)"
