"""The registered queries of this subpackage: thin wrappers that derive the contract's columns."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from quillmark.llm._spark import table


def _hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.substring_dedup import substring_dedup

    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", _hex(F.col("kept_text")).alias("kept_sha256"))


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillmark.llm.bpe import bpe_digest

    return bpe_digest(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.ogg import media_digest

    return media_digest(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", _hex(F.col("text")).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.decontamination import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), _hex(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.suffix_tree_lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.secrets import joined, scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", n("assign"), n("access"), n("hex"), _hex(joined(F.col("base"))).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.html_extraction import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillmark.llm.token_files import token_ids

    return token_ids(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), end_id=2)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillmark.llm.token_alignment import align_tokens

    return align_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.periodic_runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"), rule=True).drop("runs", "n_words")


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_byte_level_bpe, op3_ogg_media, op4_near_dedup, op5_line_dedup, op6_toxicity, op7_benchmark_decontamination, op8_suffix_tree_lm, op9_secret_scan, op10_html_extraction, op11_token_files, op12_token_alignment, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op5_line_dedup": OP5_SQL, "op7_benchmark_decontamination": OP7_SQL, "op13_periodic_runs": OP13_SQL}


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM win),
cand AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n
), occ AS (SELECT c.doc_id, c.i, c.n, win.item FROM cand c JOIN win ON c.n = win.n AND c.p = win.p),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM occ, unnest(range(i, i + n)) AS u(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS p FROM d, unnest(range(1, len(w) - 11)) AS u(i) WHERE len(w) >= 13),
least_id AS (SELECT p, min(doc_id) AS m FROM win GROUP BY p),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM win JOIN least_id USING (p), range(0, 13) AS r(j) WHERE m < doc_id),
words AS (SELECT doc_id, k, w[k] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(k)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: Lines that go, shared by the query and the pipeline: (doc_id, line) of ``source``.
GONE_SQL = r"""
line AS (
  SELECT doc_id, k, len(w) AS n, w, array_to_string(w, ' ') AS t
  FROM (SELECT doc_id, k, coalesce(regexp_extract_all(p[k], '[^\x20\x09-\x0D]+'), []) AS w
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM {source}) AS s, unnest(range(1, len(p) + 1)) AS u(k))
  WHERE len(w) >= 3
), place AS (SELECT *, row_number() OVER (ORDER BY doc_id, k) AS o FROM line),
first AS (SELECT t, any_value(n) AS n, any_value(w) AS w, min(o) AS o FROM place GROUP BY t),
variant AS (SELECT o, n, i, array_to_string(list_concat(w[1 : i - 1], w[i + 1 : n]), ' ') AS v FROM first, unnest(range(1, n + 1)) AS u(i) WHERE n >= 5),
replaced AS (SELECT o FROM (SELECT o, min(o) OVER (PARTITION BY n, i, v) AS m FROM variant) WHERE m < o),
longer AS (SELECT b.o AS b, a.o AS a FROM variant b JOIN first a ON a.t = b.v AND a.n = b.n - 1 WHERE a.n >= 5),
gone AS (
  SELECT p.doc_id, p.k FROM place p JOIN first f USING (t) WHERE p.o > f.o
  UNION SELECT doc_id, k FROM place WHERE o IN (SELECT o FROM replaced UNION SELECT b FROM longer WHERE a < b UNION SELECT a FROM longer WHERE b < a)
)
"""

OP5_SQL = "WITH " + GONE_SQL.format(source="documents") + """,
kept AS (
  SELECT doc_id, len(p) AS n, list_filter(range(1, len(p) + 1), lambda k: NOT list_contains(coalesce(g, []), k)) AS keep, p
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents) LEFT JOIN (SELECT doc_id, list(k) AS g FROM gone GROUP BY doc_id) USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(n - len(keep) AS BIGINT) AS n_removed, sha256(array_to_string(list_transform(keep, lambda k: p[k]), chr(10))) AS kept_sha256 FROM kept
"""

#: crc32 of the id as decimal text: every byte is mixed in by eight steps of one bit.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS o, len(o) AS n, """ + _CRC_SQL + r""" AS h FROM documents
), x AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END) ELSE o END AS w
  FROM (SELECT *, (h // 10) % greatest(n, 1) AS a, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM d)
), gram AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM x, unnest(range(0, n - 4)) AS u(i)),
pair AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM gram a JOIN gram b ON a.doc_id = b.doc_id AND a.s = b.s AND b.i > a.i AND b.i - a.i <= a.n / 4),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + 4 AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair) GROUP BY doc_id, q, k),
run AS (SELECT doc_id, s, l + q AS len, min(q) AS q FROM stretch WHERE l >= 3 * q GROUP BY doc_id, s, l + q),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len / q DESC, s, q) = 1),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM run, unnest(range(s + q, s + len)) AS u(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT doc_id, i, w[i + 1] AS word FROM x, unnest(range(0, n)) AS u(i)) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT x.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(len AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * len // q AS BIGINT) AS exponent_milli,
       sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM x LEFT JOIN best USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
