"""Registered queries of the note index: name -> DataFrame function, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from quillmark.functions import text as T
from quillmark.functions import vectors as V
from quillmark.operators import chunk as C
from quillmark.operators import jobs as J
from quillmark.operators import notes as N
from quillmark.operators import report as R
from quillmark.operators import search as S
from quillmark.operators import store as ST
from quillmark.sources import tables as B
from quillmark.streaming import changes as M

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _q(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes related to one note."""
    return h5_connections(spark, sf_dir)


_LINES = """lines AS (SELECT path, k - 1 AS i, l[k] AS line, len(l) AS n FROM (SELECT path, string_split(text, chr(10)) AS l FROM {0}) AS s, unnest(range(1, len(l) + 1)) AS u(k))"""
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_PARAGRAPHS = (
    _LINES
    + """,
isl AS (SELECT *, sum(CAST(trim(line) = '' AS INT)) OVER (PARTITION BY path ORDER BY i) AS g FROM lines),
par AS (SELECT path, g, min(i) AS s, max(i) AS e, string_agg(line, chr(10) ORDER BY i) AS text FROM isl WHERE trim(line) <> '' GROUP BY path, g),
num AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s) AS k FROM par),
pblocks AS (SELECT path || '#paragraph-' || k AS entity_key, path AS source_path, text, CAST(length(text) AS BIGINT) AS length, CAST(s AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line, ['paragraph-' || k] AS headings FROM num WHERE length(text) >= 100)"""
)
_SECTIONS = (
    B.TALKS
    + ", "
    + _LINES.format("talks")
    + """,
h AS (SELECT path, i AS line, length(regexp_extract(line, '^(#+)', 1)) AS level, regexp_extract(line, '^#+\\s+(.*?)\\s*$', 1) AS heading, n FROM lines WHERE regexp_matches(line, '^#{1,6}\\s+\\S')),
ends AS (SELECT a.path, a.line, min(b.line) AS stop FROM h a JOIN h b ON a.path = b.path AND b.line > a.line AND b.level <= a.level GROUP BY ALL),
above AS (SELECT a.path, a.line, x.line AS xl, x.heading FROM h a JOIN h x ON a.path = x.path AND x.line < a.line AND x.level < a.level
  WHERE NOT EXISTS (SELECT 1 FROM h y WHERE y.path = a.path AND y.line > x.line AND y.line < a.line AND y.level <= x.level)),
anc AS (SELECT path, line, list(heading ORDER BY xl) AS up FROM above GROUP BY path, line),
ranges AS (SELECT h.path, h.level, h.line AS s, coalesce(ends.stop, h.n) - 1 AS e, list_concat(coalesce(up, CAST([] AS VARCHAR[])), [h.heading]) AS headings FROM h LEFT JOIN ends USING (path, line) LEFT JOIN anc USING (path, line)),
sblocks AS (SELECT path || '#' || array_to_string(headings, '#') AS entity_key, path AS source_path, text, CAST(length(text) AS BIGINT) AS length, CAST(s AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line, headings
  FROM (SELECT r.path, r.headings, r.s, r.e, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM ranges r JOIN lines l ON l.path = r.path AND l.i BETWEEN r.s AND r.e GROUP BY ALL) WHERE trim(text) <> ''),
inner_lines AS (SELECT entity_key, source_path, headings, start_line, l.i, l.line, trim(l.line) = '' OR trim(l.line) LIKE '#%' AS stop FROM sblocks b JOIN lines l ON l.path = b.source_path AND l.i > b.start_line AND l.i <= b.end_line WHERE b.length > 1000),
igroup AS (SELECT *, sum(CAST(stop AS INT)) OVER (PARTITION BY entity_key, start_line ORDER BY i) AS g FROM inner_lines),
ipar AS (SELECT entity_key, source_path, headings, start_line, g, min(i) AS s, max(i) AS e, string_agg(line, chr(10) ORDER BY i) AS text FROM igroup WHERE NOT stop GROUP BY ALL),
ikept AS (SELECT *, row_number() OVER (PARTITION BY entity_key, start_line ORDER BY s) AS k FROM ipar WHERE length(text) > 200),
iblocks AS (SELECT entity_key || '#paragraph-' || k AS entity_key, source_path, text, CAST(length(text) AS BIGINT) AS length, CAST(s AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line, list_concat(headings, ['paragraph-' || k]) AS headings FROM ikept),
tblocks AS (SELECT * FROM (SELECT * FROM sblocks UNION ALL SELECT * FROM iblocks) QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY start_line DESC, end_line DESC) = 1)"""
)
def _block_columns() -> list:
    return ["entity_key", "source_path", "length", "start_line", "end_line", F.array_join("headings", "|").alias("headings"), F.sha2("text", 256).alias("hash")]


_BLOCK_SQL = "SELECT entity_key, source_path, length, start_line, end_line, array_to_string(headings, '|') AS headings, sha256(text) AS hash FROM "


# --- notes and chunks ----------------------------------------------------------------------------------------------------


@_q("WITH " + B.NOTES + " SELECT path, 'md' AS extension, CAST(length(text) AS BIGINT) AS size, mtime, sha256(text) AS hash FROM notes")
def a2_notes_from_table(spark, d):
    n = B.notes(spark, d)
    return N.notes_from_table(n, F.col("path"), F.col("text"), F.col("mtime")).select("path", "extension", "size", "mtime", F.sha2("text", 256).alias("hash"))


@_q("WITH " + B.NOTES + " SELECT path, text IS NOT NULL AS found, sha256(text) AS hash FROM (SELECT min(path) AS path FROM notes) JOIN notes USING (path) UNION ALL SELECT 'no/such.md', false, NULL")
def a8_read_note(spark, d):
    n = B.notes(spark, d)
    first = n.agg(F.min("path")).first()[0]
    return N.read_note(n, first).unionByName(N.read_note(n, "no/such.md")).select("path", "found", F.sha2("text", 256).alias("hash"))


@_q("WITH " + B.NOTES + ", asked AS (SELECT path, row_number() OVER (ORDER BY path DESC) - 1 AS pos FROM notes QUALIFY pos < 19) SELECT CAST(pos AS INT) AS pos, path, 'ok' AS status FROM asked UNION ALL SELECT 19, 'no/such.md', 'note_not_found'")
def a9_multi_get(spark, d):
    n = B.notes(spark, d)
    paths = [r.path for r in n.select("path").orderBy(F.desc("path")).limit(19).collect()]  # a request is a short list
    return N.multi_get(n, ["  ", *paths, "no/such.md", "cut/off.md"]).select("pos", "path", "status")


@_q("WITH " + B.NOTES + " SELECT path FROM notes WHERE NOT (list_contains(string_split(path, '/'), 'src1') OR starts_with(path, 'src2/en/') OR contains(string_split(path, '/')[-1], '77'))")
def b1_exclude_paths(spark, d):
    return N.exclude_paths(B.notes(spark, d), "src1, /src2\\en/", "77").select("path")


@_q("WITH " + B.NOTES + r", raw AS (SELECT ' /' || replace(path, '/', chr(92)) || '// ' AS folder FROM notes) SELECT folder, regexp_replace(trim(replace(folder, chr(92), '/')), '^/+|/+$', '', 'g') AS clean FROM raw")
def b2_normalize_folder(spark, d):
    raw = B.notes(spark, d).select(F.concat(F.lit(" /"), F.replace("path", F.lit("/"), F.lit("\\")), F.lit("// ")).alias("folder"))
    return raw.select("folder", T.normalize_folder(F.col("folder")).alias("clean"))


@_q("SELECT doc_id, array_to_string(CASE WHEN source = lang THEN [source] ELSE [source, lang] END, ', ') AS added, source AS removed FROM documents")
def b3_exclusion_list(spark, d):
    t = B.table(spark, d, "documents")
    both = T.add_excluded(F.concat("source", F.lit(", ,"), "source", F.lit("/")), F.col("lang"))
    return t.select("doc_id", both.alias("added"), T.remove_excluded(both, F.col("lang")).alias("removed"))


@_q("WITH " + B.NOTES + " SELECT path FROM notes WHERE starts_with(path, 'src3/en/')")
def b4_in_folder(spark, d):
    return B.notes(spark, d).where(T.in_folder(F.col("path"), F.lit("src3/en"))).select("path")


@_q("WITH " + B.CHANGES + ", p AS (SELECT DISTINCT path FROM changes) SELECT path FROM p WHERE path LIKE '%.md'")
def b5_source_type_filter(spark, d):
    return N.source_type_filter(B.changes(spark, d).select("path").distinct())


@_q("WITH " + _SECTIONS + " SELECT entity_key FROM tblocks WHERE NOT list_contains(headings, 'user-0')")
def b13_exclude_headings(spark, d):
    t = B.talks(spark, d)
    return N.exclude_headings(C.chunk_notes(t), ["user-0"], t).select("entity_key")


@_q("WITH " + _SECTIONS + " SELECT entity_key FROM tblocks WHERE source_path = 'talk/1.md'")
def b14_blocks_of(spark, d):
    return N.blocks_of(C.chunk_notes(B.talks(spark, d)), "talk/1.md").select("entity_key")


_COVER = """, up AS (SELECT array_to_string(p[1 : i], '#') AS entity_key, length FROM (SELECT string_split(entity_key, '#') AS p, length FROM tblocks WHERE contains(entity_key, '#paragraph-')) AS s, unnest(range(2, len(p))) AS u(i) WHERE len(p) > 2),
cover AS (SELECT entity_key, CAST(sum(length) AS BIGINT) AS covered FROM up GROUP BY entity_key)"""


@_q("WITH " + _SECTIONS + _COVER + " SELECT entity_key, length >= 300 AND (contains(entity_key, '#paragraph-') OR coalesce(covered, 0) / length < 0.9) AS should_embed FROM tblocks LEFT JOIN cover USING (entity_key)")
def b15_should_embed(spark, d):
    return C.eligible_blocks(C.chunk_notes(B.talks(spark, d))).select("entity_key", "should_embed")


@_q("WITH " + _SECTIONS + " SELECT path, CAST(line AS INT) AS line, CAST(level AS INT) AS level, heading FROM h")
def c1_extract_headings(spark, d):
    return C.extract_headings(B.talks(spark, d))


@_q("WITH " + _SECTIONS + " SELECT path, CAST(s AS INT) AS start, array_to_string(headings, '|') AS headings FROM ranges")
def c2_heading_paths(spark, d):
    return C.section_ranges(B.talks(spark, d)).select("path", "start", F.array_join("headings", "|").alias("headings"))


@_q('WITH ' + _SECTIONS + ' SELECT path, CAST(s AS INT) AS start, CAST(e AS INT) AS "end" FROM ranges WHERE level <= 2')
def c3_section_ranges(spark, d):
    return C.section_ranges(B.talks(spark, d), max_depth=2).select("path", "start", "end")


@_q("WITH " + _SECTIONS + " " + _BLOCK_SQL + "sblocks")
def c4_section_blocks(spark, d):
    return C.section_blocks(B.talks(spark, d)).select(*_block_columns())


@_q("WITH " + B.NOTES + ", " + _PARAGRAPHS.format("notes") + " " + _BLOCK_SQL + "pblocks")
def c5_paragraph_blocks(spark, d):
    return C.paragraph_blocks(B.notes(spark, d)).select(*_block_columns())


@_q("WITH " + _SECTIONS + " " + _BLOCK_SQL + "iblocks")
def c6_section_paragraphs(spark, d):
    return C.section_paragraphs(C.section_blocks(B.talks(spark, d))).select(*_block_columns())


@_q("WITH " + _SECTIONS + ", " + B.NOTES + ", " + _PARAGRAPHS.replace("lines", "lines2").replace("isl", "isl2").format("notes") + " " + _BLOCK_SQL + "tblocks UNION ALL " + _BLOCK_SQL + "pblocks")
def c7_chunk_notes(spark, d):
    both = B.talks(spark, d).unionByName(B.notes(spark, d).select("path", "text"))
    return C.chunk_notes(both).select(*_block_columns())


@_q("WITH " + _SECTIONS + " SELECT entity_key, start_line FROM sblocks QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY start_line DESC) = 1")
def c8_dedupe_keys(spark, d):
    return C.dedupe_keys(C.section_blocks(B.talks(spark, d))).select("entity_key", "start_line")


@_q("WITH " + _SECTIONS + " SELECT entity_key, sha256(CASE WHEN source_path LIKE '%5.md' THEN 'BLOCK NOT FOUND' ELSE text END) AS hash FROM sblocks WHERE len(headings) > 0")
def c9_block_text(spark, d):
    t = B.talks(spark, d)
    blocks = C.section_blocks(t).withColumn("text", F.lit(None).cast("string"))
    return C.block_text(blocks, t.where("path not like '%5.md'")).select("entity_key", F.sha2("text", 256).alias("hash"))


_LINKED = "linked AS (SELECT CAST(page_id AS VARCHAR) || '.md' AS path, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS t FROM pages)"


@_q("WITH " + _LINKED + " SELECT path, target FROM linked, unnest(t) AS u(target) WHERE NOT starts_with(target, 'http') AND NOT regexp_matches(target, '[|#\\]]') AND target <> ''")
def c10_outlinks(spark, d):
    found = F.filter(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda x: ~x.rlike(r"[|#\]]"))
    links = F.array_join(F.transform(found, lambda x: F.concat(F.lit("[["), x, F.lit("|see]]"))), " ")
    return C.outlinks(B.table(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.concat(links, F.lit(" [[http://x]]")).alias("text")))


@_q("SELECT CAST(doc_id AS VARCHAR) || '.md' AS path, CAST(doc_id % 9 + 1 AS INT) AS row_limit, source || ':' || lang AS folder FROM documents")
def c11_embedded_queries(spark, d):
    body = F.concat(F.lit("x\n```related\nlimit: "), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("\nfolder: "), "source", F.lit(":"), "lang", F.lit("\n```\ny"))
    got = C.embedded_queries(B.table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), body.alias("text")), "related")
    return got.select("path", "row_limit", F.try_element_at("settings", F.lit("folder")).alias("folder"))


@_q("WITH " + B.NOTES + ", " + B.KNOWN + " SELECT path FROM notes WHERE path NOT IN (SELECT path FROM known)")
def e3_new_sources(spark, d):
    return N.new_sources(B.notes(spark, d), B.known(spark, d)).select("path")


@_q("WITH " + _SECTIONS + _COVER + " SELECT * FROM cover")
def f3_paragraph_coverage(spark, d):
    return C.paragraph_coverage(C.chunk_notes(B.talks(spark, d)))


@_q("WITH " + B.NOTES + " SELECT DISTINCT split_part(path, '/', 1) AS folder FROM notes UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM notes")
def f11_list_folders(spark, d):
    return N.list_folders(B.notes(spark, d))


@_q("WITH " + B.NOTES + ", " + B.FILES + ", " + B.KNOWN + " SELECT path FROM files EXCEPT SELECT path FROM known")
def i2_key_difference(spark, d):
    return N.new_sources(B.files(spark, d).select("path"), B.known(spark, d))


# --- functions -----------------------------------------------------------------------------------------------------------


@_q("SELECT doc_id, sha256(" + _TRIM.format("substr(text, 1, 100000)") + ") AS hash FROM documents")
def d1_content_hash(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


_PAIRS = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10)"


@_q("WITH p AS (SELECT a.vec_id AS a, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 10) SELECT a, round(list_cosine_similarity(x, y), 6) AS score FROM p")
def d2_cosine(spark, d):
    e = B.table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 10).alias("vec_id"), F.col("embedding").alias("y"))
    return e.join(other, "vec_id").select(F.col("vec_id").alias("a"), F.round(V.cosine(F.col("embedding"), F.col("y")), 6).alias("score"))


@_q("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 3 * x::DOUBLE * 3))), 6) AS norm FROM embeddings")
def d3_l2_norm(spark, d):
    e = B.table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * 3))
    return e.select("vec_id", F.round(V.l2_norm(F.col("v")), 6).alias("norm"))


@_q("SELECT vec_id, len(embedding) = CASE WHEN vec_id % 2 = 0 THEN 64 ELSE 63 END AS ok FROM embeddings")
def d4_dims_ok(spark, d):
    return B.table(spark, d, "embeddings").select("vec_id", V.dims_ok(F.col("embedding"), F.when(F.col("vec_id") % 2 == 0, 64).otherwise(63)).alias("ok"))


@_q("WITH " + B.ENTITIES + " SELECT entity_key, path AS source_key, CASE WHEN contains(entity_key, '#') THEN replace(replace(path, '/', ' > '), '.md', '') ELSE '' END AS crumbs FROM entities")
def d5_d6_key_parts(spark, d):
    k = F.col("entity_key")
    return B.entities(spark, d).select("entity_key", T.source_key(k).alias("source_key"), T.breadcrumbs(k).alias("crumbs"))


@_q("WITH " + B.NOTES + " SELECT path, sha256(replace(replace(path, '/', ' > '), '.md', '') || chr(10) || text) AS block_input, sha256(substr(replace(replace(path, '/', ' > '), '.md', '') || ':' || chr(10) || text, 1, 1850)) AS source_input FROM notes")
def d7_d8_embed_inputs(spark, d):
    n = B.notes(spark, d)
    return n.select("path", F.sha2(T.block_embed_input(F.concat("path", F.lit("#p")), F.col("text")), 256).alias("block_input"), F.sha2(T.source_embed_input(F.col("path"), F.col("text")), 256).alias("source_input"))


@_q("SELECT doc_id, CAST(ceil(length(text) / 3.7::DOUBLE) AS BIGINT) AS tokens, CAST(greatest(1, floor((CASE WHEN doc_id % 3 = 0 THEN 8191 ELSE doc_id END) * 0.75::DOUBLE)) AS BIGINT) AS budget FROM documents")
def d9_d10_token_budget(spark, d):
    most = F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.col("doc_id"))
    return B.table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.request_budget(F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.greatest(most, F.lit(1))), F.lit(0.75)).alias("budget"))


def _cut_sql(tokens: str, keep: str) -> str:
    """One round of a fold that cuts t at the last space of its first ``keep`` characters, where it is over 300 tokens."""
    head = f"substr(t, 1, CAST(floor({keep}) AS INT))"
    back = f"regexp_replace({head}, ' [^ ]*$', '')"
    return f"CASE WHEN {tokens} <= 300 THEN t WHEN {back} = '' THEN {head} ELSE {back} END"


_TOKENS = "CAST(ceil(length(t) / 3.7::DOUBLE) AS BIGINT)"
_TRIMMED = _cut_sql(_TOKENS, f"length(t) * (1 - least(0.5::DOUBLE, ({_TOKENS} - 300) / {_TOKENS} + 0.1::DOUBLE))")
_SHRUNK = _cut_sql(_TOKENS, f"length(t) * (300 / {_TOKENS} * 0.9::DOUBLE)")


@_q("WITH t0 AS (SELECT doc_id, text AS t FROM documents)" + "".join(f", t{i + 1} AS (SELECT doc_id, {_TRIMMED} AS t FROM t{i})" for i in range(5)) + f" SELECT doc_id, CASE WHEN length(t) > 0 AND {_TOKENS} <= 300 THEN length(t) END AS n FROM t5")
def d11_trim_to_tokens(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.length(T.trim_to_tokens(F.col("text"), 300)).alias("n"))


@_q(f"WITH RECURSIVE s AS (SELECT doc_id, text AS t, 0 AS i FROM documents UNION ALL SELECT doc_id, {_SHRUNK}, i + 1 FROM s WHERE {_TOKENS} > 300 AND i < 40) SELECT doc_id, {_TOKENS} AS tokens FROM (SELECT doc_id, arg_max(t, i) AS t FROM s GROUP BY doc_id)")
def d12_shrink_to_tokens(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.estimate_tokens(T.shrink_to_tokens(F.col("text"), 300)).alias("tokens"))


@_q("SELECT doc_id, trim(split_part(text, chr(10), 1)) AS title, sha256(CASE WHEN instr(text, chr(10)) > 0 AND trim(substr(text, instr(text, chr(10)) + 1)) <> '' THEN " + _TRIM.format("substr(text, instr(text, chr(10)) + 1)") + " ELSE trim(split_part(text, chr(10), 1)) END) AS body FROM documents")
def d13_title_body(spark, d):
    title, body = T.title_body(F.col("text"))
    return B.table(spark, d, "documents").select("doc_id", title.alias("title"), F.sha2(body, 256).alias("body"))


@_q("WITH " + B.CHANGES + " SELECT DISTINCT path, split_part(path, '.', 2) AS kind FROM changes")
def d14_file_type(spark, d):
    return B.changes(spark, d).select("path", T.file_type(F.col("path")).alias("kind")).distinct()


@_q("WITH " + B.VECTORS + " SELECT entity_key, replace(replace(split_part(entity_key, '/', 2), '.md', ''), '#', ' > ') AS title, split_part(source_path, '/', 1) AS trail, CAST(NULL AS VARCHAR) AS heading FROM vecs")
def d15_d16_display(spark, d):
    k = F.col("entity_key")
    return B.vector_blocks(spark, d).select("entity_key", T.display_title(k).alias("title"), T.folder_trail(k).alias("trail"), T.last_heading(k).alias("heading"))


@_q("SELECT doc_id, substr(text, 1, 400) AS preview FROM documents")
def d17_preview(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@_q("SELECT event_id, CAST(floor(value / 1000 * 100 + 0.5) AS BIGINT) AS pct, CASE WHEN value / 100 >= 0.85 THEN 'high' WHEN value / 100 >= 0.85::DOUBLE - 0.15::DOUBLE THEN 'medium' ELSE 'low' END AS tier, CAST(least(50, greatest(1, floor(value + 0.5))) AS BIGINT) AS lim FROM events")
def d18_d20_scores(spark, d):
    v = F.col("value")
    return B.table(spark, d, "events").select("event_id", T.percent(v / 1000).alias("pct"), T.score_tier(v / 100).alias("tier"), T.clamp_limit(v.cast("string")).alias("lim"))


@_q("SELECT doc_id, lower(trim(source)) || '|' || lower(lang) || '|' AS fp FROM documents")
def d21_model_fingerprint(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.model_fingerprint(F.upper("source"), F.concat(F.lit(" "), "lang"), F.lit(None).cast("string")).alias("fp"))


@_q("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'h' ELSE sha256(" + _TRIM.format("substr(text, 1, 100000)") + ") END AS hash FROM documents")
def d22_synthetic_hash(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 2 == 0, "h"), T.content_hash(F.col("text"))).alias("hash"))


@_q("WITH " + B.NOTES + " SELECT path || '#a#b' AS entity_key, CASE WHEN doc_id % 2 = 0 THEN 'h' ELSE sha256(" + _TRIM.format("substr(replace(regexp_replace(path, '\\.md', ''), '/', ' > ') || ' > a' || chr(10) || text, 1, 100000)") + ") END AS embed_hash FROM notes")
def d22_hash_of_embed_input(spark, d):
    key = F.concat("path", F.lit("#a#b"))
    return B.notes(spark, d).select(key.alias("entity_key"), T.read_hash_or_own(F.when(F.col("doc_id") % 2 == 0, "h"), T.block_embed_input(key, F.col("text"))).alias("embed_hash"))


# --- store ---------------------------------------------------------------------------------------------------------------

_W = "WITH " + B.STAMPS + " "


@_q(_W + "SELECT e.entity_key, e.path, last_read_hash, s.embed_hash, s.dims, s.tokens FROM entities e LEFT JOIN (SELECT * FROM stamps WHERE model_key = 'm1') s USING (entity_key) WHERE entity_type = 'block'")
def a3_load_entities(spark, d):
    return ST.load_entities(B.entities(spark, d), B.stamps(spark, d), "block", "m1").select("entity_key", "path", "last_read_hash", "embed_hash", "dims", "tokens")


@_q(_W + "SELECT entity_key, array_to_string(vec::INT[], ',') AS vec, tokens FROM stamps WHERE model_key = 'm2' AND entity_key LIKE '%/en/%'")
def a4_load_vectors(spark, d):
    keys = B.entities(spark, d).where("entity_key like '%/en/%'")
    return ST.load_vectors(B.stamps(spark, d), keys, "m2").select("entity_key", F.array_join(F.col("vec").cast("array<int>"), ",").alias("vec"), "tokens")


@_q(_W + "SELECT entity_key, source_path FROM stamps JOIN entities USING (entity_key) WHERE model_key = 'm1' AND entity_type = 'block' AND dims = 4 AND embed_hash = last_read_hash")
def a5_searchable_vectors(spark, d):
    return ST.searchable_vectors(B.entities(spark, d), B.stamps(spark, d), "m1", "block", 4).select("entity_key", "source_path")


def _sized(spark, d, size: str) -> DataFrame:
    """Stamps with the size that was embedded, up to 399 more than it is now."""
    return B.stamps(spark, d).join(B.entities(spark, d).select("entity_key", size), "entity_key").withColumn("embed_size", F.col(size) + F.col("doc_id") % 400).drop(size)


@_q(_W + "SELECT e.entity_key, e.source_path FROM stamps s JOIN entities e USING (entity_key) WHERE s.model_key = 'm1' AND s.dims = 4 AND entity_type = 'block' AND (s.embed_hash = e.last_read_hash OR s.doc_id % 400 < 200)")
def a5_with_minor_changes(spark, d):
    return ST.searchable_vectors(B.entities(spark, d), _sized(spark, d, "last_read_size"), "m1", "block", 4, keep_minor_changes=200).select("entity_key", "source_path")


@_q(_W + "SELECT entity_key, path, source_path, 'paragraph-1' AS headings, head AS text FROM entities WHERE entity_type = 'block' AND entity_key IN (SELECT entity_key FROM stamps WHERE model_key = 'm1')")
def a6_load_block_meta(spark, d):
    return ST.load_block_meta(B.entities(spark, d), B.stamps(spark, d), "m1").withColumn("headings", F.array_join("headings", "|"))


@_q("SELECT CAST(max(len(embedding)) AS INT) AS dims FROM embeddings")
def a7_detect_dims(spark, d):
    return ST.detect_dims(B.table(spark, d, "embeddings").select(F.lit("m1").alias("model_key"), F.size("embedding").alias("dims")), "m1")


@_q("WITH " + B.ENTITIES + " SELECT entity_key, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE last_read_hash END AS last_read_hash FROM entities UNION ALL SELECT entity_key || '!', 'new' FROM entities WHERE doc_id % 6 = 0")
def a10_upsert_entities(spark, d):
    e = B.entities(spark, d)
    new = e.where("doc_id % 2 = 0").withColumn("last_read_hash", F.lit("new"))
    more = e.where("doc_id % 6 = 0").withColumn("entity_key", F.concat("entity_key", F.lit("!"))).withColumn("last_read_hash", F.lit("new"))
    return ST.upsert(e, new.unionByName(more), ["entity_key"]).select("entity_key", "last_read_hash")


@_q(_W + "SELECT entity_key, model_key, CASE WHEN doc_id % 2 = 0 AND model_key = 'm1' THEN (CASE WHEN doc_id % 6 = 0 THEN 'meta' ELSE last_read_hash END) ELSE embed_hash END AS embed_hash, CASE WHEN doc_id % 2 = 0 AND model_key = 'm1' THEN 4 ELSE dims END AS dims FROM (SELECT s.*, e.last_read_hash FROM stamps s JOIN entities e USING (entity_key))")
def a11_upsert_embeddings(spark, d):
    s = B.stamps(spark, d)
    batch = s.where("doc_id % 2 = 0 and model_key = 'm1'").join(B.entities(spark, d).select("entity_key", F.col("last_read_hash").alias("read_hash")), "entity_key")
    batch = batch.withColumn("meta_hash", F.when(F.col("doc_id") % 6 == 0, "meta")).withColumn("active_hash", F.lit(None).cast("string")).withColumn("dims", F.lit(None).cast("int"))
    return ST.upsert_embeddings(s.drop("doc_id"), batch).select("entity_key", "model_key", "embed_hash", "dims")


@_q(_W + "SELECT entity_key, model_key, array_to_string(vec::INT[], ',') AS vec, CASE WHEN doc_id % 2 = 0 AND model_key = 'm2' THEN 'stamp' ELSE embed_hash END AS embed_hash, updated_at FROM stamps")
def a12_update_stamps(spark, d):
    s = B.stamps(spark, d)
    batch = s.where("doc_id % 2 = 0 and model_key = 'm2'").select("entity_key", "model_key", F.lit("stamp").alias("embed_hash"), F.lit(None).cast("int").alias("dims"), F.lit(None).cast("bigint").alias("updated_at"))
    return ST.update_stamps(s, batch).select("entity_key", "model_key", F.array_join(F.col("vec").cast("array<int>"), ",").alias("vec"), "embed_hash", "updated_at")


@_q(_W + "SELECT entity_key, 'entity' AS kind FROM entities WHERE doc_id % 3 <> 0 UNION ALL SELECT entity_key, model_key FROM stamps WHERE doc_id % 3 <> 0")
def a13_delete_entities(spark, d):
    e, s = ST.delete_entities(B.entities(spark, d), B.stamps(spark, d), B.entities(spark, d).where("doc_id % 3 = 0"))
    return e.select("entity_key", F.lit("entity").alias("kind")).unionByName(s.select("entity_key", F.col("model_key").alias("kind")))


@_q(_W + "SELECT entity_key, model_key FROM stamps WHERE doc_id % 3 <> 0")
def a14_clear_embeddings(spark, d):
    return ST.clear_embeddings(B.stamps(spark, d), B.entities(spark, d).where("doc_id % 3 = 0")).select("entity_key", "model_key")


@_q("SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE array_to_string(list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1e6) AS BIGINT)), ',') END AS vec FROM embeddings")
def a15_vector_blobs(spark, d):
    blobs = ST.blobs_from_vectors(B.table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    broken = blobs.select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.substring("blob", 1, 7)).otherwise(F.col("blob")).alias("blob"))
    back = ST.vectors_from_blobs(broken, "blob")
    return back.select("vec_id", F.array_join(F.transform("vec", lambda x: F.round(x.cast("double") * 1e6).cast("bigint")), ",").alias("vec"))


@_q("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events")
def a16_parse_extra(spark, d):
    e = B.table(spark, d, "events").withColumn("props", F.when(F.col("event_id") % 10 == 0, "[1]").when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.col("props")))
    x = ST.parse_extra("props")
    return e.select("event_id", F.greatest(F.size(x), F.lit(0)).alias("n"), F.try_element_at(x, F.lit("k")).alias("k"))


@_q("WITH " + B.NOTES + ", " + _PARAGRAPHS.format("notes") + " SELECT entity_key, length AS text_len, CAST(start_line AS VARCHAR) AS start_line FROM pblocks")
def a17_pack_extra(spark, d):
    packed = ST.pack_extra(C.paragraph_blocks(B.notes(spark, d)))
    return packed.select("entity_key", "text_len", F.get_json_object("extra", "$.start_line").alias("start_line"))


@_q(_W + "SELECT entity_key, s.entity_key IS NOT NULL AND TRUE AS has FROM entities e LEFT JOIN (SELECT * FROM stamps WHERE model_key = 'm1') s USING (entity_key)")
def b16_has_embed(spark, d):
    j = ST.load_entities(B.entities(spark, d), B.stamps(spark, d), "block", "m1").unionByName(ST.load_entities(B.entities(spark, d), B.stamps(spark, d), "source", "m1"))
    vec = F.when(F.col("dims").isNotNull(), F.array(F.lit(1.0)))
    return j.select("entity_key", J.has_embed(vec, F.col("last_read_hash"), F.col("embed_hash")).alias("has"))


_STALE = "s.embed_hash IS NULL OR CASE WHEN s.embed_hash <> e.last_read_hash THEN s.updated_at // 10 % 400 >= 200 ELSE s.dims <> 4 END"


@_q(_W + "SELECT e.entity_key, " + _STALE + " AS stale FROM entities e LEFT JOIN (SELECT * FROM stamps WHERE model_key = 'm1') s ON e.entity_key = s.entity_key WHERE entity_type = 'block'")
def b17_is_unembedded(spark, d):
    j = ST.load_entities(B.entities(spark, d), B.stamps(spark, d), "block", "m1")
    return j.select("entity_key", J.is_unembedded(F.col("last_read_hash"), F.col("embed_hash"), F.col("last_read_size"), F.col("last_read_size") + F.expr("updated_at div 10 % 400"), F.col("dims"), F.lit(4), F.lit(200)).alias("stale"))


@_q("WITH " + B.ENTITIES + " SELECT entity_key FROM entities WHERE doc_id % 4 <> 0")
def b18_valid_rows(spark, d):
    return ST.valid_rows(B.entities(spark, d).withColumn("path", F.when(F.col("doc_id") % 4 != 0, F.col("path")).otherwise(F.lit("")))).select("entity_key")


@_q("WITH n AS (SELECT DISTINCT CASE lang WHEN 'en' THEN 'nomic-embed-' WHEN 'de' THEN 'chat-' WHEN 'fr' THEN 'bge:' ELSE 'x/text-embedding' END || source AS name, lang FROM documents) SELECT name, lang <> 'de' AS ok, name LIKE '%embed%' OR name LIKE '%bge%' AS keyword FROM n")
def b19_embedding_model_filter(spark, d):
    name = F.concat(F.when(F.col("lang") == "en", "nomic-embed-").when(F.col("lang") == "de", "chat-").when(F.col("lang") == "fr", "bge:").otherwise("x/text-embedding"), "source")
    return B.table(spark, d, "documents").select(name.alias("name")).distinct().select("name", T.is_embedding_model(F.col("name")).alias("ok"), T.has_embedding_keyword(F.col("name")).alias("keyword"))


@_q("WITH " + _SECTIONS + " SELECT entity_key FROM tblocks WHERE len(headings) > 2")
def e4_removed_blocks(spark, d):
    t = B.talks(spark, d)
    stored = C.chunk_notes(t)
    return ST.removed_blocks(stored, stored.where("size(headings) <= 2"), t.select(F.col("path").alias("source_path"))).select("entity_key")


@_q("WITH " + B.NOTES + ", l AS (SELECT count(*) AS n FROM notes WHERE doc_id % 3 = 0) SELECT CAST(least(n, 50) AS BIGINT) AS imported, CAST(greatest(n - 50, 0) AS BIGINT) AS remaining, n AS total FROM l")
def e5_sources_without_blocks(spark, d):
    n = B.notes(spark, d)
    return ST.sources_without_blocks(n, n.where("doc_id % 3 != 0").select(F.col("path").alias("source_path")), 50)[1]


@_q("WITH " + B.NOTES + ", " + B.FILES + ", " + B.KNOWN + " SELECT path FROM known JOIN files USING (path) WHERE known.mtime <> files.mtime OR known.size <> files.size")
def e6_stale_sources(spark, d):
    return ST.stale_sources(B.known(spark, d), B.files(spark, d))


@_q("WITH " + B.NOTES + ", " + B.FILES + ", " + B.KNOWN + ", j AS (SELECT f.path, k.read_hash AS old, k.mtime IS NOT NULL AND k.mtime = f.mtime AND k.size = f.size AS same, f.mtime, f.size, f.text FROM files f LEFT JOIN known k USING (path)), r AS (SELECT path, old, CASE WHEN old IS NULL THEN mtime || '-' || size WHEN same THEN old ELSE sha256(" + _TRIM.format("substr(text, 1, 100000)") + ") END AS read_hash FROM j) SELECT path, read_hash, old IS NULL OR old <> read_hash AS changed FROM r")
def e7_changed_sources(spark, d):
    return ST.changed_sources(B.known(spark, d), B.files(spark, d))


_FOLDERS = "folders AS (SELECT DISTINCT split_part(source_path, '/', 1) AS folder FROM vecs WHERE (vec_id // 5) % 10 IN (3, 8) UNION SELECT source_path FROM vecs WHERE (vec_id // 5) % 11 = 1)"


def _folders(v):
    n = F.floor(F.col("vec_id") / 5)
    top = v.where((n % 10).isin(3, 8)).select(F.split_part("source_path", F.lit("/"), F.lit(1)).alias("folder"))
    return top.unionByName(v.where(n % 11 == 1).select(F.col("source_path").alias("folder"))).distinct()


@_q("WITH " + B.VECTORS + ", " + _FOLDERS + " SELECT entity_key FROM vecs v WHERE NOT EXISTS (SELECT 1 FROM folders f WHERE v.source_path = f.folder OR starts_with(v.source_path, f.folder || '/'))")
def e11_cascade_excluded(spark, d):
    v = B.vector_blocks(spark, d)
    return ST.cascade_excluded(v, _folders(v)).select("entity_key")


@_q("WITH " + B.NOTES + ", " + B.FILES + ", " + B.KNOWN + """, gone AS (SELECT DISTINCT source AS folder FROM documents WHERE doc_id % 3 = 0 UNION SELECT DISTINCT source || '/' || lang FROM documents), stay AS (SELECT DISTINCT source || '/' || lang AS folder FROM documents WHERE lang = 'de')
SELECT path, 'upsert' AS action FROM files f WHERE EXISTS (SELECT 1 FROM gone g WHERE starts_with(f.path, g.folder || '/')) AND NOT EXISTS (SELECT 1 FROM stay s WHERE starts_with(f.path, s.folder || '/')) AND path NOT IN (SELECT path FROM known)""")
def e12_requeued(spark, d):
    docs = B.table(spark, d, "documents")
    sub = F.concat("source", F.lit("/"), "lang").alias("folder")
    removed = docs.where("doc_id % 3 = 0").select(F.col("source").alias("folder")).unionByName(docs.select(sub)).distinct()
    return ST.readmitted(B.files(spark, d), removed, docs.where("lang = 'de'").select(sub).distinct(), B.known(spark, d))


@_q("WITH " + B.NOTES + " SELECT path FROM notes WHERE path LIKE 'src5/de/%'")
def e12_readmitted(spark, d):
    return B.notes(spark, d).where(T.in_folder(F.col("path"), F.lit("src5/de"))).select("path")


@_q("WITH " + B.ENTITIES + " SELECT entity_key, doc_id % 4 = 1 AS skipped FROM entities")
def e13_recheck(spark, d):
    e = B.entities(spark, d).select("entity_key", F.col("last_read_hash").alias("read_hash"), "doc_id")
    expected = e.where("doc_id % 2 = 1").select("entity_key", F.when(F.col("doc_id") % 4 == 1, "other").otherwise(F.col("read_hash")).alias("expected_hash"))
    kept, skipped = J.recheck(e, expected)
    return kept.select("entity_key", F.lit(False).alias("skipped")).unionByName(skipped.select("entity_key", F.lit(True).alias("skipped")))


@_q("WITH " + B.ENTITIES + " SELECT count_if(doc_id % 10 = 0) AS missing, count_if(doc_id % 12 = 1) AS unknown, count_if(doc_id % 10 = 5) AS repeated FROM entities")
def e14_result_integrity(spark, d):
    e = B.entities(spark, d)
    results = e.where("doc_id % 10 != 0").select("entity_key").unionByName(e.where("doc_id % 10 = 5").select("entity_key")).unionByName(e.where("doc_id % 12 = 1").select(F.concat("entity_key", F.lit("?")).alias("entity_key")))
    return J.check_results(e, results)


@_q(_W + ", x AS (SELECT DISTINCT entity_key FROM stamps WHERE model_key = 'm1'), b AS (SELECT e.*, x.entity_key IS NOT NULL AS has FROM entities e LEFT JOIN x USING (entity_key) WHERE entity_type = 'block') SELECT (SELECT count(*) FROM notes) AS source_count, count(DISTINCT CASE WHEN has THEN source_path END) AS embedded_source_count, count(*) AS block_count, count_if(has) AS embedded_block_count FROM b")
def f4_collection_stats(spark, d):
    return R.collection_stats(B.notes(spark, d), B.entities(spark, d).where("entity_type = 'block'"), B.stamps(spark, d).where("model_key = 'm1'"))


@_q(_W + ", x AS (SELECT DISTINCT entity_key FROM stamps WHERE model_key = 'm1'), b AS (SELECT e.*, x.entity_key IS NOT NULL AS has FROM entities e LEFT JOIN x USING (entity_key) WHERE entity_type = 'block') SELECT true AS ready, true AS embed_ready, 'idle' AS status_state, CAST(NULL AS VARCHAR) AS runtime_state, CAST(NULL AS VARCHAR) AS endpoint_url, 'm1' AS model_key, 4 AS dims, (SELECT count(*) FROM notes) AS source_count, count(DISTINCT CASE WHEN has THEN source_path END) AS embedded_source_count, count(*) AS block_count, count_if(has) AS embedded_block_count FROM b")
def f7_status_report(spark, d):
    return R.status_report(f4_collection_stats(spark, d), model="m1", dims=4)


@_q("SELECT lang, count(*) AS total, count_if(doc_id % 3 = 0) AS embedded, count_if(doc_id % 2 = 0 AND lang <> 'es') AS embeddable, CASE WHEN count_if(doc_id % 2 = 0 AND lang <> 'es') > 0 THEN count_if(doc_id % 2 = 0 AND lang <> 'es') ELSE count(*) END AS effective_total, greatest(0, count(*) - count_if(doc_id % 3 = 0)) AS pending, CAST(floor(count_if(doc_id % 3 = 0) / count(*) * 100 + 0.5) AS BIGINT) AS pct FROM documents GROUP BY lang")
def f5_f6_progress(spark, d):
    t = B.table(spark, d, "documents").select("lang", (F.col("doc_id") % 3 == 0).alias("has_embed"), ((F.col("doc_id") % 2 == 0) & (F.col("lang") != "es")).alias("should_embed"))
    return R.progress(R.embedding_counts(t, ("lang",)))


_RUNS = "runs AS (SELECT user_id AS run_id, CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'skipped' ELSE 'ok' END AS status, epoch_us(ts) // 1000 AS ms, event_id % 97 = 0 AS fatal, event_id % 31 = 0 AS halted FROM events)"


@_q("WITH " + _RUNS + " SELECT run_id, count(*) AS total, count_if(status = 'ok') AS success, count_if(status = 'failed') AS failed, count_if(status = 'skipped') AS skipped, max(ms) - min(ms) AS duration_ms, CASE WHEN bool_or(fatal) THEN 'failed' WHEN bool_or(halted) THEN 'halted' ELSE 'completed' END AS outcome FROM runs GROUP BY run_id")
def f8_embed_run_summary(spark, d):
    i = F.col("event_id")
    e = B.table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.when(i % 5 == 0, "failed").when(i % 7 == 0, "skipped").otherwise("ok").alias("status"), F.unix_millis(F.col("ts").cast("timestamp")).alias("started"), (i % 97 == 0).alias("fatal"), (i % 31 == 0).alias("halted"))
    return J.run_summary(e.withColumn("finished", F.col("started")))


@_q("SELECT event_id, value * 10 / count(*) OVER (PARTITION BY user_id) AS tokens_per_item FROM events")
def f9_tokens_per_item(spark, d):
    e = B.table(spark, d, "events").select("event_id", F.col("user_id").alias("batch"), (F.col("value") * 10).alias("batch_tokens"))
    return R.tokens_per_item(e).select("event_id", "tokens_per_item")


@_q("""WITH RECURSIVE t AS (SELECT doc_id // 100 AS shard, doc_id AS pos, CAST(ceil(length(text) / 3.7::DOUBLE) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS k FROM documents),
f AS (SELECT shard, k, pos, tokens, 0 AS batch, greatest(coalesce(tokens, 0), 1) AS held FROM t WHERE k = 1
  UNION ALL SELECT t.shard, t.k, t.pos, t.tokens, CASE WHEN held + greatest(coalesce(t.tokens, 0), 1) > 2000 THEN batch + 1 ELSE batch END, CASE WHEN held + greatest(coalesce(t.tokens, 0), 1) > 2000 THEN greatest(coalesce(t.tokens, 0), 1) ELSE held + greatest(coalesce(t.tokens, 0), 1) END
  FROM f JOIN t ON t.shard = f.shard AND t.k = f.k + 1)
SELECT shard, pos, tokens, batch FROM f""")
def g8_token_batches(spark, d):
    t = B.table(spark, d, "documents").select((F.floor(F.col("doc_id") / 100)).alias("shard"), F.col("doc_id").alias("pos"), T.estimate_tokens(F.col("text")).alias("tokens"))
    return J.token_batches(t, 2000)


@_q("SELECT doc_id, CAST((row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1) // 10 AS INT) AS batch FROM documents")
def g9_fixed_batches(spark, d):
    t = B.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 100).alias("shard"), F.col("doc_id").alias("pos"))
    return J.fixed_batches(t).select(F.col("pos").alias("doc_id"), "batch")


@_q("WITH " + B.NOTES + " SELECT path FROM notes WHERE doc_id % 3 = 0 ORDER BY path LIMIT 20")
def h13_backlog(spark, d):
    n = B.notes(spark, d)
    return ST.sources_without_blocks(n, n.where("doc_id % 3 != 0").select(F.col("path").alias("source_path")), 20)[0]


@_q(_W + "SELECT e.entity_key FROM entities e LEFT JOIN (SELECT * FROM stamps WHERE model_key = 'm1') s ON e.entity_key = s.entity_key WHERE entity_type = 'block' AND text_len >= 300 AND (" + _STALE + ")")
def j1_embed_queue(spark, d):
    e = B.entities(spark, d).where("entity_type = 'block'").select("entity_key", F.col("last_read_hash").alias("read_hash"), F.col("text_len").alias("length"), (F.col("text_len") >= 300).alias("should_embed"))
    return J.embed_queue(e, _sized(spark, d, "text_len"), "m1", expected_dims=4, min_change=200).select("entity_key")


_TEXT = _TRIM.format("coalesce(text, '')")


@_q("WITH " + B.NOTES + f" SELECT path AS entity_key, CASE WHEN {_TEXT} = '' THEN 'skipped' ELSE 'ok' END AS status, CAST((length(coalesce(text, '')) * 10 + 36) // 37 AS INT) AS tokens, CASE WHEN {_TEXT} <> '' THEN 16 END AS dims FROM notes")
def j2_embed(spark, d):
    out = J.embed(B.notes(spark, d).select(F.col("path").alias("entity_key"), "text"), J.hashing_embedder())
    return out.select("entity_key", "status", "tokens", F.size("vec").alias("dims"))


@_q(_W + "SELECT entity_key, 'm1' AS model_key, sha256(text) AS embed_hash FROM (SELECT path AS entity_key, " + _TRIM.format("substr(text, 1, 100000)") + " AS text FROM notes) WHERE text <> ''")
def j5_stamp(spark, d):
    blocks = B.notes(spark, d).select(F.col("path").alias("entity_key"), "text", F.lit(None).cast("string").alias("read_hash"))
    return J.stamp(J.embed(blocks, J.hashing_embedder()), blocks, "m1", 1).select("entity_key", "model_key", "embed_hash")


@_q(_W + "SELECT entity_key, 16 AS dims, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS embed_size, CASE WHEN doc_id % 2 = 0 THEN mtime END AS embed_mtime, 'local' AS adapter, CASE WHEN doc_id % 2 = 0 THEN 'h' || doc_id ELSE sha256(text) END AS embed_hash FROM (SELECT doc_id, path AS entity_key, n_chars, mtime, " + _TRIM.format("substr(text, 1, 100000)") + " AS text FROM notes) WHERE text <> ''")
def j5_full_stamp(spark, d):
    read = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("h"), F.col("doc_id").cast("string")))
    blocks = B.notes(spark, d).select(F.col("path").alias("entity_key"), "text", read.alias("read_hash"), F.col("n_chars").alias("length"), "mtime")
    return J.stamp(J.embed(blocks, J.hashing_embedder()), blocks, "m1", 1, adapter="local").select("entity_key", "dims", "embed_size", "embed_mtime", "adapter", "embed_hash")


def _flaky() -> J.Embedder:
    """Its vector of a text is the number of calls that it took: by the text's length modulo 6 one to four, none at all (busy), or no vector."""

    def build():
        calls: dict[str, int] = {}

        def embed(texts, role):
            (t,) = texts
            calls[t] = n = calls.get(t, 0) + 1
            need = len(t) % 6 + 1
            if n < need and need < 6:
                if n > J.RETRIES:
                    del calls[t]
                raise J.Transient("busy", retry_after=0)
            del calls[t]
            if need == 6:
                raise J.Transient("no vector", retry_after=0)
            return [[float(n)]]

        return embed

    return J.Embedder(build, 1)


@_q("WITH " + B.NOTES + f""", n AS (SELECT path, {_TEXT} = '' AS blank, length(coalesce(text, '')) % 6 AS r FROM notes)
SELECT path AS entity_key, CASE WHEN blank THEN 'skipped' WHEN r > 3 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN NOT blank AND r <= 3 THEN r + 1 END::INT AS calls, CASE WHEN blank THEN NULL WHEN r = 4 THEN 'busy' WHEN r = 5 THEN 'no vector' END AS error FROM n""")
def j3_j4_retries(spark, d):
    out = J.embed(B.notes(spark, d).select(F.col("path").alias("entity_key"), "text"), _flaky(), batch=1, halt=False)
    return out.select("entity_key", "status", F.get("vec", F.lit(0)).cast("int").alias("calls"), "error")


@_q("WITH " + B.NOTES + f""", b AS (SELECT *, ('0x' || substr(md5(path), 1, 7))::BIGINT % 64 AS bucket FROM notes WHERE {_TEXT} <> ''), r AS (SELECT *, dense_rank() OVER (ORDER BY bucket) AS k FROM b)
SELECT path AS entity_key, CASE WHEN k <= 32 AND doc_id % 3 <> 0 THEN 1 ELSE 2 END::BIGINT AS updated_at, sha256(text) || CASE WHEN doc_id % 3 = 0 THEN '+' ELSE '' END AS embed_hash, 16 AS dims FROM r""")
def j7_j8_refresh_in_buckets(spark, d):
    """A run that is stopped after two saves, and one that goes on from there when a third of the notes has changed."""
    n = B.notes(spark, d)
    full = T.not_blank(F.col("text"))
    first = n.select(F.col("path").alias("entity_key"), "text", F.sha2("text", 256).alias("read_hash"), F.length("text").cast("bigint").alias("length"), F.coalesce(full, F.lit(False)).alias("should_embed"), "doc_id")
    then = first.withColumn("read_hash", F.when(F.col("doc_id") % 3 == 0, F.concat("read_hash", F.lit("+"))).otherwise(F.col("read_hash")))
    path, found = ST.shared_path(spark, "stamps"), J.hashing_embedder()
    J.refresh_buckets(spark, first, path, found, "m1", updated_at=1, at_once=16, saves=2)
    return J.refresh_buckets(spark, then, path, found, "m1", updated_at=2, at_once=16).select("entity_key", "updated_at", "embed_hash", "dims")


def _roles(dims: int) -> J.Embedder:
    """One space for both roles: passages as they are, queries in lower case."""

    def build():
        return lambda texts, role: [[float((t.lower() if role == "query" else t).count(c)) for c in _LETTERS[:dims]] for t in texts]

    return J.Embedder(build, dims, {"short": 2, "long": 5})


@_q("WITH " + B.NOTES + f""", n AS (SELECT path, text FROM notes WHERE {_TEXT} <> '')
SELECT path AS entity_key, 5 AS model_dims, 7 AS setting_dims, 3 AS own_dims, length(text) - length(replace(text, 'e', '')) AS in_passage, length(text) - length(replace(lower(text), 'e', '')) AS in_query FROM n""")
def k1_k2_embedders(spark, d):
    J.register("letters", J.hashing_embedder())
    J.register("letters", _roles(3))  # the last of a name wins
    dims = {"model_dims": J.embedder("letters", "long", 7)[1], "setting_dims": J.embedder("letters", setting_dims=7)[1], "own_dims": J.embedder("letters")[1]}
    found = J.embedder("letters")[0]
    n = B.notes(spark, d).select(F.col("path").alias("entity_key"), "text")
    both = [J.embed(n, found, role=role, halt=False).where("status = 'ok'").select("entity_key", F.get("vec", F.lit(0)).cast("bigint").alias(name)) for role, name in (("passage", "in_passage"), ("query", "in_query"))]
    return both[0].join(both[1], "entity_key").select("entity_key", *(F.lit(v).alias(k) for k, v in dims.items()), "in_passage", "in_query")


_MODELS = [("small", 384, 512, 1, 25), ("middle", 768, 2048, 1, 140), ("long", 512, 8192, 1, 35), ("wide", 1024, 8192, 4, 500)]


@_q("WITH m(model_key, dims, max_tokens, batch_size, size_mb) AS (VALUES " + ", ".join(f"('{k}', {a}, {b}, {c}, {z})" for k, a, b, c, z in _MODELS) + "), t AS (SELECT doc_id, CAST(ceil(length(text) / 3.7::DOUBLE) AS BIGINT) AS tokens FROM documents) SELECT doc_id, tokens, m.model_key, m.dims, m.batch_size FROM t LEFT JOIN m ON max_tokens >= tokens QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size_mb, model_key) = 1")
def k5_models_that_fit(spark, d):
    models = J.catalogue(spark, [J.Model(k, k, dims, most, batch, mb) for k, dims, most, batch, mb in _MODELS])
    return J.models_that_fit(B.table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens")), models)


@_q(_W + "SELECT entity_key, 'm2' AS model_key, '' AS embed_hash FROM entities WHERE entity_key NOT IN (SELECT entity_key FROM stamps WHERE model_key = 'm2')")
def j6_switch_model(spark, d):
    return J.switch_model(B.entities(spark, d), B.stamps(spark, d), "m2")


# --- search --------------------------------------------------------------------------------------------------------------

_SCORED = B.VECTORS + ", q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0), scored AS (SELECT vec_id, entity_key, source_path, label, round(list_cosine_similarity(vec::DOUBLE[], qv::DOUBLE[]), 6) AS score FROM vecs, q)"


def _vector(spark, d, vec_id: int = 0) -> list[float]:
    return list(B.table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first().embedding)


@_q("WITH " + _SCORED + " SELECT entity_key, score FROM scored ORDER BY score DESC, entity_key LIMIT 50")
def h1_nearest(spark, d):
    return S.nearest(B.vector_blocks(spark, d), _vector(spark, d)).select("entity_key", "score")


@_q("WITH " + _SCORED + " SELECT entity_key, score FROM scored WHERE entity_key LIKE 'folder1/%' AND entity_key NOT LIKE 'folder1/note-1%' AND vec_id % 3 <> 0 AND score >= 0.0 ORDER BY score DESC, entity_key LIMIT 50")
def b6_b8_filtered_nearest(spark, d):
    v = B.vector_blocks(spark, d)
    return S.nearest(v, _vector(spark, d), starts_with="folder1/", not_starts_with="folder1/note-1", exclude=v.where("vec_id % 3 = 0"), include=v.where("vec_id >= 0"), min_score=0.0).select("entity_key", "score")


@_q("WITH " + _SCORED + ", top AS (SELECT * FROM scored ORDER BY score DESC, entity_key LIMIT 60) SELECT entity_key, score FROM top WHERE label = 1 ORDER BY score DESC, entity_key LIMIT 10")
def b9_predicate_overfetch(spark, d):
    return S.nearest(B.vector_blocks(spark, d), _vector(spark, d), 10, where=F.col("label") == 1, overfetch=6).select("entity_key", "score")


@_q("WITH " + B.ENTITIES + " SELECT CASE entity_type WHEN 'source' THEN 'notes' ELSE 'blocks' END AS scope, count(*) AS n FROM entities GROUP BY ALL UNION ALL SELECT 'all', count(*) FROM entities")
def b12_scope(spark, d):
    e = B.entities(spark, d)
    parts = [S.scope(e, s).agg(F.count("*").alias("n")).select(F.lit(s).alias("scope"), "n") for s in ("all", "notes", "blocks")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_q("WITH " + _SCORED + " SELECT entity_key, score FROM scored WHERE vec_id <> 0 ORDER BY score DESC, entity_key LIMIT 20")
def h2_nearest_to(spark, d):
    return S.nearest_to(B.vector_blocks(spark, d), "folder0/note-0.md#paragraph-1", 20).select("entity_key", "score")


_KNN = B.VECTORS + ", s AS (SELECT q.vec_id AS query_id, c.entity_key, c.source_path, q.source_path AS own, round(list_cosine_similarity(q.vec::DOUBLE[], c.vec::DOUBLE[]), 6) AS score FROM vecs q, vecs c)"


@_q("WITH " + _KNN + " SELECT CAST(query_id AS VARCHAR) AS query_id, entity_key, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_key) AS INT) AS rank FROM s QUALIFY rank <= 10")
def h3_e8_g1_nearest_many(spark, d):
    v = B.vector_blocks(spark, d)
    return S.nearest_many(v.select(F.col("vec_id").alias("query_id"), "vec"), v, 10).select("query_id", "entity_key", "score", "rank")


@_q("WITH " + _SCORED + ", top AS (SELECT * FROM scored ORDER BY score DESC, entity_key LIMIT 40), best AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY score DESC, entity_key) = 1) SELECT entity_key, source_path, score FROM best ORDER BY score DESC, entity_key LIMIT 10")
def h4_f2_search_notes(spark, d):
    return S.search_notes(B.vector_blocks(spark, d), _vector(spark, d), 10).select("entity_key", "source_path", "score")


_MEANS = B.VECTORS + ", el AS (SELECT source_path, i, avg(vec[i]::DOUBLE)::FLOAT AS x FROM vecs, unnest(range(1, 65)) AS u(i) GROUP BY ALL), means AS (SELECT source_path, list(x ORDER BY i) AS vec FROM el GROUP BY source_path)"


@_q("WITH " + _MEANS + " SELECT source_path, array_to_string(list_transform(vec, lambda x: CAST(round(x::DOUBLE * 1e5) AS BIGINT)), ',') AS vec FROM means")
def f1_average_vector(spark, d):
    m = S.average_vectors(B.vector_blocks(spark, d))
    return m.select("source_path", F.array_join(F.transform("vec", lambda x: F.round(x.cast("double") * 1e5).cast("bigint")), ",").alias("vec"))


_CONN = _MEANS + """, pairs AS (SELECT m.source_path AS query_id, c.entity_key, c.source_path, round(list_cosine_similarity(m.vec::DOUBLE[], c.vec::DOUBLE[]), 6) AS score FROM means m, vecs c WHERE c.source_path <> m.source_path),
top AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_key) <= 15),
best AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY query_id, source_path ORDER BY score DESC, entity_key) = 1)"""


@_q("WITH " + _CONN + " SELECT entity_key, source_path, score FROM best WHERE query_id = 'folder7/note-7.md' ORDER BY score DESC, entity_key LIMIT 5")
def h5_connections(spark, d):
    return S.connections(B.vector_blocks(spark, d), "folder7/note-7.md", 5).select("entity_key", "source_path", "score")


@_q("WITH " + _CONN + " SELECT query_id, entity_key, source_path, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_key) AS INT) AS rank FROM best QUALIFY rank <= 5")
def h6_connections_all(spark, d):
    return S.connections_all(B.vector_blocks(spark, d), 5).select("query_id", "entity_key", "source_path", "score", "rank")


@_q("WITH " + _MEANS + """, asked AS (SELECT DISTINCT source_path AS path, n, CASE n WHEN 0 THEN (vec_id // 5) % 4 + 1 ELSE 5 END AS k, CASE n WHEN 0 THEN 'folder' || ((vec_id // 5) % 3) END AS folder, CASE n WHEN 1 THEN 0.1 END AS least FROM vecs, unnest([0, 1]) AS u(n)),
s AS (SELECT a.*, c.entity_key, c.source_path, round(list_cosine_similarity(m.vec::DOUBLE[], c.vec::DOUBLE[]), 6) AS score FROM asked a JOIN means m ON m.source_path = a.path JOIN vecs c ON c.source_path <> a.path AND (folder IS NULL OR starts_with(c.source_path, folder || '/'))),
top AS (SELECT * FROM s WHERE least IS NULL OR score >= least QUALIFY row_number() OVER (PARTITION BY path, n ORDER BY score DESC, entity_key) <= 3 * k),
best AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY path, n, source_path ORDER BY score DESC, entity_key) = 1)
SELECT path, n, entity_key, source_path, score, CAST(row_number() OVER (PARTITION BY path, n ORDER BY score DESC, entity_key) AS INT) AS rank FROM best QUALIFY rank <= k""")
def c11_embedded_connections(spark, d):
    v = B.vector_blocks(spark, d)
    i = F.floor(F.col("vec_id") / 5)
    text = F.concat(F.lit("see\n```related\nlimit: "), (i % 4 + 1).cast("string"), F.lit("\nfolder: folder"), (i % 3).cast("string"), F.lit("\n```\nand\n```related\nmin_score: 0.1\n```\n"))
    return S.embedded_connections(C.embedded_queries(v.select(F.col("source_path").alias("path"), text.alias("text")).distinct(), "related"), v)


_LETTERS = "etaoinshrdlu"


def _letter_counts(letters: str = _LETTERS) -> J.Embedder:
    """A text's vector: how often it has each letter."""

    def build():
        return lambda texts, role: [[float(t.count(c)) for c in letters] if any(c in t for c in letters) else None for t in texts]

    return J.Embedder(build, len(letters))


_LOOKUP = B.ENTITIES + ", v AS (SELECT entity_key, entity_type, e.doc_id, list_transform(['" + "','".join(_LETTERS) + """'], lambda c: CAST(length(text) - length(replace(text, c, '')) AS DOUBLE)) AS vec FROM entities e JOIN notes USING (doc_id)),
s AS (SELECT CAST(q.doc_id AS VARCHAR) AS query_id, c.entity_key, round(list_cosine_similarity(q.vec, c.vec), 6) AS score FROM v q JOIN v c ON CASE (q.doc_id // 100) % 3 WHEN 0 THEN true WHEN 1 THEN c.entity_type = 'source' ELSE c.entity_type = 'block' END
  WHERE q.doc_id % 100 = 0 AND list_sum(q.vec) > 0 AND list_sum(c.vec) > 0)"""


@_q("WITH " + _LOOKUP + " SELECT query_id, entity_key, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_key) AS INT) AS rank FROM s QUALIFY rank <= 20")
def h7_lookup_many(spark, d):
    found = _letter_counts()
    e = B.entities(spark, d).join(B.notes(spark, d).select("doc_id", "text"), "doc_id")
    stored = J.embed(e, found).where("status = 'ok'").join(e.select("entity_key", "entity_type", "source_path"), "entity_key")
    n = F.floor(F.col("doc_id") / 100) % 3
    texts = e.where("doc_id % 100 = 0").select(F.col("doc_id").cast("string").alias("query_id"), "text", F.when(n == 0, "all").when(n == 1, "notes").otherwise("blocks").alias("scope"))
    return S.lookup_many(texts, found, stored)[0].select("query_id", "entity_key", "score", "rank")


@_q()
def h7_lookup(spark, d):
    found = J.hashing_embedder(32)
    n = B.notes(spark, d)
    stored = J.embed(n.select(F.col("path").alias("entity_key"), "text"), found).where("status = 'ok'").select("entity_key", F.col("entity_key").alias("source_path"), "vec")
    parts = [stored.where(F.startswith("entity_key", F.lit("web/"))), stored]  # a collection and one that holds it too: each key once
    return S.lookup("the and of with", found.build(), parts)


@_q("WITH " + _SCORED + " SELECT entity_key, score, CAST(row_number() OVER (ORDER BY round(score, 9), entity_key) AS INT) AS pos FROM scored ORDER BY pos LIMIT 10")
def h9_ascending(spark, d):
    top = S.by_score(S.scored(B.vector_blocks(spark, d), _vector(spark, d)), ascending=True).limit(10)
    return top.select("entity_key", "score", F.row_number().over(Window.orderBy(F.round("score", 9), "entity_key")).alias("pos"))


@_q("WITH " + _SCORED + ", top AS (SELECT * FROM scored ORDER BY score DESC, entity_key LIMIT 20) SELECT entity_key, CAST(row_number() OVER (ORDER BY entity_key = 'folder0/note-0.md#paragraph-3' DESC, score DESC, entity_key) AS INT) AS pos FROM top")
def h8_pinned_first(spark, d):
    top = S.nearest(B.vector_blocks(spark, d), _vector(spark, d), 20)
    pin = ["folder0/note-0.md#paragraph-3"]
    order = Window.orderBy(F.col("entity_key").isin(*pin).desc(), F.desc("score"), "entity_key")  # 20 rows
    return S.pinned_first(top, pin).select("entity_key", F.row_number().over(order).alias("pos"))


@_q("WITH " + _SCORED + " SELECT entity_key, score, CAST(row_number() OVER (ORDER BY round(score, 1) DESC, entity_key) AS INT) AS pos FROM scored ORDER BY pos LIMIT 10")
def h9_h10_top_k(spark, d):
    v = S.scored(B.vector_blocks(spark, d), _vector(spark, d))
    top = v.orderBy(F.desc(F.round("score", 1)), "entity_key").limit(10)
    return top.select("entity_key", "score", F.row_number().over(Window.orderBy(F.desc(F.round("score", 1)), "entity_key")).alias("pos"))


@_q()
def h12_random_related(spark, d):
    return S.random_related(h5_connections(spark, d), 7)


@_q("WITH " + _SCORED + ", a AS (SELECT entity_key, score FROM scored WHERE vec_id % 2 = 0 ORDER BY score DESC, entity_key LIMIT 15), b AS (SELECT entity_key, score FROM scored WHERE vec_id % 3 = 0 ORDER BY score DESC, entity_key LIMIT 15) SELECT entity_key, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY entity_key ORDER BY score DESC, entity_key LIMIT 15")
def i1_g10_merge_results(spark, d):
    v, q = B.vector_blocks(spark, d), _vector(spark, d)
    return S.merge_results([S.scored(v.where("vec_id % 2 = 0"), q), S.scored(v.where("vec_id % 3 = 0"), q)], 15)


@_q("WITH " + _SCORED + ", top AS (SELECT * FROM scored ORDER BY score DESC, entity_key LIMIT 30) SELECT t.entity_key, t.score, t.source_path AS path, CASE WHEN vec_id % 2 = 0 THEN 'p' ELSE '' END AS headings, CASE WHEN vec_id % 2 = 0 THEN 'text ' || vec_id ELSE '' END AS preview FROM top t")
def e10_with_metadata(spark, d):
    v = B.vector_blocks(spark, d)
    meta = v.where("vec_id % 2 = 0").select("entity_key", F.col("source_path").alias("path"), F.array(F.lit("p")).alias("headings"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"))
    return S.with_metadata(S.nearest(v, _vector(spark, d), 30), meta).withColumn("headings", F.array_join("headings", "|"))


@_q("WITH " + _SCORED + ", top AS (SELECT * FROM scored ORDER BY score DESC, entity_key LIMIT 50), kept AS (SELECT * FROM top WHERE entity_key <> 'folder0/note-0.md#paragraph-1') SELECT split_part(source_path, '/', 1) AS folder, count(*) AS n FROM kept GROUP BY ALL")
def b11_f10_folder_facets(spark, d):
    hits = S.nearest(B.vector_blocks(spark, d), _vector(spark, d))
    return S.folder_facets(S.result_filter(hits, ["folder0/note-0.md#paragraph-1"]))


@_q("WITH " + _CONN + ", r AS (SELECT query_id, source_path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_key) AS rank FROM best QUALIFY rank <= 3) SELECT query_id, '## Smart Context: ' || regexp_extract(query_id, '([^/]*?)(\\.md)?$', 1) || chr(10) || chr(10) || string_agg('- [[' || regexp_replace(source_path, '\\.md$', '') || ']] (' || CAST(floor(score * 100 + 0.5) AS BIGINT) || '%)', chr(10) ORDER BY rank) AS text FROM r GROUP BY query_id")
def a18_f16_context_text(spark, d):
    hits = S.connections_all(B.vector_blocks(spark, d), 5).where("rank <= 3")
    name = F.regexp_extract(F.col("query_id").cast("string"), r"([^/]*?)(\.md)?$", 1)
    return R.context_text(hits.select("query_id", name.alias("name"), "rank", F.col("source_path").alias("path"), "score"))


# --- reports -------------------------------------------------------------------------------------------------------------

_STATES = {"signup": "startup-core", "view": "startup-background-import", "click": "note-switch-indexed"}
_NAMED = B.SAMPLES + ", named AS (SELECT * REPLACE (CASE state WHEN 'signup' THEN 'startup-core' WHEN 'view' THEN 'startup-background-import' WHEN 'click' THEN 'note-switch-indexed' ELSE state END AS state) FROM samples), sm AS (SELECT {by}, count(*) AS n, round(quantile_cont(ms, 0.5), 1) AS median, CASE WHEN count(ms) >= 3 THEN round(quantile_cont(ms, 0.95), 1) END AS p95, round(max(ms), 1) AS worst, round(quantile_cont(trigger_ms, 0.5), 1) AS trigger_median, round(max(trigger_ms), 1) AS trigger_worst, max(coalesce(settled_ms, ms)) AS settled, CAST(sum(timeouts) AS BIGINT) AS timeouts, CAST(sum(empty_polls) AS BIGINT) AS empty_polls, bool_or(frozen) AS frozen FROM named GROUP BY {by})"
_IMPACT = "CASE WHEN timeouts > 0 THEN 'interactive-blocker' WHEN state = 'startup-core' THEN if(empty_polls > 0, 'responsive-but-degraded', 'background') WHEN state = 'startup-background-import' THEN 'background' WHEN empty_polls > 0 THEN 'interactive-blocker' WHEN settled > 1000 THEN 'responsive-but-degraded' ELSE 'background' END AS impact FROM sm"


def _named_samples(spark, d):
    return B.samples(spark, d).replace({"signup": "startup-core", "view": "startup-background-import", "click": "note-switch-indexed"}, subset=["state"])


@_q("WITH " + _NAMED.format(by="state") + " SELECT *, " + _IMPACT)
def f12_f13_latency(spark, d):
    return R.latency_impact(R.latency_summary(_named_samples(spark, d)))


@_q("WITH " + _NAMED.format(by="state, run_id") + " SELECT state, run_id, n, " + _IMPACT)
def f13_impact_by_run(spark, d):
    return R.latency_impact(R.latency_summary(_named_samples(spark, d), by=("state", "run_id"))).select("state", "run_id", "n", "impact")


@_q("SELECT event_type AS command, round(avg(value), 1) AS mean, round(min(value), 1) AS least, round(max(value), 1) AS most FROM events GROUP BY 1")
def f14_timing_stats(spark, d):
    return R.timing_stats(B.table(spark, d, "events").select(F.col("event_type").alias("command"), F.col("value").alias("ms")))


@_q("SELECT user_id AS run_id, count(*) AS batches, count_if(event_type = 'error') AS failed_batches, max(value) AS slowest_mean FROM events GROUP BY 1")
def f15_batch_report(spark, d):
    return R.batch_report(B.table(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.col("event_type") == "error").alias("failed"), F.col("value").alias("mean_ms")))


@_q("WITH e AS (SELECT event_id, event_id % 7 <> 0 AS told, event_type, user_id % 50 AS mean, event_id % 3 = 0 AS bad FROM events) SELECT event_id AS run_id, CASE WHEN NOT told THEN 'unknown' WHEN bad THEN 'failed' ELSE 'passed' END AS status, CASE WHEN NOT told THEN 0 WHEN bad THEN 3 ELSE 1 END AS severity, CASE WHEN told THEN 'p' || event_id END AS artifact, CAST(CASE WHEN told THEN 2 ELSE 0 END AS BIGINT) AS batches, CAST(CASE WHEN told THEN 1 + CAST(event_type = 'failed' AS INT) ELSE 0 END AS BIGINT) AS failed_batches, CASE WHEN told THEN mean ELSE 0 END::DOUBLE AS slowest_mean FROM e")
def f15_run_logs(spark, d):
    e = B.table(spark, d, "events")
    head = F.concat(F.lit("RESULT: "), F.when(F.col("event_id") % 3 == 0, "FAIL").otherwise("PASS"), F.lit(" {x} \n"))
    block = F.format_string('{"artifactPath": "p%s", "batches": [{"status": "%s", "timing": {"connectionsView": {"meanMs": %s}}}, {"status": "failed"}]}', "event_id", "event_type", F.col("user_id") % 50)
    out = F.when(F.col("event_id") % 7 == 0, "nothing {here} to read").otherwise(F.concat(head, block))
    runs = e.select(F.col("event_id").alias("run_id"), out.alias("out"), F.lit(None).cast("string").alias("err"), F.lit(0).alias("code"), F.col("value").alias("ms"), F.lit(False).alias("timed_out"))
    return R.batch_reports(runs).select("run_id", "status", "severity", "artifact", "batches", "failed_batches", "slowest_mean")


@_q("WITH " + B.SAMPLES + ", begun AS (SELECT * FROM samples QUALIFY lag(state) OVER (PARTITION BY run_id ORDER BY ts, seq) IS DISTINCT FROM state) SELECT seq, state, greatest(0, coalesce(lead(ts) OVER (PARTITION BY run_id ORDER BY ts, seq) - ts, 0)) AS duration_ms FROM begun")
def g6_stage_durations(spark, d):
    return R.stage_durations(B.samples(spark, d)).select("seq", "state", "duration_ms")


@_q("WITH " + B.SAMPLES + " SELECT run_id, seq FROM samples QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, seq DESC) <= 12")
def g7_last_stages(spark, d):
    return R.last_stages(B.samples(spark, d)).select("run_id", "seq")


_LOGS = "logs AS (SELECT event_id, event_type, user_id % 3 AS code, CASE WHEN event_id % 7 > 0 THEN 'Completed in ' || (event_id % 90) || 's' || chr(10) ELSE '' END || 'Adapter: local a' || (event_id % 4) || chr(10) || 'Checks: ' || (event_id % 5) || '/5 passed' || chr(10) || CASE event_type WHEN 'click' THEN 'RESULT: PASS' WHEN 'view' THEN 'RESULT: PARTIAL' WHEN 'error' THEN 'possible freeze' WHEN 'purchase' THEN 'RESULT: FAIL' ELSE 'an error word' END AS out, value FROM events)"
_LAST = {"click": "RESULT: PASS", "view": "RESULT: PARTIAL", "error": "possible freeze", "purchase": "RESULT: FAIL"}


def _logs(spark, d):
    e = B.table(spark, d, "events")
    last = F.lit("an error word")
    for kind, text in _LAST.items():
        last = F.when(F.col("event_type") == kind, text).otherwise(last)
    took = F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("Completed in "), (F.col("event_id") % 90).cast("string"), F.lit("s\n"))).otherwise("")
    out = F.concat(took, F.lit("Adapter: local a"), (F.col("event_id") % 4).cast("string"), F.lit("\nChecks: "), (F.col("event_id") % 5).cast("string"), F.lit("/5 passed\n"), last)
    return e.select("event_id", (F.col("user_id") % 3).alias("code"), out.alias("out"), F.col("value").alias("ms"))


@_q("WITH " + _LOGS + " SELECT event_id, CASE WHEN event_type = 'error' THEN 'freeze_detected' WHEN event_type = 'click' THEN 'passed' WHEN event_type = 'view' THEN 'partial' WHEN event_type = 'purchase' OR code <> 0 THEN 'failed' ELSE 'unknown' END AS class, CAST(CASE WHEN event_id % 7 > 0 THEN event_id % 90 END AS DOUBLE) AS seconds, event_id % 5 AS checks, 'local a' || (event_id % 4) AS adapter FROM logs")
def l2_l3_classify_log(spark, d):
    m = R.extract_metrics(F.col("out"))
    return _logs(spark, d).select("event_id", R.classify_log(F.col("out"), F.lit(""), F.col("code")).alias("class"), m["seconds"].cast("double").alias("seconds"), m["checks"].alias("checks"), m["adapter"].alias("adapter"))


@_q("WITH " + _LOGS + " SELECT event_id, CASE WHEN event_type = 'error' THEN 4 WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN 2 WHEN event_type = 'purchase' OR code <> 0 THEN 3 ELSE 0 END AS severity, CASE WHEN event_id % 7 > 0 THEN event_id % 90 ELSE CAST(floor(value / 1000 + 0.5) AS BIGINT) END AS cost FROM logs")
def h11_rank_runs(spark, d):
    rows = _logs(spark, d).select("event_id", R.classify_log(F.col("out"), F.lit(""), F.col("code")).alias("class"), R.extract_metrics(F.col("out"))["seconds"].alias("seconds"), "ms")
    return R.rank_runs(rows).select("event_id", "severity", "cost")


@_q("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'ready' WHEN event_type = 'error' THEN 'unavailable' ELSE 'warming_up' END AS model, CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'idle' END AS backfill, CASE WHEN event_type = 'error' THEN if(user_id % 2 = 0, 'degraded', 'unavailable') ELSE if(user_id % 2 = 0, 'ready', 'loading') END AS serving, CASE event_type WHEN 'view' THEN 'embedding' WHEN 'error' THEN 'error' ELSE 'idle' END AS status, user_id % 2 = 0 AND event_type <> 'error' AS ready FROM events")
def l1_runtime_state(spark, d):
    t = F.col("event_type")
    phase = F.when(t == "view", "running").when(t == "error", "error").otherwise("idle")
    s = R.runtime_state(phase, F.when(F.col("user_id") % 2 == 0, "a/b"))
    return B.table(spark, d, "events").select("event_id", *(c.alias(k) for k, c in s.items()))


@_q("SELECT event_id, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'view' THEN 'quota' WHEN 'click' THEN 'download' WHEN 'signup' THEN 'model_not_found' ELSE 'unknown' END AS cause FROM events")
def l4_error_cause(spark, d):
    t = F.col("event_type")
    message = F.when(t == "error", "[download:timeout] network").when(t == "view", "x [Download:quota]").when(t == "click", "Failed to fetch").when(t == "signup", "[download:model_not_found]").otherwise("HTTP 429")
    return B.table(spark, d, "events").select("event_id", T.error_cause(message).alias("cause"))


@_q("SELECT DISTINCT label AS model, label || ' (64d)' AS shown FROM embeddings")
def k5_model_catalogue(spark, d):
    e = B.table(spark, d, "embeddings").groupBy(F.col("label").alias("model")).agg(F.max(F.size("embedding")).alias("dims"))
    return e.select("model", F.concat(F.col("model").cast("string"), F.lit(" ("), F.col("dims").cast("string"), F.lit("d)")).alias("shown"))


@_q("WITH t AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'tiktoken' WHEN 1 THEN 'char-estimate' ELSE 'other' END AS kind FROM documents) SELECT doc_id, CASE WHEN kind = 'tiktoken' AND instr(text, 'ä') = 0 THEN length(text) - length(replace(text, ' ', '')) ELSE CAST(ceil(length(text) / 3.7::DOUBLE) AS BIGINT) END AS tokens, CAST(CASE WHEN doc_id % 5 = 0 THEN 0.5 WHEN kind = 'tiktoken' THEN 0.95 WHEN kind = 'char-estimate' THEN 0.75 ELSE 0.85 END AS DOUBLE) AS ratio FROM t")
def k4_count_tokens(spark, d):
    def build():
        def spaces(text: str) -> int:
            if "ä" in text:
                raise ValueError("unknown symbol")
            return text.count(" ")

        return spaces

    kind = F.when(F.col("doc_id") % 3 == 0, "tiktoken").when(F.col("doc_id") % 3 == 1, "char-estimate").otherwise("other")
    return B.table(spark, d, "documents").select("doc_id", T.count_tokens(F.col("text"), kind, T.exact_counter(build)).alias("tokens"), T.safety_ratio(kind, F.when(F.col("doc_id") % 5 == 0, 0.5)).alias("ratio"))


# --- streams, in their batch form -----------------------------------------------------------------------------------------


@_q("WITH " + B.CHANGES + " SELECT path, action, count(*) AS n FROM acts GROUP BY ALL")
def m1_change_stream(spark, d):
    return M.change_stream(B.changes(spark, d)).groupBy("path", "action").agg(F.count("*").alias("n"))


@_q("WITH ev AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM ev) SELECT user_id, epoch_us(min(ts)) // 1000 AS started, count(*) AS n FROM s GROUP BY user_id, k")
def m2_debounce(spark, d):
    out = M.debounce(B.changes(spark, d), "6 hours", by=("user_id",))
    return out.select("user_id", F.unix_millis("session.start").alias("started"), "n")


@_q("WITH " + B.CHANGES + """, up AS (SELECT ts, CASE WHEN lag(ts) OVER (ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (ORDER BY ts) + INTERVAL 13 SECOND THEN 1 ELSE 0 END AS new FROM acts WHERE action = 'upsert'),
s AS (SELECT min(ts) AS a, max(ts) + INTERVAL 13 SECOND AS z FROM (SELECT ts, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM up) GROUP BY k),
l AS (SELECT s.a, path, max((acts.ts, action)) AS m FROM s JOIN acts ON acts.ts >= s.a AND acts.ts < s.z GROUP BY s.a, path)
SELECT epoch_us(a) // 1000 AS started, path FROM l WHERE m[2] = 'upsert'""")
def m2_firings(spark, d):
    rows = M.last_of_firing(M.firings(M.change_stream(B.changes(spark, d)), tick="1 microsecond"))
    return rows.select(F.unix_millis("session.start").alias("started"), "path")


@_q("WITH " + B.CHANGES + " SELECT path, action FROM acts QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, action DESC) = 1")
def m3_latest_change(spark, d):
    return M.latest_change(M.change_stream(B.changes(spark, d))).select("path", "action")


@_q("WITH " + B.CHANGES + " SELECT DISTINCT path FROM acts")
def i3_pending(spark, d):
    c = M.change_stream(B.changes(spark, d))
    return M.pending(c.where("action = 'upsert'"), c.where("action = 'delete'"))


@_q("WITH " + B.NOTES + ", " + _PARAGRAPHS.format("(SELECT path, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || chr(10) || text ELSE text END AS text FROM notes WHERE doc_id % 7 <> 0)") + " SELECT entity_key, length FROM pblocks")
def m4_refresh_blocks(spark, d):
    n = B.notes(spark, d)
    blocks = C.paragraph_blocks(n)
    now = F.timestamp_millis(F.col("mtime"))
    changes = n.where("doc_id % 7 = 0").select(now.alias("ts"), F.lit("delete").alias("action"), "path").unionByName(n.where("doc_id % 5 = 0 and doc_id % 7 != 0").select(now.alias("ts"), F.lit("upsert").alias("action"), "path"))
    contents = n.select("path", F.concat("text", F.lit("\n\n"), "text").alias("text"))
    return M.refresh_blocks(blocks, changes, contents, C.paragraph_blocks).select("entity_key", "length")


@_q("SELECT user_id AS run_id, max_by(event_id, (ts, event_id)) AS done, CAST(floor(max_by(event_id, (ts, event_id)) / 200000 * 100 + 0.5) AS BIGINT) AS pct FROM events GROUP BY 1")
def m6_progress_stream(spark, d):
    e = B.table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("done"), F.lit(200000).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("started"))
    return M.progress_stream(e).select("run_id", "done", "pct")


@_q("WITH " + B.NOTES + ", " + B.FILES + ", " + B.KNOWN + " SELECT path, CASE WHEN files.path IS NULL THEN 'delete' ELSE 'upsert' END AS action FROM known FULL JOIN files USING (path) WHERE known.path IS NULL OR files.path IS NULL OR known.mtime <> files.mtime OR known.size <> files.size")
def m5_catch_up(spark, d):
    return M.catch_up(B.known(spark, d), B.files(spark, d))


@_q("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'signup')")
def m5_after_discovery(spark, d):
    c = B.changes(spark, d)
    return M.after_discovery(c, c.where("op = 'create'").select("ts")).select("event_id")
