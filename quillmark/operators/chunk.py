"""Notes into blocks. Every step works on the arrays of one row, so that chunking never shuffles."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from quillmark.functions.text import WHITE, content_hash

# Sizes from which paragraphs are kept and sections are split.
PARAGRAPH_CHARS, SECTION_SPLIT_CHARS, SECTION_PARAGRAPH_CHARS = 100, 1000, 200
MAX_DEPTH = 3


def _blank(line: Column) -> Column:
    return ~line.rlike(f"[^{WHITE}]")


def _joined(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")


def _stretches(stop: Column) -> Column:
    """[first, last] of each run of places whose flag in ``stop``, a column that is computed already, is false."""
    n = F.size(stop)
    places = F.sequence(F.lit(0), n - 1)
    first = F.filter(places, lambda i: ~F.get(stop, i) & ((i == 0) | F.coalesce(F.get(stop, i - 1), F.lit(True))))
    last = F.filter(places, lambda i: ~F.get(stop, i) & ((i == n - 1) | F.coalesce(F.get(stop, i + 1), F.lit(True))))
    return F.when(n > 0, F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), b.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def with_headings(notes: DataFrame) -> DataFrame:
    """Adds ``lines`` and ``headings``: ATX headings outside fenced code as (line, level, heading)."""
    out = notes.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    out = out.withColumn("_fence", F.filter(places, lambda i: F.get("lines", i).rlike(r"^\s{0,3}(```|~~~)")))
    found = F.filter(places, lambda i: F.get("lines", i).rlike(r"^#{1,6}\s+\S"))
    out = out.withColumn("_heads", F.filter(found, lambda i: F.size(F.filter("_fence", lambda x: x < i)) % 2 == 0))
    heading = F.transform("_heads", lambda i: F.struct(i.alias("line"), F.length(F.regexp_extract(F.get("lines", i), "^(#+)", 1)).alias("level"), F.regexp_replace(F.regexp_extract(F.get("lines", i), r"^#+\s+(.*?)\s*$", 1), r"\s+#+$", "").alias("heading")))
    return out.withColumn("headings", heading).drop("_fence", "_heads")


def extract_headings(notes: DataFrame) -> DataFrame:
    return with_headings(notes).select("path", F.inline("headings"))


def section_ranges(notes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(path, headings, start, end) of every heading up to ``max_depth``: to before the next one of its level or above."""
    return _sections(notes, max_depth).drop("text")


def _sections(notes: DataFrame, max_depth: int) -> DataFrame:
    """``section_ranges`` with the text of each: sections are finished in the note's row, so no lines are copied."""
    heads = with_headings(notes).where(F.size("headings") > 0)
    empty = F.array().cast("array<string>")

    def section(h: Column, i: Column) -> Column:
        later = F.filter(F.slice("headings", i + 2, F.size("headings")), lambda x: x["level"] <= h["level"])
        end = F.coalesce(F.get(later, 0)["line"], F.size("lines")) - 1
        zero = F.struct(h["level"].alias("level"), empty.alias("path"))
        above = F.aggregate(
            F.reverse(F.slice("headings", 1, i)),
            zero,
            lambda a, x: F.struct(F.least(a["level"], x["level"]).alias("level"), F.when((x["level"] < a["level"]) & (x["level"] <= max_depth), F.concat(F.array(x["heading"]), a["path"])).otherwise(a["path"]).alias("path")),
        )
        return F.struct(h["level"].alias("level"), F.concat(above["path"], F.array(h["heading"])).alias("headings"), h["line"].alias("start"), end.alias("end"))

    kept = F.filter(F.transform("headings", section), lambda s: s["level"] <= max_depth)
    whole = F.transform(kept, lambda s: F.struct(s["headings"].alias("headings"), s["start"].alias("start"), s["end"].alias("end"), _joined(F.col("lines"), s["start"], s["end"]).alias("text")))
    return heads.select("path", F.inline(whole))


def _block(key: Column, source: Column, text: Column, start: Column, end: Column, headings: Column) -> list[Column]:
    return [key.alias("entity_key"), source.alias("source_path"), text.alias("text"), F.length(text).cast("bigint").alias("length"), start.cast("bigint").alias("start_line"), end.cast("bigint").alias("end_line"), headings.alias("headings")]


def section_blocks(notes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    found = _sections(notes, max_depth).where(~_blank(F.col("text")))
    key = F.concat(F.col("path"), F.array_join(F.transform("headings", lambda h: F.concat(F.lit("#"), h)), ""))
    return found.select(*_block(key, F.col("path"), F.col("text"), F.col("start"), F.col("end"), F.col("headings")))


def paragraph_blocks(notes: DataFrame, min_chars: int = PARAGRAPH_CHARS) -> DataFrame:
    """Paragraphs of notes, numbered among all, kept from ``min_chars`` characters."""
    lines = notes.select("path", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines")).withColumn("stop", F.transform("lines", _blank))
    runs = F.transform(_stretches(F.col("stop")), lambda p, i: F.struct((i + 1).alias("n"), p["start"].alias("s"), p["end"].alias("e"), _joined(F.col("lines"), p["start"], p["end"]).alias("text")))
    found = lines.select("path", F.inline(F.filter(runs, lambda p: F.length(p["text"]) >= min_chars)))
    name = F.concat(F.lit("paragraph-"), F.col("n").cast("string"))
    return found.select(*_block(F.concat(F.col("path"), F.lit("#"), name), F.col("path"), F.col("text"), F.col("s"), F.col("e"), F.array(name)))


def section_paragraphs(sections: DataFrame, split_chars: int = SECTION_SPLIT_CHARS, min_chars: int = SECTION_PARAGRAPH_CHARS) -> DataFrame:
    """Paragraphs of long sections, numbered among the kept ones; blank lines and lines that start with '#' divide."""
    big = sections.where(F.col("length") > split_chars).withColumn("_lines", F.slice(F.split("text", "\n", -1), 2, 2**31 - 1))
    big = big.where(F.size("_lines") > 0).withColumn("_stop", F.transform("_lines", lambda x: _blank(x) | x.rlike(f"^[{WHITE}]*#")))
    runs = F.transform(_stretches(F.col("_stop")), lambda p: F.struct(_joined(F.col("_lines"), p["start"], p["end"]).alias("text"), p["start"].alias("start"), p["end"].alias("end")))
    kept = F.filter(runs, lambda p: F.length(p["text"]) > min_chars)
    found = big.select("source_path", "headings", "start_line", F.posexplode(kept).alias("n", "p"))
    name = F.concat(F.lit("paragraph-"), (F.col("n") + 1).cast("string"))
    found = found.select("source_path", F.concat("headings", F.array(name)).alias("headings"), (F.col("start_line") + 1 + F.col("p.start")).alias("s"), (F.col("start_line") + 1 + F.col("p.end")).alias("e"), F.col("p.text").alias("text"))
    key = F.concat(F.col("source_path"), F.array_join(F.transform("headings", lambda h: F.concat(F.lit("#"), h)), ""))
    return found.select(*_block(key, F.col("source_path"), F.col("text"), F.col("s"), F.col("e"), F.col("headings")))


def dedupe_keys(blocks: DataFrame) -> DataFrame:
    """Of blocks with one key the last stays."""
    last = Window.partitionBy("entity_key").orderBy(F.desc("start_line"), F.desc("end_line"))
    return blocks.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def chunk_notes(notes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Sections and their paragraphs for notes with headings, paragraphs for the others; one row per key, with its hash.

    Lines are looked at for headings and fences only in notes where one search over the text finds what may be a heading."""
    rows = notes.select("path", "text").withColumn("_maybe", F.coalesce(F.contains("text", F.lit("#")) & F.col("text").rlike(r"(^|\n)#{1,6}\s+\S"), F.lit(False)))
    flagged = with_headings(rows.where("_maybe").select("path", "text")).withColumn("_has", F.size("headings") > 0).select("path", "text", "_has")
    sections = section_blocks(flagged.where("_has"), max_depth)
    blocks = sections.unionByName(section_paragraphs(sections))
    for plain in (flagged.where("not _has"), rows.where("not _maybe")):
        blocks = blocks.unionByName(paragraph_blocks(plain))
    return dedupe_keys(blocks).withColumn("read_hash", content_hash(F.col("text")))


def block_text(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """Stored text, else the lines of the note, else a fixed remark."""
    lines = notes.select(F.col("path").alias("source_path"), F.split("text", "\n", -1).alias("_lines"))
    cut = F.when(F.col("start_line").isNotNull(), _joined(F.col("_lines"), F.col("start_line").cast("int"), F.col("end_line").cast("int")))
    return blocks.join(lines, "source_path", "left").withColumn("text", F.coalesce("text", cut, F.lit("BLOCK NOT FOUND"))).drop("_lines")


def paragraph_coverage(blocks: DataFrame) -> DataFrame:
    """(entity_key, covered): characters of paragraph blocks below each heading key."""
    parts = F.split("entity_key", "#", -1)
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "#"))
    rows = blocks.where(F.contains("entity_key", F.lit("#paragraph-")) & (F.size(parts) > 2)).select(F.explode(above).alias("entity_key"), "length")
    return rows.groupBy("entity_key").agg(F.sum("length").alias("covered"))


def eligible_blocks(blocks: DataFrame, min_chars: int = 300, covered: float = 0.9) -> DataFrame:
    """Adds ``should_embed``: large enough, and a paragraph or not mostly covered by paragraphs of its own."""
    joined = blocks.join(paragraph_coverage(blocks), "entity_key", "left")
    ok = (F.col("length") >= (min_chars or 300)) & (F.contains("entity_key", F.lit("#paragraph-")) | (F.coalesce("covered", F.lit(0)) / F.col("length") < covered))
    return joined.withColumn("should_embed", ok).drop("covered")


def outlinks(notes: DataFrame) -> DataFrame:
    """(path, target) of wiki links that don't lead to the web."""
    return notes.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|#]+)"), F.lit(1))).alias("target")).where(~F.startswith("target", F.lit("http")))


def embedded_queries(notes: DataFrame, fence: str, limit: int = 5) -> DataFrame:
    """(path, n, settings, row_limit) of query blocks in notes, fenced under the name ``fence``; settings are 'key: value' lines."""
    found = notes.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s)```{fence}[^\n]*\n(.*?)```"), F.lit(1))).alias("n", "body"))
    lines = F.filter(F.split("body", "\n"), lambda x: F.contains(x, F.lit(":")))
    pair = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, F.lit(":")) + 1)).alias("v")))
    settings = F.map_from_entries(F.filter(pair, lambda p: p["k"] != ""))
    return found.select("path", "n", settings.alias("settings")).withColumn("row_limit", F.coalesce(F.try_element_at("settings", F.lit("limit")).try_cast("int"), F.lit(limit)))
