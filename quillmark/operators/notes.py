"""Sources of notes, and reading single notes."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from quillmark.functions.text import file_type, is_excluded

MULTI_GET_MOST = 20


def scan_notes(spark: SparkSession, directory: str, glob: str = "*.md") -> DataFrame:
    """(path, text, extension, size, mtime) of the note files below a directory; paths are relative to it."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(directory)
    meta = files.select("value", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    base = directory.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.url_decode("file_path"), "^[a-z0-9]+:/+", "")
    path = F.substr(path, F.lit(len(base) + 2)) if base else path
    return meta.select(path.alias("path"), F.col("value").alias("text"), F.col("file_size").alias("size"), F.unix_millis("file_modification_time").alias("mtime")).withColumn("extension", file_type(F.col("path")))


def notes_from_table(df: DataFrame, path: Column, text: Column, mtime: Column | None = None) -> DataFrame:
    out = df.select(path.alias("path"), text.alias("text"), (mtime if mtime is not None else F.lit(None).cast("bigint")).alias("mtime"))
    return out.select("path", "text", file_type(F.col("path")).alias("extension"), F.length("text").cast("bigint").alias("size"), "mtime")


def exclude_paths(df: DataFrame, folders: str = "", files: str = "") -> DataFrame:
    return df.where(~is_excluded(F.col("path"), F.lit(folders), F.lit(files)))


def source_type_filter(df: DataFrame, folders: str = "", files: str = "", types: tuple = ("md", "txt")) -> DataFrame:
    return exclude_paths(df.where(F.lower(file_type(F.col("path"))).isin(*types)), folders, files)


def read_note(notes: DataFrame, path: str) -> DataFrame:
    """One row: the note, or a row that says that it isn't there."""
    asked = notes.sparkSession.createDataFrame([(path,)], "path string")
    hit = notes.where(F.col("path") == path).select("path", "text", F.lit(True).alias("found"))
    return asked.join(hit, "path", "left").select("path", "text", F.coalesce("found", F.lit(False)).alias("found"))


def multi_get(notes: DataFrame, paths: list[str]) -> DataFrame:
    """(pos, path, status, text) for the first 20 paths that aren't blank, in the order asked."""
    asked = notes.sparkSession.createDataFrame([(i, p) for i, p in enumerate([p for p in paths if p.strip()][:MULTI_GET_MOST])], "pos int, path string")
    return F.broadcast(asked).join(notes.select("path", "text"), "path", "left").select("pos", "path", F.when(F.col("text").isNull(), "note_not_found").otherwise("ok").alias("status"), "text").orderBy("pos")


def new_sources(found: DataFrame, known: DataFrame, key: str = "path") -> DataFrame:
    return found.join(known.select(key), key, "left_anti")


def list_folders(notes: DataFrame, without: tuple = (".obsidian",)) -> DataFrame:
    """Distinct folders of all notes, parents included."""
    parts = F.split("path", "/")
    every = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    folders = notes.select(F.explode(every).alias("folder")).distinct()
    return folders.where(~F.split_part("folder", F.lit("/"), F.lit(1)).isin(*without))


def exclude_headings(blocks: DataFrame, headings: list[str], included_sources: DataFrame | None = None) -> DataFrame:
    out = blocks.where(~F.arrays_overlap("headings", F.array(*map(F.lit, headings)))) if headings else blocks
    return out if included_sources is None else out.join(included_sources.select(F.col("path").alias("source_path")), "source_path", "left_semi")


def blocks_of(blocks: DataFrame, source: str) -> DataFrame:
    return blocks.where(F.col("source_path") == source)
