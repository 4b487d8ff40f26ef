"""Text rules of the note index as Column expressions; only a user's own tokenizer needs a Python UDF."""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, SparkSession

# The white space that trimming removes, thresholds, and folder names that are always left out.
WHITE = r"\t\n\x0B\f\r    -     　﻿"
HASHED_CHARS = 100_000
SOURCE_INPUT_CHARS = 1850
PREVIEW_CHARS = 400
DEFAULT_MAX_TOKENS = 8191
BATCH_BYTES = 4_000_000
ALWAYS_EXCLUDED = ("node_modules", ".trash", ".git")


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def not_blank(c: Column) -> Column:
    """Whether ``trim_all`` leaves anything; found at the first character that it leaves."""
    return c.rlike(f"[^{WHITE}]")


def content_hash(text: Column) -> Column:
    """sha256 hex of the trimmed first 100,000 characters."""
    return F.sha2(trim_all(F.substring(text, 1, HASHED_CHARS)), 256)


def read_hash_or_own(read_hash: Column, embed_input: Column) -> Column:
    """The hash of what was read; where that is missing, of the text that is embedded. Null where there is neither."""
    return F.coalesce(F.when(read_hash != "", read_hash), F.when(embed_input != "", content_hash(embed_input)))


def source_key(key: Column) -> Column:
    return F.substring_index(key, "#", 1)


def first_replaced(c: Column, old: str, new: str) -> Column:
    """The first occurrence only."""
    at = F.instr(c, F.lit(old))
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), F.lit(new), F.substr(c, at + len(old)))).otherwise(c)


def breadcrumbs(key: Column) -> Column:
    """Path and headings joined by ' > ', without the last heading and the first '.md'."""
    parts = F.split(F.replace(key, F.lit("/"), F.lit(" > ")), "#", -1)
    return first_replaced(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " > "), ".md", "")


def block_embed_input(key: Column, text: Column) -> Column:
    return F.concat(breadcrumbs(key), F.lit("\n"), text)


def source_embed_input(path: Column, text: Column) -> Column:
    crumbs = first_replaced(F.replace(path, F.lit("/"), F.lit(" > ")), ".md", "")
    return F.substring(F.concat(crumbs, F.lit(":\n"), text), 1, SOURCE_INPUT_CHARS)


def estimate_tokens(text: Column, chars_per_token: Column | float = 3.7) -> Column:
    cpt = chars_per_token if isinstance(chars_per_token, Column) else F.lit(float(chars_per_token))
    return F.ceil(F.length(text) / cpt).cast("bigint")


def count_tokens(text: Column, kind: Column, exact: Callable[[Column], Column] | None = None, chars_per_token: Column | float = 3.7) -> Column:
    """Where ``kind`` is tiktoken the tokens that ``exact`` counts, with the estimate where it gives null; else the estimate."""
    estimate = estimate_tokens(text, chars_per_token)
    return estimate if exact is None else F.when(kind == "tiktoken", F.coalesce(exact(text).cast("bigint"), estimate)).otherwise(estimate)


def bounded_batches(spark: SparkSession | None) -> None:
    """Arrow batches of this session end at ``BATCH_BYTES``: 10,000 long texts would fill the memory of a task."""
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def exact_counter(build: Callable[[], Callable[[str], int]]) -> Callable[[Column], Column]:
    """A counter for ``count_tokens`` from a tokenizer built once a task; null where building or counting fails, and for null texts."""
    bounded_batches(SparkSession.getActiveSession())

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            one = build()
        except Exception:  # whatever a user's tokenizer raises, the estimate stands in
            one = None

        def tokens(text: str | None) -> int | None:
            try:
                return None if one is None or text is None else one(text)
            except Exception:
                return None

        for texts in batches:
            yield pd.Series([tokens(t) for t in texts], dtype="Int64")

    return count


def safety_ratio(kind: Column, own: Column) -> Column:
    """The model's own ratio, else that of its kind of tokenizer."""
    return F.coalesce(own, F.when(kind == "tiktoken", 0.95).when(kind == "char-estimate", 0.75).otherwise(0.85))


def request_budget(max_tokens: Column, safety: Column) -> Column:
    limit = F.when(F.coalesce(max_tokens, F.lit(0)) == 0, F.lit(DEFAULT_MAX_TOKENS)).otherwise(max_tokens)
    return F.greatest(F.lit(1), F.floor(limit * safety)).cast("bigint")


def _cut_at_space(text: Column, chars: Column) -> Column:
    """The first ``chars`` characters, back to the last space if there is one past the start."""
    head = F.substr(text, F.lit(1), chars)
    space = F.length(head) - F.instr(F.reverse(head), F.lit(" ")) + 1
    return F.when((F.instr(head, F.lit(" ")) > 0) & (space > 1), F.substr(head, F.lit(1), space - 1)).otherwise(head)


def trim_to_tokens(text: Column, max_tokens: Column | int, chars_per_token: float = 3.7) -> Column:
    """Up to five cuts by the excess share and a tenth more, at most half each; null where the text still doesn't fit."""
    most = max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens)

    def step(t: Column, _: Column) -> Column:
        tokens = estimate_tokens(t, chars_per_token)
        ratio = F.least(F.lit(0.5), (tokens - most) / tokens + 0.10)
        return F.when(tokens <= most, t).otherwise(_cut_at_space(t, F.floor(F.length(t) * (1 - ratio)).cast("int")))

    cut = F.aggregate(F.sequence(F.lit(1), F.lit(5)), text, step)
    return F.when((F.length(cut) > 0) & (estimate_tokens(cut, chars_per_token) <= most), cut)


def shrink_to_tokens(text: Column, max_tokens: int, chars_per_token: float = 3.7, rounds: int = 40) -> Column:
    """Cuts to nine tenths of the share that fits until the estimate fits."""
    most = F.lit(max_tokens)

    def step(t: Column, _: Column) -> Column:
        tokens = estimate_tokens(t, chars_per_token)
        return F.when(tokens <= most, t).otherwise(_cut_at_space(t, F.floor(F.length(t) * (most / tokens * 0.9)).cast("int")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), text, step)


def title_body(text: Column) -> tuple[Column, Column]:
    """First line as title, the trimmed rest as body; without a rest the title is the text itself."""
    title, rest = trim_all(F.substring_index(text, "\n", 1)), trim_all(F.substr(text, F.instr(text, F.lit("\n")) + 1))
    has = (F.instr(text, F.lit("\n")) > 0) & (F.length(rest) > 0)
    return title, F.when(has, rest).otherwise(title)


def file_type(path: Column) -> Column:
    return F.when(F.instr(path, F.lit(".")) > 0, F.substring_index(path, ".", -1)).otherwise(F.lit("md"))


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW_CHARS)


def percent(score: Column) -> Column:
    return F.floor(score * 100 + 0.5).cast("bigint")


def score_tier(score: Column, high: float = 0.85) -> Column:
    return F.when(score >= high, "high").when(score >= high - 0.15, "medium").otherwise("low")


def clamp_limit(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number.isNull(), F.lit(10)).otherwise(F.least(F.lit(50), F.greatest(F.lit(1), F.floor(number + 0.5)))).cast("bigint")


def model_fingerprint(adapter: Column, model: Column, host: Column) -> Column:
    return F.concat_ws("|", *(F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (adapter, model, host)))


def normalize_folder(c: Column) -> Column:
    return F.regexp_replace(trim_all(F.replace(c, F.lit("\\"), F.lit("/"))), "^/+|/+$", "")


def listed(text: Column, clean=trim_all) -> Column:
    """A comma list as an array of its non-empty entries."""
    return F.filter(F.transform(F.split(text, ","), clean), lambda x: x != "")


def is_excluded(path: Column, folders: Column, files: Column) -> Column:
    """Whether a path is left out: by a folder name anywhere, a folder path in front, or a part of the file name."""
    whole = normalize_folder(path)
    segments = F.filter(F.split(whole, "/"), lambda x: x != "")
    name = F.element_at(segments, -1)
    by_folder = F.exists(listed(folders, normalize_folder), lambda f: F.when(F.contains(f, F.lit("/")), (whole == f) | F.startswith(whole, F.concat(f, F.lit("/")))).otherwise(F.array_contains(segments, f)))
    by_file = F.exists(listed(files), lambda p: F.contains(name, p))
    always = F.arrays_overlap(segments, F.array(*map(F.lit, ALWAYS_EXCLUDED)))
    return F.coalesce(always | by_folder | by_file, F.lit(False))


def in_folder(path: Column, folder: Column) -> Column:
    f = normalize_folder(folder)
    return (f != "") & ((path == f) | F.startswith(path, F.concat(f, F.lit("/"))))


def add_excluded(text: Column, folder: Column) -> Column:
    return F.array_join(F.array_distinct(F.concat(listed(text, normalize_folder), F.array(normalize_folder(folder)))), ", ")


def remove_excluded(text: Column, folder: Column) -> Column:
    return F.array_join(F.array_remove(F.array_distinct(listed(text, normalize_folder)), normalize_folder(folder)), ", ")


def display_title(key: Column) -> Column:
    """Last part of the path with ' > ' for '#', without '.md'."""
    return F.replace(F.replace(F.substring_index(key, "/", -1), F.lit(".md"), F.lit("")), F.lit("#"), F.lit(" > "))


def folder_trail(key: Column) -> Column:
    parts = F.split(source_key(key), "/")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " > ")


def last_heading(key: Column) -> Column:
    """The last heading of a block key, null for a paragraph or a note."""
    last = F.substring_index(key, "#", -1)
    return F.when(F.contains(key, F.lit("#")) & ~F.startswith(last, F.lit("paragraph-")), last)


def is_embedding_model(name: Column) -> Column:
    segments = F.split(F.lower(name), "[-:/_]")
    return F.arrays_overlap(segments, F.array(F.lit("embed"), F.lit("embedding"), F.lit("embeddings"), F.lit("bge"))) | F.contains(F.lower(name), F.lit("text-embedding"))


def has_embedding_keyword(name: Column) -> Column:
    """The looser rule for lists of local models: the name contains a keyword anywhere."""
    found = F.lit(False)
    for word in ("embed", "embedding", "bge"):
        found = found | F.contains(F.lower(name), F.lit(word))
    return found


def error_cause(message: Column) -> Column:
    """The cause that a ``[download:<cause>]`` marker names; else download where the words speak of one; else unknown."""
    out = F.when(message.rlike("(?i)failed to fetch|network|cdn|timed out"), "download").otherwise("unknown")
    for cause in ("model_not_found", "network", "quota", "timeout"):  # the last one asked is looked for first
        out = F.when(message.rlike(rf"(?i)\[download:{cause}\]"), cause).otherwise(out)
    return out
