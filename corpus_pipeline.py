"""A training corpus from the documents: each stage works on all that its predecessor kept.

``STAGES`` lists (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet into the folder that the cluster shares and reread as the next stage's docs. All but the last return the columns of
``documents``:

1. toxicity: documents with a score of 0.7 or more go;
2. line_dedup: lines that repeat an earlier line, but for one word at most, are taken out of their texts;
3. near_dedup: one document of each class of near duplicates stays;
4. decontamination: documents that hold a window of the benchmark go;
5. byte_level_bpe: what is left is encoded, decoded, and digested.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm._spark import table, written
from quillmark.llm.bpe import bpe_digest
from quillmark.llm.decontamination import drop_contaminated
from quillmark.llm.line_dedup import dedup_lines
from quillmark.llm.near_dedup import drop_near_duplicates
from quillmark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs, size_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digest(docs, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("byte_level_bpe", byte_level_bpe)]

#: SQL can't express the neighbours, the alignment and the merges; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
