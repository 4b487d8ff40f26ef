"""Secret scan with built-in functions only: fixed patterns, and a character Markov model for the rest.

Fixed patterns give the base spans. Besides, two first-order Markov models over ASCII characters, one of random
strings (values that the patterns mark) and one of ordinary identifiers (long words outside them), are compared:
a long run of token characters whose log-likelihood ratio per transition and in total is high enough is a span of kind
``markov``. Both models are trained on a bounded sample of documents (``sample_docs``, the smallest hashes of
the ids); everything is scored.
"""

from __future__ import annotations

import json
import math

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

# The patterns of the base spans.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ of 20 or more characters: runs are maximal
HEX = r"[0-9a-f]{24,}"  # as [0-9a-f]+ of 24 or more characters
KINDS = ("assign", "access", "hex")

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z][A-Za-z0-9_]{7,}"
SAMPLE_DOCS = 20_000
MIN_TOTAL, MIN_MEAN = 12.0, 0.75
SPAN = "array<struct<s:int,o:int,e:int,kind:string,m:string>>"
_CHUNK = 256


def _located(text: Column, pattern: str, order: int, kind: str, matches: Column) -> Column:
    """Matches with code-point positions: what lies between them comes from splitting at the same pattern."""
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("l"), m.alias("m")))
    return F.when(F.size(matches) > 0, _positions(sizes, order, kind)).otherwise(F.array().cast(SPAN))


def _positions(sizes: Column, order: int, kind: str) -> Column:
    """Running sums in chunks, so that the work stays near linear in the number of matches of a text."""

    def chunk(c: Column) -> Column:
        base = F.aggregate(F.slice(sizes, F.lit(1), c * _CHUNK), F.lit(0), lambda a, x: a + x["g"] + x["l"])
        zero = F.struct(base.alias("at"), F.array().cast(SPAN).alias("out"))

        def step(a: Column, x: Column) -> Column:
            s, e = a["at"] + x["g"], a["at"] + x["g"] + x["l"]
            span = F.struct(s.alias("s"), F.lit(order).alias("o"), e.alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m"))
            return F.struct(e.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

        return F.aggregate(F.slice(sizes, c * _CHUNK + 1, F.lit(_CHUNK)), zero, step)["out"]

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _CHUNK).cast("int")), chunk))


def _base(df: DataFrame, text: str) -> DataFrame:
    """Adds ``base``: the kept spans of the fixed patterns by start, then kind."""
    t = F.col(text)
    found = df
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX)):
        found = found.withColumn(f"_m_{kind}", F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    for i, (kind, pattern) in enumerate(zip(KINDS, (ASSIGN, ACCESS, HEX))):
        found = found.withColumn(f"_s_{kind}", _located(t, pattern, i, kind, F.col(f"_m_{kind}")))
    assign = F.filter("_s_assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    return found.withColumn("base", F.array_sort(F.concat(assign, F.col("_s_access"), F.col("_s_hex")))).drop(*[f"_{p}_{k}" for p in "ms" for k in KINDS])


def _transitions(strings: DataFrame, column: str, label: int) -> DataFrame:
    """Counts of character pairs: at most 128 x 128 rows."""
    code = F.transform(F.split(column, ""), lambda c: F.ascii(c))
    pairs = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get("c", i) * 128 + F.get("c", i + 1))
    coded = strings.select(code.alias("c")).where(F.size("c") >= 2)
    return coded.select(F.explode(pairs).alias("pair")).where("pair between 0 and 16383").groupBy("pair").agg(F.count("*").alias("n")).withColumn("label", F.lit(label))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratios (random against ordinary) of the 128 x 128 transitions, at place first * 128 + second.

    Without examples of a kind its model is uniform, so the ratios stay finite.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    some = docs.select(key.alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(sample_docs)
    rows = docs.select(key.alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(F.broadcast(some), "k", "left_semi")
    spans = _base(rows, "t")
    value = F.when(F.col("x.kind") == "assign", F.regexp_extract("x.m", ASSIGN, 2)).otherwise(F.col("x.m"))
    secrets = spans.select(F.explode("base").alias("x")).select(value.alias("v"))
    clear = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = rows.select(F.explode(F.regexp_extract_all(clear, F.lit(WORD), F.lit(0))).alias("v"))
    counts = {0: {}, 1: {}}
    for r in _transitions(secrets, "v", 1).unionByName(_transitions(words, "v", 0)).collect():  # 2 x 16384 rows at most
        counts[r.label][r.pair] = r.n
    alphabet = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."]
    out = [0.0] * 16384
    for a in alphabet:
        total = [sum(counts[k].get(a * 128 + b, 0) for b in alphabet) for k in (0, 1)]
        for b in alphabet:
            p = [(counts[k].get(a * 128 + b, 0) + 0.5) / (total[k] + 0.5 * len(alphabet)) for k in (0, 1)]
            out[a * 128 + b] = round(math.log(p[1] / p[0]), 6)
    return out


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, min_total: float = MIN_TOTAL, min_mean: float = MIN_MEAN, ratios: list[float] | None = None) -> DataFrame:
    """(doc_id, base, found) per row: ``base`` are the spans of the patterns, ``found`` those and the model's.

    A span is (s, o, e, kind, m): code points [s, e), the kind and its order, and the text. Null texts read as empty and
    have no spans; repeated rows give repeated results; other columns are ignored. A model's span never overlaps a base span.
    """
    if ratios is None:
        ratios = train(docs, id_col=id_col, text_col=text_col, sample_docs=sample_docs)
    weight = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    rows = _base(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")), "t")
    rows = rows.withColumn("_mt", F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)))
    rows = rows.withColumn("_keep", F.when(F.size("_mt") > 0, F.filter("_mt", lambda m: _ratio(m, weight, min_total, min_mean))).otherwise(F.col("_mt")))
    rows = rows.withColumn("_st", F.when(F.size("_keep") > 0, _located(F.col("t"), TOKEN, len(KINDS), "markov", F.col("_mt"))).otherwise(F.array().cast(SPAN)))
    extra = F.filter("_st", lambda x: F.array_contains("_keep", x["m"]) & ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    found = F.when(F.size("_st") > 0, F.array_sort(F.concat("base", extra))).otherwise(F.col("base"))
    return rows.select("doc_id", "base", found.alias("found"))


def _ratio(token: Column, weight: Column, min_total: float, min_mean: float) -> Column:
    zero = F.struct(F.lit(-1).alias("p"), F.lit(0.0).alias("v"))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.struct(code.alias("p"), (a["v"] + F.when(a["p"] >= 0, F.get(weight, a["p"] * 128 + code)).otherwise(0.0)).alias("v"))

    total = F.aggregate(F.split(token, ""), zero, step, lambda a: a["v"])
    return F.rlike(token, F.lit("[0-9]")) & (total >= F.greatest(F.lit(min_total), F.length(token) * F.lit(min_mean)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
