"""Exact percentiles of groups of any size, without bringing a group's values together."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from quillmark.operators.store import shared_path

BINS = 1024


def _written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the folder that the cluster shares, reread: later passes don't compute them again."""
    spark = df.sparkSession
    path = shared_path(spark, "ranks")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def percentiles(rows: DataFrame, by: tuple, value: str, shares: dict[str, float], *, bins: int = BINS) -> DataFrame:
    """(by..., one column for each of ``shares``): linear interpolation between the two values around ``share * (n - 1)``.

    A value of a rank is found by refined histograms: each pass counts the values between the bounds of a rank in ``bins`` bins of equal width, in the
    tasks first, and the bin that holds the rank gives the next bounds, which are values themselves; a rank is found when they are equal. So a
    pass shuffles ``bins`` rows for each rank at most, whatever the number of values. Nulls and NaN don't count; groups of null keys are
    groups; groups without values have nulls.
    """
    names = [f"_g{i}" for i in range(len(by))]
    values = rows.select(*(F.col(c).alias(n) for c, n in zip(by, names)), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n = values.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in shares.values()))))
    state = _written(n.select(*names, "n", "lo", "hi", F.explode(wanted).alias("rank"), F.lit(0).cast("bigint").alias("below")))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    while True:
        open_ = state.where("lo < hi")
        if not open_.head(1):
            break
        near = values.alias("x").join(open_.alias("s"), [*same("x", "s"), F.col("x.v").between(F.col("s.lo"), F.col("s.hi"))])
        at = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1)).alias("bin")
        counted = near.select(*(F.col(f"s.{c}") for c in names), "s.rank", "s.n", "s.below", "v", at).groupBy(*names, "rank", "n", "below", "bin").agg(F.count("*").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("k").over(Window.partitionBy(*names, "rank").orderBy("bin"))  # ``bins`` rows at most
        found = counted.withColumn("upto", F.col("below") + upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("k") <= F.col("rank")))
        state = _written(state.where("lo = hi").unionByName(found.select(*names, "n", "lo", "hi", "rank", (F.col("upto") - F.col("k")).alias("below"))))
    ranks = state.groupBy(*names, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("m"))  # two ranks for each share

    def between(p: float):
        low, high = F.element_at("m", F.floor(place(p))), F.element_at("m", F.ceil(place(p)))
        return low + (high - low) * (place(p) - F.floor(place(p)))

    out = ranks.select(*names, *(between(p).alias(c) for c, p in shares.items()))
    groups = rows.select(*(F.col(c).alias(n) for c, n in zip(by, names))).distinct()
    joined = groups.alias("a").join(out.alias("b"), same("a", "b"), "left")
    return joined.select(*(F.col(f"a.{n}").alias(c) for c, n in zip(by, names)), *(F.col(f"b.{c}") for c in shares))
