"""Mergeable sketches of (model, metric) groups, kept from day to day.

A sketch is a few kB whatever its group's size. One is stored for each group and part (a day,
a run); the answer over any parts comes from merging their sketches, without reading their
rows again. Storing a part again replaces it, so a repeated run counts nothing twice.
Sketches are partial aggregates: a hot group is reduced inside every map task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.functions.scale import nan_to_null
from scorelab.operators.agg import unpivot_metrics


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def store(sketches: DataFrame, path: str, part: str) -> None:
    """Write the sketches of the parts in ``sketches``; parts that the folder has already are replaced, others stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def distinct_error(lg_k: int = 12, deviations: float = 3.0) -> float:
    """Relative error of a distinct count, by default of three standard deviations of merged HyperLogLog sketches."""
    return deviations * 1.04 / math.sqrt(2.0 ** lg_k)


def distinct_sketches(df: DataFrame, metrics, by="model", part: str | None = None, places: int = 5, lg_k: int = 12) -> DataFrame:
    """A HyperLogLog sketch of the distinct values at ``places`` decimals of each (by, metric[, part]).
    NULL and NaN are no values; a group without values has an empty sketch."""
    ids = _keys(by) + ([part] if part else [])
    # + 0.0 makes a negative zero the same value as zero
    shown = (F.round("value", places) + F.lit(0.0)).cast("string")
    return unpivot_metrics(df, metrics, ids).groupBy(*_keys(by), "metric", *([part] if part else [])).agg(F.hll_sketch_agg(shown, lg_k).alias("sketch"))


def merged_distinct(sketches: DataFrame, by="model", threshold: int = 20) -> DataFrame:
    """Distinct values of each (by, metric) over all given sketches, and the jitter flag below ``threshold``."""
    g = sketches.groupBy(*_keys(by), "metric").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))
    return g.where("n_distinct > 0").withColumn("needs_jitter", F.col("n_distinct") < F.lit(threshold))


def rank_error(k: int = 400) -> float:
    """Rank error (a share of the rows) that a quantile of a KLL sketch keeps with 99% confidence: the sketch's published fit."""
    return 2.296 / k ** 0.9021


def quantile_sketches(df: DataFrame, keys, value: str, part: str | None = None, k: int = 400) -> DataFrame:
    """A KLL sketch of the values of each (keys[, part]), with their smallest and largest. NULL and NaN are no values."""
    ids = _keys(keys) + ([part] if part else [])
    rows = df.select(*ids, nan_to_null(F.col(value)).alias(value))
    return rows.groupBy(*ids).agg(F.kll_sketch_agg_double(value, k).alias("sketch"), F.count(value).alias("n"),
                                  F.min(value).alias("min"), F.max(value).alias("max"))


def merged_quantiles(sketches: DataFrame, keys) -> DataFrame:
    """One sketch for each group over all given sketches: keys, ``sketch``, ``n``, ``min``, ``max``."""
    filled = sketches.where("n > 0")
    return filled.groupBy(*_keys(keys)).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"),
                                            F.min("min").alias("min"), F.max("max").alias("max"))


def quantiles(merged: DataFrame, keys, qs=(0.25, 0.5, 0.75), names=None) -> DataFrame:
    """Quantiles (values of rows, not interpolated) whose ranks are within ``rank_error`` of ``qs``."""
    names = names or [f"q{int(round(q * 100)):02d}" for q in qs]
    return merged.select(*_keys(keys), "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(c) for q, c in zip(qs, names)])


GRID = 400


def box(merged: DataFrame, keys, whis: float = 1.5) -> DataFrame:
    """Box statistics from sketches alone. Quartiles are within ``rank_error``; whiskers and the number of outliers come
    from ``GRID`` + 1 even quantiles of the sketch, so their ranks are within ``rank_error`` + 1/``GRID``. A whisker
    that no fence cuts is the exact smallest or largest value."""
    ks = _keys(keys)
    levels = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    rows = merged.select(*ks, "n", "min", "max", F.kll_sketch_get_quantile_double("sketch", levels).alias("_q"))
    at = lambda q: F.element_at("_q", int(q * GRID) + 1)
    rows = rows.select("*", at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    reach = F.lit(whis) * (F.col("q3") - F.col("q1"))
    rows = rows.withColumns({"_lo": F.col("q1") - reach, "_hi": F.col("q3") + reach})
    inside = F.filter("_q", lambda v: (v >= F.col("_lo")) & (v <= F.col("_hi")))
    low = F.when(F.col("min") >= F.col("_lo"), F.col("min")).otherwise(F.array_min(inside))
    high = F.when(F.col("max") <= F.col("_hi"), F.col("max")).otherwise(F.array_max(inside))
    beyond = F.size(F.filter("_q", lambda v: (v < F.col("_lo")) | (v > F.col("_hi")))) / F.lit(GRID + 1)
    return rows.select(*ks, "n", "q1", "median", "q3", low.alias("whislo"), high.alias("whishi"),
                       F.round(beyond * F.col("n")).cast("bigint").alias("n_outliers"))


def rank_check(df: DataFrame, quantile_rows: DataFrame, keys, value: str, names: dict[str, float], error: float) -> DataFrame:
    """Exact ranks of estimated quantiles: keys, ``q``, ``n``, ``rank_low`` and ``rank_high`` (shares of rows below the value, and
    not above it) and ``within`` (q lies between them, give or take ``error``). Counts in one aggregate."""
    from scorelab.session import broadcast_if_small

    ks = _keys(keys)
    rows = df.select(*ks, nan_to_null(F.col(value)).alias("_v")).join(broadcast_if_small(quantile_rows.select(*ks, *names)), ks)
    sums = [f(F.col("_v"), F.col(c)).alias(f"{c}_{side}") for c in names for side, f in (("low", lambda v, x: F.count_if(v < x)), ("high", lambda v, x: F.count_if(v <= x)))]
    g = rows.groupBy(*ks).agg(F.count("_v").alias("n"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), (F.col(f"{c}_low") / F.col("n")).alias("rank_low"),
                                        (F.col(f"{c}_high") / F.col("n")).alias("rank_high")) for c, q in names.items()]))
    out = g.select(*ks, "n", each.alias("x")).select(*ks, "x.q", "n", "x.rank_low", "x.rank_high")
    return out.withColumn("within", (F.col("rank_low") - F.lit(error) <= F.col("q")) & (F.col("q") <= F.col("rank_high") + F.lit(error)))
