"""Distribution summaries per group: box statistics (A6, A20) and a Gaussian KDE."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelab.functions.scale import nan_to_null
from scorelab.session import broadcast_if_small, materialize
from scorelab.operators.positions import (DEFAULT_BUCKETS, _keys, cumulative_counts, quantiles, quantiles_from,
                                          value_counts)


def box_stats(df: DataFrame, keys="model", value: str = "overall_score", whis: float = 1.5,
              buckets: int = DEFAULT_BUCKETS, method: str = "exact") -> DataFrame:
    """N, mean, sample sd, q1/median/q3 (linear), whiskers = most extreme values
    inside q1 - whis*IQR / q3 + whis*IQR, and the number of values beyond them.

    Works on the distinct (group, value, count) table, so repeated values cost one row.
    ``method="approx"`` takes the quartiles from a sketch in one pass.
    The fences always enclose the data points next to q1 and q3, so the whiskers never
    fall inside the box and "beyond a whisker" equals "beyond its fence": whiskers,
    moments and the outlier count come from one aggregate after the quantiles.
    """
    ks = _keys(keys)
    if method == "approx":  # sketch quartiles (see positions.quantiles); whiskers stay exact values
        counts = value_counts(df, ks, value)
        q = quantiles(df, ks, value, (0.25, 0.5, 0.75), ["q1", "median", "q3"], method="approx")
    else:
        counts = materialize(value_counts(df, ks, value))  # quantile and whisker passes both read it
        c = cumulative_counts(counts, ks, value, buckets, checkpoint=False)
        q = quantiles_from(c, ks, value, (0.25, 0.5, 0.75), ["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumn("_lo", F.col("q1") - F.lit(whis) * iqr).withColumn("_hi", F.col("q3") + F.lit(whis) * iqr)
    j = counts.join(broadcast_if_small(q), ks, "inner")
    v, w = F.col(value), F.col("_cnt")
    d = v - F.col("median")  # moments around the median (shifted for stability)
    g = j.groupBy(*ks).agg(
        F.first("n").alias("n"),
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        (F.sum(v * w) / F.sum(w)).alias("mean"),
        F.min(F.when(v >= F.col("_lo"), v)).alias("_wlo"),
        F.max(F.when(v <= F.col("_hi"), v)).alias("_whi"),
        F.sum(F.when((v < F.col("_lo")) | (v > F.col("_hi")), w).otherwise(F.lit(0))).cast("bigint").alias("n_outliers"),
        F.sum(w * d).alias("_s1"),
        F.sum(w * d * d).alias("_s2"),
    )
    whislo = F.when(F.col("_wlo").isNull() | (F.col("_wlo") > F.col("q1")), F.col("q1")).otherwise(F.col("_wlo"))
    whishi = F.when(F.col("_whi").isNull() | (F.col("_whi") < F.col("q3")), F.col("q3")).otherwise(F.col("_whi"))
    nd = F.col("n").cast("double")
    var = F.try_divide(F.col("_s2") - F.col("_s1") * F.col("_s1") / nd, nd - F.lit(1.0))
    return g.select(*ks, "n", "mean", F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"), "q1", "median", "q3",
                    whislo.alias("whislo"), whishi.alias("whishi"), "n_outliers")


def box_outliers(df: DataFrame, keys="model", value: str = "overall_score", whis: float = 1.5,
                 carry=()) -> DataFrame:
    """The rows beyond the whiskers (keys, carried columns, value)."""
    ks = _keys(keys)
    q = quantiles(df, ks, value, (0.25, 0.75), ["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    fences = q.select(*ks, (F.col("q1") - F.lit(whis) * iqr).alias("_lo"), (F.col("q3") + F.lit(whis) * iqr).alias("_hi"))
    rows = df.select(*ks, *carry, nan_to_null(F.col(value)).cast("double").alias(value))
    j = rows.join(broadcast_if_small(fences), ks, "inner")   # with few groups the rows stay where they are
    return j.where((F.col(value) < F.col("_lo")) | (F.col(value) > F.col("_hi"))).drop("_lo", "_hi")


def violin_kde(df: DataFrame, keys="model", value: str = "overall_score", points: int = 100,
               bin_width: float | None = None, centers: bool = False) -> DataFrame:
    """Gaussian KDE at ``points`` evenly spaced points from min to max per group.

    Bandwidth by Scott's rule on the sample sd: h = sd * n^(-1/5). Distinct values
    are weighted by their count; the explode to ``points`` rows happens map-side and
    is reduced by the partial aggregate before any shuffle. A group with one value has
    one point, with NULL density. ``bin_width``: values are first rounded to multiples of
    it, which bounds the distinct values of a group (exact by default). ``centers`` adds
    the group's ``mean`` and exact ``median`` (of the values as given).
    """
    ks = _keys(keys)
    exact = value_counts(df, ks, value)
    if centers:
        exact = materialize(exact)
    vc = exact
    if bin_width is not None:
        vc = value_counts(exact.withColumn(value, F.round(F.col(value) / F.lit(float(bin_width))) * F.lit(float(bin_width))), ks, value, weight="_cnt")
    vc = materialize(vc) if bin_width is not None or not centers else vc
    v, c = F.col(value), F.col("_cnt")
    st = vc.groupBy(*ks).agg(F.sum(c).alias("n"), F.min(v).alias("vmin"), F.max(v).alias("vmax"))
    # moments around the smallest value, so that large values with a small spread keep their digits
    d = v - F.col("vmin")
    st = broadcast_if_small(st)
    moments = vc.join(st, ks, "inner").groupBy(*ks).agg(
        F.first("n").alias("n"), F.first("vmin").alias("vmin"), F.first("vmax").alias("vmax"), F.sum(c * d).alias("_s1"), F.sum(c * d * d).alias("_s2"))
    nd = F.col("n").cast("double")
    var = F.try_divide(F.col("_s2") - F.col("_s1") * F.col("_s1") / nd, nd - F.lit(1.0))
    st = broadcast_if_small(moments.withColumn("h", F.sqrt(F.greatest(var, F.lit(0.0))) * F.pow(nd, F.lit(-0.2))).drop("_s1", "_s2"))
    j = vc.join(st, ks, "inner").withColumn(
        "point", F.explode(F.when(F.col("vmin") == F.col("vmax"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(points - 1)))))
    step = (F.col("vmax") - F.col("vmin")) / F.lit(float(points - 1))
    x = F.when(F.col("point") == F.lit(points - 1), F.col("vmax")).otherwise(F.col("vmin") + F.col("point") * step)
    j = j.withColumn("x", x)
    z = F.try_divide(F.col("x") - v, F.col("h"))
    k = F.when(F.col("h") > 0, c * F.exp(F.lit(-0.5) * z * z))
    g = j.groupBy(*ks, "point", "x").agg(F.sum(k).alias("_k"), F.first("n").alias("n"), F.first("h").alias("h"))
    dens = F.try_divide(F.col("_k"), F.col("n") * F.col("h") * F.lit(math.sqrt(2.0 * math.pi)))
    out = g.select(*ks, "point", "x", dens.alias("density"))
    if centers:
        median = quantiles_from(cumulative_counts(exact, ks, value, checkpoint=False), ks, value, (0.5,), ["median"]).drop("n")
        mean = exact.groupBy(*ks).agg((F.sum(c * v) / F.sum(c)).alias("mean"))
        out = out.join(broadcast_if_small(mean.join(median, ks)), ks)
    return out


def difficulty_bands(df: DataFrame, task: str = "task_id", gate_col: str = "functional_correctness",
                     cuts=(1.0 / 3.0, 2.0 / 3.0)) -> DataFrame:
    """Per-task pass rate and difficulty band: hard < cuts[0] <= medium < cuts[1] <= easy."""
    rate = df.groupBy(task).agg(F.avg(gate_col).alias("pass_rate"))
    band = (
        F.when(F.col("pass_rate") < F.lit(cuts[0]), F.lit("hard"))
        .when(F.col("pass_rate") < F.lit(cuts[1]), F.lit("medium"))
        .otherwise(F.lit("easy"))
    )
    return rate.withColumn("difficulty", band)


def difficulty_dist(df: DataFrame, task: str = "task_id", value: str = "overall_score",
                    gate_col: str = "functional_correctness") -> DataFrame:
    """Box statistics of the score by task-difficulty band (band from the task's pass rate).

    The per-task table is joined back on the task key (hash join with AQE: broadcast
    when small, skew-split when one task is hot)."""
    bands = difficulty_bands(df, task, gate_col).select(task, "difficulty")
    return box_stats(df.select(task, value).join(bands, task, "inner"), "difficulty", value)
