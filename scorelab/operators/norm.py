"""Normalisation over model rows, deltas and trend lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelab.functions.scale import delta_sign, nan_to_null
from scorelab.schemas import METRICS, available

# The heatmap inverts every cyclomatic-complexity column and the LOC score.
INVERT_MARKER = "cyclomatic_complexity"
INVERT_EXTRA = ["loc_score"]


def minmax_norm(means: DataFrame, cols=None, by: str = "model", constant: float | None = None,
                invert=(), carry=()) -> DataFrame:
    """(x - min)/(max - min) per column over the model rows.

    constant=None: a constant column gives x - min (= 0), the delta view;
    constant=0.5: a constant column gives 0.5, the heatmap view.
    ``invert``: columns mapped as (max - x)/(max - min).

    ``means`` holds one row per model (the output of a ``groupBy(model)``), so the
    extremes come from a window over all of its rows: one chain, no join and no
    second computation of the means.
    """
    cols = cols or [c for c in means.columns if c != by and c != "n"]
    every = Window.partitionBy()
    j = means.select(by, *carry, *cols, *[F.min(c).over(every).alias(f"_mn_{c}") for c in cols],
                     *[F.max(c).over(every).alias(f"_mx_{c}") for c in cols])
    out = [F.col(by), *[F.col(c) for c in carry]]
    for c in cols:
        x, mn, mx = F.col(c), F.col(f"_mn_{c}"), F.col(f"_mx_{c}")
        num = (mx - x) if c in invert else (x - mn)
        if constant is None:
            e = F.coalesce(F.try_divide(num, mx - mn), x - mn)
        else:
            e = F.when(mx == mn, F.lit(float(constant))).otherwise(F.try_divide(num, mx - mn))
        out.append(e.cast("double").alias(c))
    return j.select(*out)


def heatmap_columns(columns, metrics=None):
    metrics = METRICS if metrics is None else metrics
    return ["overall_score"] + [m for m in available(columns, metrics) if m != "overall_score"]


def heatmap_norm(means: DataFrame, metrics=None, by: str = "model", invert=None) -> DataFrame:
    """A9 + A3 + O1: normalised per-model means for the heatmap, overall first,
    CC and LOC inverted (reference default), rows best first."""
    cols = heatmap_columns(means.columns, metrics)
    if invert is None:
        invert = [c for c in cols if INVERT_MARKER in c.lower() or c in INVERT_EXTRA]
    src = means.withColumn("_raw_overall", F.col("overall_score"))
    norm = minmax_norm(src, cols, by, constant=0.5, invert=invert, carry=["_raw_overall"])
    return norm.orderBy(F.col("_raw_overall").desc(), F.col(by)).drop("_raw_overall")


def delta_table(means: DataFrame, metrics=None, by: str = "model") -> DataFrame:
    """Normalised overall minus normalised metric per (model, metric), with sign class."""
    cols = heatmap_columns(means.columns, metrics)
    norm = minmax_norm(means, cols, by)
    others = [c for c in cols if c != "overall_score"]
    long = norm.unpivot([by, "overall_score"], others, "metric", "value")
    d = F.col("overall_score") - F.col("value")
    return long.select(by, "metric", d.alias("delta"), delta_sign(d).alias("sign"))


def delta_summary(means: DataFrame, metrics=None, by: str = "model") -> DataFrame:
    """A10: mean delta and "positive k of n" per metric."""
    d = delta_table(means, metrics, by)
    return d.groupBy("metric").agg(
        F.avg("delta").alias("mean_delta"),
        F.count_if(F.col("delta") > 0).alias("n_positive"),
        F.count(F.lit(1)).alias("n"),
    )


def trend_lines(df: DataFrame, metrics, by: str = "model", y: str = "overall_score", min_points: int = 3) -> DataFrame:
    """Least-squares line y ~ metric per (model, metric) over pairwise-complete rows;
    fewer than ``min_points`` pairs (or a constant x) -> NULL coefficients."""
    cols = [m for m in available(df.columns, metrics) if m != y]
    base = df.select(by, nan_to_null(F.col(y)).cast("double").alias("_y"),
                     *[nan_to_null(F.col(c)).cast("double").alias(c) for c in cols])
    long = base.unpivot([by, "_y"], cols, "metric", "_x")
    g = long.groupBy(by, "metric").agg(
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_count("_y", "_x").alias("n"),
    )
    ok = F.col("n") >= F.lit(min_points)
    return g.select(by, "metric", F.when(ok, F.col("slope")).alias("slope"),
                    F.when(ok, F.col("intercept")).alias("intercept"), "n")
