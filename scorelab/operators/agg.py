"""Aggregations over (model, task, sample) result tables.

All of these are hash aggregates with a partial (map-side) step, so a model
that holds a third of the rows is reduced inside every map task before the
shuffle; nothing collects a group's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelab.functions.scale import grade_band, nan_to_null
from scorelab.functions.stats import pass_at_k_expr
from scorelab.schemas import METRICS, available


def model_means(df: DataFrame, metrics=None, by: str = "model", overall: str = "overall_score",
                with_count: bool = True) -> DataFrame:
    """A1/A2/A3: one row per model, mean of the overall score and of each available metric.

    Rows whose overall score is missing after coercion are dropped first (F1);
    other NULLs are skipped by ``avg``; NaN is normalised to NULL.
    """
    metrics = METRICS if metrics is None else metrics
    cols = [overall] + [m for m in available(df.columns, metrics) if m != overall]
    # F1 as conditional aggregation rather than a filter: a filter would be pushed below
    # the projections and evaluate the score expression a second time per row. Groups
    # whose rows all lack a score disappear, as they would after the filter.
    base = df.select(by, *[nan_to_null(F.col(c)).cast("double").alias(c) for c in cols])
    keep = F.col(overall).isNotNull()
    aggs = [F.avg(F.when(keep, F.col(c))).alias(c) for c in cols]
    aggs = [F.count_if(keep).alias("n")] + aggs
    out = base.groupBy(by).agg(*aggs).where(F.col("n") > 0)
    return out if with_count else out.drop("n")


def best_first(df: DataFrame, score: str = "overall_score", by: str = "model") -> DataFrame:
    """O1: models by mean score, best first, name as tie-break."""
    return df.orderBy(F.col(score).desc(), F.col(by))


def run_mean(df: DataFrame, by: str = "model", score: str = "overall_score") -> DataFrame:
    """A4: mean score per run, 0 when the run is empty."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg(nan_to_null(F.col(score).cast("double"))), F.lit(0.0)).alias("poe_mean"),
    )


def pass_counts(df: DataFrame, by=("model", "task_id"), passed: str = "passed") -> DataFrame:
    """Per (model, task): number of samples n and number passed c."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.col(passed).cast("boolean"), F.lit(False))).alias("c"),
    )


def pass_at_k(df: DataFrame, ks=(1, 10, 100), model: str = "model", task: str = "task_id",
              passed: str = "passed") -> DataFrame:
    """A5: unbiased pass@k per model (Chen et al. 2021), averaged over tasks.

    A k is reported with a value only when every task of the model has n >= k;
    otherwise the value is NULL and ``min_n`` says why.
    """
    counts = pass_counts(df, (model, task), passed)
    kk = counts.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    per_task = kk.withColumn("p", pass_at_k_expr(F.col("n"), F.col("c"), F.col("k")))
    out = per_task.groupBy(model, "k").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.min("n").alias("min_n"),
        F.avg("p").alias("value"),
    )
    return out.withColumn(
        "pass_at_k", F.when(F.col("min_n") >= F.col("k"), F.col("value"))
    ).drop("value")


def distinct_rounded(df: DataFrame, metrics, by: str = "model", places: int = 5,
                     threshold: int = 20) -> DataFrame:
    """Number of distinct values at ``places`` decimals per (model, metric); jitter flag below threshold."""
    long = unpivot_metrics(df, metrics, by)
    return (
        long.where(F.col("value").isNotNull())
        .groupBy(by, "metric")
        .agg(F.count_distinct(F.round("value", places)).alias("n_distinct"))
        .withColumn("needs_jitter", F.col("n_distinct") < F.lit(threshold))
    )


def distinct_models(df: DataFrame, by: str = "model") -> DataFrame:
    """The sorted distinct models."""
    return df.select(by).distinct().orderBy(by)


def histogram(df: DataFrame, value: str, bins: int = 10, lo: float = 0.0, hi: float = 1.0,
              by: str | None = None) -> DataFrame:
    """Equal-width histogram on [lo, hi]; ``hi`` itself lands in the last bin. Values below ``lo``
    are counted in bucket 0 and values above ``hi`` in bucket bins + 1; NULL and NaN in none.

    Missing values are left out by the count and not by a filter, which would be pushed below
    the projections and evaluate a computed value a second time for each row."""
    src = df.select(*([by] if by else []), nan_to_null(F.col(value)).alias(value))
    keys = ([by] if by else []) + [_bucket(F.col(value), bins, lo, hi).alias("bucket")]
    return src.groupBy(*keys).agg(F.count(value).alias("n")).where(F.col("n") > 0)


def _bucket(v, bins: int, lo: float, hi: float):
    return F.when(v == F.lit(float(hi)), F.lit(bins)).otherwise(F.width_bucket(v, F.lit(lo), F.lit(hi), F.lit(bins))).cast("bigint")


def unpivot_metrics(df: DataFrame, metrics, by: str | list = "model") -> DataFrame:
    """Long form (by..., metric, value) of the available metrics; NaN -> NULL."""
    ids = [by] if isinstance(by, str) else list(by)
    cols = available(df.columns, metrics)
    base = df.select(*ids, *[nan_to_null(F.col(c)).cast("double").alias(c) for c in cols])
    return base.unpivot(ids, cols, "metric", "value")


def metric_means(df: DataFrame, metrics=None) -> DataFrame:
    """Mean of each metric over all rows."""
    metrics = METRICS + ["overall_score"] if metrics is None else metrics
    cols = available(df.columns, metrics)
    one = df.agg(*[F.avg(nan_to_null(F.col(c)).cast("double")).alias(c) for c in cols])
    return one.unpivot([], cols, "metric", "mean")


def task_matrix(df: DataFrame, task: str = "task_id", model: str = "model", models=None,
                score: str = "overall_score", gate_col: str = "functional_correctness") -> DataFrame:
    """Task x model score with correctness overlay.

    Long form by default; with an explicit ``models`` list the wide pivot is
    planned without a pass to discover the pivot values. A row of a model outside
    the list fails the query: it would have no column.
    """
    s, g = nan_to_null(F.col(score).cast("double")), nan_to_null(F.col(gate_col).cast("double"))
    if models is None:
        return df.groupBy(task, model).agg(F.avg(s).alias("overall_score"), F.max(g).alias("passed_any"))
    listed = F.when(F.col(model).isin(list(models)), F.col(model)).otherwise(
        F.raise_error(F.concat(F.lit("model without a column: "), F.coalesce(F.col(model).cast("string"), F.lit("null")))))
    return df.withColumn(model, listed).groupBy(task).pivot(model, list(models)).agg(F.avg(s).alias("score"), F.max(g).alias("passed"))


def grade_counts(df: DataFrame, score: str = "overall_score", by: str = "model") -> DataFrame:
    """P10 aggregated: rows per (model, grade band)."""
    return df.groupBy(by, grade_band(F.col(score)).alias("grade")).agg(F.count(F.lit(1)).alias("n"))


def record_counts(df: DataFrame, model: str = "model", task: str = "task_id") -> DataFrame:
    """Rows, models and tasks in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(model).alias("n_models"),
        F.count_distinct(task).alias("n_tasks"),
    )


def passing_models_per_task(df: DataFrame, task: str = "task_id",
                            gate_col: str = "functional_correctness") -> DataFrame:
    """Tasks by number of models passing them (difficulty histogram)."""
    per_task = df.groupBy(task).agg(F.sum(gate_col).cast("bigint").alias("n_passing"))
    return per_task.groupBy("n_passing").agg(F.count(F.lit(1)).alias("n_tasks"))
