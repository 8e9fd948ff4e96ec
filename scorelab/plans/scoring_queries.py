"""Registered queries for scoring and per-model aggregates (relation L and E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelab.functions.poe import weighted_poe
from scorelab.functions.scale import coerce_numeric, grade_band
from scorelab.operators import agg
from scorelab.plans import relations as R
from scorelab.plans.catalog import register, rounded
from scorelab.schemas import METRICS

L = R.ORACLE_L
_MEAN_COLS = ["overall_score"] + METRICS


def _means_sql(src: str, by: str = "model") -> str:
    cols = ", ".join(f"round(avg({c}), 6) AS {c}" for c in _MEAN_COLS)
    return f"SELECT {by}, count(*) AS n, {cols} FROM ({src}) WHERE overall_score IS NOT NULL GROUP BY {by}"


@register("poe_by_model", _means_sql(L))
def poe_by_model(spark, sf_dir):
    """Flagship: mean gated PoE score and mean of every metric per model, best first."""
    return rounded(agg.best_first(agg.model_means(R.measurements(spark, sf_dir))))


@register("poe_rows", f"SELECT model, task_id, round(overall_score, 6) AS overall_score FROM ({L})")
def poe_rows(spark, sf_dir):
    return rounded(R.measurements(spark, sf_dir).select("model", "task_id", "overall_score"))


_L_ZERO = f"""SELECT *, functional_correctness * {R.ORACLE_QUALITY_ZERO} AS overall_score
FROM ({R.ORACLE_L_SCALED})"""


@register(
    "poe_zero_policy",
    f"""SELECT model, count(*) AS n, round(avg(overall_score), 6) AS overall_score,
              count_if(overall_score > 0) AS n_positive
       FROM ({_L_ZERO}) GROUP BY model""",
)
def poe_zero_policy(spark, sf_dir):
    """Q2 switched off: a zero expert zeroes the product instead of being dropped."""
    df = R.measurements(spark, sf_dir, zero_policy="zero")
    return rounded(
        df.groupBy("model").agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("overall_score").alias("overall_score"),
            F.count_if(F.col("overall_score") > 0).alias("n_positive"),
        )
    )


# Weights of the weighted PoE query: CC, style, efficiency, LOC.
_W = [2.0, 1.0, 0.5, 1.5]
_EXP = ["avg_cyclomatic_complexity", "style_score", "efficiency_score", "loc_score"]


def _weighted_sql() -> str:
    num = " * ".join(
        f"(CASE WHEN coalesce({c}, 0.0) > 0 THEN power({c}, {w}) ELSE 1.0 END)" for c, w in zip(_EXP, _W)
    )
    den = " + ".join(f"(CASE WHEN coalesce({c}, 0.0) > 0 THEN {w} ELSE 0.0 END)" for c, w in zip(_EXP, _W))
    return f"""SELECT model, task_id,
       round(functional_correctness * coalesce(power(1.0 * {num}, 1.0 / nullif({den}, 0.0)), 0.0), 6) AS weighted_score
FROM ({R.ORACLE_L_SCALED})"""


@register("poe_weighted", _weighted_sql())
def poe_weighted(spark, sf_dir):
    """Weighted geometric mean of the kept experts, gated."""
    df = R.measurements(spark, sf_dir)
    score = F.col("functional_correctness") * weighted_poe(_EXP, _W)
    return rounded(df.select("model", "task_id", score.alias("weighted_score")))


_GRADE_SQL = """CASE WHEN overall_score >= 0.9 THEN 'excellent' WHEN overall_score >= 0.75 THEN 'good'
     WHEN overall_score >= 0.6 THEN 'regular' WHEN overall_score >= 0.4 THEN 'poor'
     WHEN overall_score IS NOT NULL THEN 'critical' END"""


@register("grade_bands", f"SELECT model, {_GRADE_SQL} AS grade, count(*) AS n FROM ({L}) GROUP BY ALL")
def grade_bands(spark, sf_dir):
    """P10: rows per model and grade band."""
    return agg.grade_counts(R.measurements(spark, sf_dir))


@register(
    "scale_metrics",
    f"""SELECT model, task_id,
       round(avg_cyclomatic_complexity, 6) AS avg_cyclomatic_complexity,
       round(max_cyclomatic_complexity, 6) AS max_cyclomatic_complexity,
       round(style_score, 6) AS style_score, round(efficiency_score, 6) AS efficiency_score,
       round(loc_score, 6) AS loc_score, round(functional_correctness, 6) AS functional_correctness
FROM ({R.ORACLE_L_SCALED})""",
)
def scale_metrics(spark, sf_dir):
    """Every scaled metric per row, NULL style rows kept."""
    df = R.measurements(spark, sf_dir).drop("passed", "overall_score")
    return rounded(df)


@register(
    "coerce_numeric",
    """SELECT event_id,
       round(CASE WHEN isnan(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE)) THEN NULL
                  ELSE TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) END, 6) AS value_num,
       TRY_CAST(props AS DOUBLE) AS props_num,
       round(TRY_CAST(replace(replace(props, '{"k": ', ''), '}', '') AS DOUBLE), 6) AS k_num
FROM events""",
)
def coerce_numeric_q(spark, sf_dir):
    """Text -> double with bad values as NULL, on numeric, JSON and cleaned text."""
    ev = R.table(spark, sf_dir, "events")
    k_text = F.replace(F.replace("props", F.lit('{"k": '), F.lit("")), F.lit("}"), F.lit(""))
    return rounded(
        ev.select(
            "event_id",
            coerce_numeric(F.col("value").cast("string")).alias("value_num"),
            coerce_numeric("props").alias("props_num"),
            coerce_numeric(k_text).alias("k_num"),
        )
    )


@register(
    "run_mean",
    f"SELECT model, count(*) AS n, round(coalesce(avg(overall_score), 0.0), 6) AS poe_mean FROM ({L}) GROUP BY model",
)
def run_mean(spark, sf_dir):
    """A4: mean PoE per run (model)."""
    return rounded(agg.run_mean(R.measurements(spark, sf_dir)))


_PASS_AT_K_SQL = f"""
WITH counts AS (
  SELECT model, task_id, CAST(count(*) AS BIGINT) AS n, CAST(count_if(coalesce(passed, false)) AS BIGINT) AS c
  FROM ({R.ORACLE_E}) GROUP BY model, task_id
), kk AS (
  SELECT counts.*, k FROM counts CROSS JOIN (VALUES (1), (10), (100)) t(k)
), per_task AS (
  SELECT model, task_id, n, k,
         CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0
              ELSE 1.0 - list_reduce(list_transform(range(n - c + 1, n + 1),
                                     lambda i: 1.0 - CAST(k AS DOUBLE) / CAST(i AS DOUBLE)),
                                     lambda a, b: a * b) END AS p
  FROM kk
)
SELECT model, k, count(*) AS n_tasks, min(n) AS min_n,
       round(CASE WHEN min(n) >= k THEN avg(p) END, 6) AS pass_at_k
FROM per_task GROUP BY model, k
"""


@register("pass_at_k", _PASS_AT_K_SQL)
def pass_at_k(spark, sf_dir):
    """A5: unbiased pass@k for k = 1, 10, 100 over events as attempts (success = value > 50)."""
    return rounded(agg.pass_at_k(R.runs(spark, sf_dir), ks=(1, 10, 100)))


_JITTER = ["style_score", "loc_score", "avg_cyclomatic_complexity"]


@register(
    "jitter_flags",
    "\nUNION ALL\n".join(
        f"""SELECT model, '{m}' AS metric, count(DISTINCT round({m}, 5)) AS n_distinct,
       count(DISTINCT round({m}, 5)) < 20 AS needs_jitter
FROM ({L}) WHERE {m} IS NOT NULL GROUP BY model"""
        for m in _JITTER
    ),
)
def jitter_flags(spark, sf_dir):
    """Distinct values at 5 places per (model, metric) and the jitter decision."""
    return agg.distinct_rounded(R.measurements(spark, sf_dir), _JITTER)


@register("distinct_models", f"SELECT DISTINCT model FROM ({L})")
def distinct_models(spark, sf_dir):
    """Sorted distinct models."""
    return agg.distinct_models(R.measurements(spark, sf_dir))


@register(
    "histogram",
    f"""SELECT least(CAST(floor((overall_score - 0.0) / (1.0 - 0.0) * 10) AS BIGINT) + 1, 10) AS bucket,
       count(*) AS n FROM ({L}) WHERE overall_score IS NOT NULL GROUP BY ALL""",
)
def histogram(spark, sf_dir):
    """10-bin histogram of the overall score on [0, 1]."""
    return agg.histogram(R.measurements(spark, sf_dir), "overall_score", bins=10)


@register(
    "discount_histogram",
    """SELECT CAST(l_linenumber AS VARCHAR) AS model,
       least(CAST(floor((l_discount * 10 - 0.0) / (1.0 - 0.0) * 10) AS BIGINT) + 1, 10) AS bucket,
       count(*) AS n FROM lineitem GROUP BY ALL""",
)
def discount_histogram(spark, sf_dir):
    """A17 per model on raw seconds (l_discount*10), which reaches the upper edge."""
    return agg.histogram(R.raw_measurements(spark, sf_dir), "raw_seconds", bins=10, by="model")


@register(
    "metric_means",
    "\nUNION ALL\n".join(
        f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean FROM ({L})" for m in METRICS + ["overall_score"]
    ),
)
def metric_means(spark, sf_dir):
    """Mean of each metric over all rows."""
    return rounded(agg.metric_means(R.measurements(spark, sf_dir)))


@register(
    "task_matrix",
    f"""SELECT task_id, model, round(avg(overall_score), 6) AS overall_score,
       round(max(functional_correctness), 6) AS passed_any FROM ({L}) GROUP BY task_id, model""",
)
def task_matrix(spark, sf_dir):
    """Task x model score with correctness overlay (long form)."""
    return rounded(agg.task_matrix(R.measurements(spark, sf_dir)))


@register(
    "record_counts",
    f"SELECT count(*) AS n_rows, count(DISTINCT model) AS n_models, count(DISTINCT task_id) AS n_tasks FROM ({L})",
)
def record_counts(spark, sf_dir):
    """Record counts."""
    return agg.record_counts(R.measurements(spark, sf_dir))


@register(
    "passing_per_task",
    f"""SELECT n_passing, count(*) AS n_tasks FROM (
  SELECT task_id, CAST(sum(functional_correctness) AS BIGINT) AS n_passing FROM ({L}) GROUP BY task_id
) GROUP BY n_passing""",
)
def passing_per_task(spark, sf_dir):
    """Tasks by number of models passing them."""
    return agg.passing_models_per_task(R.measurements(spark, sf_dir))


@register(
    "grade_rows",
    f"SELECT model, task_id, {_GRADE_SQL} AS grade FROM ({L})",
)
def grade_rows(spark, sf_dir):
    """P10 per row."""
    df = R.measurements(spark, sf_dir)
    return df.select("model", "task_id", grade_band(F.col("overall_score")).alias("grade"))
