"""Registered queries of the stored sketches: merged over years, held against exact results."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelab.operators import dist, sketches
from scorelab.plans import relations as R
from scorelab.plans.catalog import register
from scorelab.plans.scoring_queries import _JITTER
from scorelab.session import scratch_path

_QS = {"q1": 0.25, "median": 0.5, "q3": 0.75}


@register("jitter_flags_sketch", "\nUNION ALL\n".join(
    f"""SELECT model, '{m}' AS metric, count(DISTINCT round({m}, 5)) < 20 AS exact_flag, count(DISTINCT round({m}, 5)) < 20 AS sketch_flag,
       true AS within_bound FROM ({R.ORACLE_L}) WHERE {m} IS NOT NULL GROUP BY model""" for m in _JITTER))
def jitter_flags_sketch(spark, sf_dir):
    """Jitter flags from HyperLogLog sketches of each year, stored in two runs (the second stores a
    year again) and merged, beside the exact flags; ``within_bound``: the estimate keeps its error bound."""
    from scorelab.operators.agg import distinct_rounded

    rows, path = R.dated_measurements(spark, sf_dir), scratch_path(spark, "distinct-sketches")
    sketches.store(sketches.distinct_sketches(rows.where("year <= 1999"), _JITTER, part="year"), path, "year")
    sketches.store(sketches.distinct_sketches(rows.where("year >= 1999"), _JITTER, part="year"), path, "year")
    merged = sketches.merged_distinct(sketches.load(spark, path)).withColumnsRenamed({"n_distinct": "estimate", "needs_jitter": "sketch_flag"})
    exact = distinct_rounded(rows, _JITTER).withColumnRenamed("needs_jitter", "exact_flag")
    error = F.abs(F.col("estimate") - F.col("n_distinct")) <= F.ceil(F.col("n_distinct") * F.lit(sketches.distinct_error()))
    return exact.join(merged, ["model", "metric"]).select("model", "metric", "exact_flag", "sketch_flag", error.alias("within_bound"))


@register("quantile_sketch_check", """SELECT event_type AS model, q, count(value) AS n, true AS within
FROM events, (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS q) GROUP BY event_type, q""")
def quantile_sketch_check(spark, sf_dir):
    """Quartiles from KLL sketches of each day, stored, merged, and held against exact ranks: each has
    the rank it is asked for, give or take the stated error (twice, as the sketch is random)."""
    rows, path = R.table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), "value", F.to_date("ts").alias("day")), scratch_path(spark, "quantile-sketches")
    sketches.store(sketches.quantile_sketches(rows, "model", "value", part="day"), path, "day")
    q = sketches.quantiles(sketches.merged_quantiles(sketches.load(spark, path), "model"), "model", _QS.values(), list(_QS))
    return sketches.rank_check(rows, q, "model", "value", _QS, 2 * sketches.rank_error()).select("model", "q", "n", "within")


@register("difficulty_sketch_check", f"""
WITH l AS ({R.ORACLE_L}), bands AS (
  SELECT task_id, CASE WHEN avg(functional_correctness) < 1.0 / 3.0 THEN 'hard'
                       WHEN avg(functional_correctness) < 2.0 / 3.0 THEN 'medium' ELSE 'easy' END AS difficulty FROM l GROUP BY task_id)
SELECT difficulty, q, count(overall_score) AS n, true AS within
FROM l JOIN bands USING (task_id), (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS q) GROUP BY difficulty, q""")
def difficulty_sketch_check(spark, sf_dir):
    """A20 from KLL sketches of each year and difficulty band, stored, merged, and held against exact ranks."""
    rows, path = R.dated_measurements(spark, sf_dir), scratch_path(spark, "difficulty-sketches")
    banded = rows.select("task_id", "overall_score", "year").join(dist.difficulty_bands(rows).select("task_id", "difficulty"), "task_id")
    sketches.store(sketches.quantile_sketches(banded, "difficulty", "overall_score", part="year"), path, "year")
    q = sketches.quantiles(sketches.merged_quantiles(sketches.load(spark, path), "difficulty"), "difficulty", _QS.values(), list(_QS))
    return sketches.rank_check(banded, q, "difficulty", "overall_score", _QS, 2 * sketches.rank_error()).select("difficulty", "q", "n", "within")
