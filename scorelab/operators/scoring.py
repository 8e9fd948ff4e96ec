"""Scoring of raw measurements (P1-P8): one row-local plan for batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scorelab.functions.poe import overall_score
from scorelab.functions.scale import gate, scale_cc, scale_efficiency, scale_lint, scale_loc


def score_measurements(raw: DataFrame, zero_policy: str = "drop", keep: tuple[str, ...] = ()) -> DataFrame:
    """Scale the raw tool outputs and add the gated product-of-experts score (P1-P8); ``keep``: columns to carry along."""
    scored = raw.select(
        "model",
        "task_id",
        "passed",
        *keep,
        scale_cc("raw_cc_avg").alias("avg_cyclomatic_complexity"),
        scale_cc("raw_cc_max").alias("max_cyclomatic_complexity"),
        scale_lint("raw_style").alias("style_score"),
        scale_efficiency("raw_seconds").alias("efficiency_score"),
        scale_loc("loc").alias("loc_score"),
        gate("passed").alias("functional_correctness"),
    )
    return scored.withColumn(
        "overall_score",
        overall_score(
            "functional_correctness",
            "avg_cyclomatic_complexity",
            "style_score",
            "efficiency_score",
            "loc_score",
            zero_policy=zero_policy,
        ),
    )
