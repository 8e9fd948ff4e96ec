"""Schemas and configuration constants (metric lists, scale constants)."""

from __future__ import annotations

from pyspark.sql import types as T

# Scale constants of the scoring model.
MAX_CC = 10.0
MAX_LINT_SCORE = 10.0
MAX_EXEC_TIME = 1.0
LOC_REF = 50.0

# Metric order used by the cross-model analytics.
METRICS = [
    "functional_correctness",
    "efficiency_score",
    "avg_cyclomatic_complexity",
    "max_cyclomatic_complexity",
    "style_score",
    "loc_score",
]

# Metric list of the per-model mean table (no max CC).
HEATMAP_METRICS = [
    "overall_score",
    "functional_correctness",
    "efficiency_score",
    "avg_cyclomatic_complexity",
    "style_score",
    "loc_score",
]

# The quality experts of the product-of-experts score, in order.
EXPERTS = ["avg_cyclomatic_complexity", "style_score", "efficiency_score", "loc_score"]

# Columns of the per-model summary file, in order.
SUMMARY_COLS = [
    "task_id",
    "passed",
    "avg_cyclomatic_complexity",
    "max_cyclomatic_complexity",
    "style_score",
    "efficiency_score",
    "loc_score",
    "functional_correctness",
    "overall_score",
]

# Display labels of the heatmap axes.
LABELS = {
    "overall_score": "Overall Score",
    "functional_correctness": "Func. Correctness",
    "efficiency_score": "Efficiency",
    "avg_cyclomatic_complexity": "Avg Cyclomatic",
    "max_cyclomatic_complexity": "Max Cyclomatic",
    "style_score": "Code Style",
    "loc_score": "LOC Score",
}

SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("passed", T.BooleanType()),
        T.StructField("avg_cyclomatic_complexity", T.DoubleType()),
        T.StructField("max_cyclomatic_complexity", T.DoubleType()),
        T.StructField("style_score", T.DoubleType()),
        T.StructField("efficiency_score", T.DoubleType()),
        T.StructField("loc_score", T.DoubleType()),
        T.StructField("functional_correctness", T.DoubleType()),
        T.StructField("overall_score", T.DoubleType()),
    ]
)

SAMPLE_SCHEMA = T.StructType(
    [T.StructField("task_id", T.StringType()), T.StructField("completion", T.StringType())]
)

RESULT_SCHEMA = T.StructType(
    SAMPLE_SCHEMA.fields
    + [f for f in SUMMARY_SCHEMA.fields if f.name not in ("task_id",)]
)

PROBLEM_SCHEMA = T.StructType(
    [T.StructField("task_id", T.StringType()), T.StructField("prompt", T.StringType())]
)

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("response", T.StringType()),
        T.StructField("done", T.BooleanType()),
    ]
)

VERDICT_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("sample_id", T.IntegerType()),
        T.StructField("passed", T.BooleanType()),
    ]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)


def available(columns, wanted):
    """Metric availability: the wanted names present in ``columns``, in wanted order."""
    cols = set(columns)
    return [m for m in wanted if m in cols]
