"""Mapped relations: the driver tables re-read as evaluation data.

The test data hold no model outputs, so each operator runs on a relation that
maps table columns onto the evaluation data model:

L  lineitem as a measurement table (one sample per model x task)
D  documents (left join labels) as completions with verdicts
E  events as recorded runs / attempts
C  conversations as response chunks
G  pages as raw responses to clean
X  documents wrapped in a chatty JSON answer
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.operators.scoring import score_measurements


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as its files lay it out; the number of tasks follows from the files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_measurements(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    """L before scaling: model, task_id, passed and raw tool outputs (and ``more`` columns of lineitem)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_linenumber").cast("string").alias("model"),
        F.col("l_orderkey").cast("string").alias("task_id"),
        (F.col("l_returnflag") != F.lit("R")).alias("passed"),
        (F.col("l_quantity") / F.lit(5)).alias("raw_cc_avg"),
        (F.col("l_quantity") / F.lit(4)).alias("raw_cc_max"),
        (F.nullif(F.col("l_tax"), F.lit(0.0)) * F.lit(100)).alias("raw_style"),
        (F.col("l_discount") * F.lit(10)).alias("raw_seconds"),
        F.col("l_quantity").alias("loc"),
        *more,
    )


def measurements(spark: SparkSession, sf_dir: str, zero_policy: str = "drop") -> DataFrame:
    """L: scored results, one row per (model, task)."""
    return score_measurements(raw_measurements(spark, sf_dir), zero_policy)


def dated_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L with the year of each measurement."""
    return score_measurements(raw_measurements(spark, sf_dir, F.year("l_shipdate").alias("year")), keep=("year",))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D: documents as completions; verdict from labels.quality (missing -> not passed)."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("model"),
        F.col("doc_id"),
        F.col("doc_id").cast("string").alias("task_id"),
        F.col("text").alias("completion"),
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("passed"))
    return docs.join(labels, "doc_id", "left")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: events as timed attempts; success when value > 50."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("model"),
        F.col("user_id").cast("string").alias("task_id"),
        F.col("event_id").alias("attempt"),
        (F.col("value") / F.lit(100)).alias("seconds"),
        (F.col("value") > F.lit(50)).alias("passed"),
        F.col("value"),
        F.col("props"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: conversation turns as response chunks; done on an assistant turn >= 3."""
    cv = table(spark, sf_dir, "conversations")
    return cv.select(
        F.col("conv_id").alias("request_id"),
        F.col("turn").alias("seq"),
        F.col("text").alias("response"),
        ((F.col("role") == F.lit("assistant")) & (F.col("turn") >= F.lit(3))).alias("done"),
    )


def wrapped_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X: each document wrapped as a chatty JSON answer ``Sure: {"code": ...} ok``."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.concat(
            F.lit("Sure: "),
            F.to_json(F.struct(F.col("text").alias("code"))),
            F.lit(" ok"),
        ).alias("raw"),
    )


# DuckDB views with the same mapping, used by the oracle SQL.
ORACLE_L_RAW = """
SELECT CAST(l_linenumber AS VARCHAR) AS model,
       CAST(l_orderkey AS VARCHAR) AS task_id,
       l_returnflag <> 'R' AS passed,
       l_quantity / 5 AS raw_cc_avg,
       l_quantity / 4 AS raw_cc_max,
       nullif(l_tax, 0) * 100 AS raw_style,
       l_discount * 10 AS raw_seconds,
       l_quantity AS loc
FROM lineitem
"""

ORACLE_L_SCALED = f"""
SELECT model, task_id, passed,
       CASE WHEN raw_cc_avg IS NULL THEN NULL ELSE 1.0 - least(raw_cc_avg / 10.0, 1.0) END AS avg_cyclomatic_complexity,
       CASE WHEN raw_cc_max IS NULL THEN NULL ELSE 1.0 - least(raw_cc_max / 10.0, 1.0) END AS max_cyclomatic_complexity,
       CASE WHEN raw_style IS NULL THEN NULL ELSE least(raw_style / 10.0, 1.0) END AS style_score,
       CASE WHEN raw_seconds IS NULL THEN NULL ELSE 1.0 - least(raw_seconds / 1.0, 1.0) END AS efficiency_score,
       greatest(0.0, 1.0 - least(loc / 50.0, 1.0)) AS loc_score,
       coalesce(CAST(passed AS DOUBLE), 0.0) AS functional_correctness
FROM ({ORACLE_L_RAW})
"""


def _oracle_kept(col: str) -> str:
    return f"(CASE WHEN coalesce({col}, 0.0) > 0 THEN {col} ELSE 1.0 END)"


def _oracle_n(cols) -> str:
    return "(" + " + ".join(f"(CASE WHEN coalesce({c}, 0.0) > 0 THEN 1 ELSE 0 END)" for c in cols) + ")"


_EXPERT_COLS = ["avg_cyclomatic_complexity", "style_score", "efficiency_score", "loc_score"]
ORACLE_QUALITY_DROP = (
    "coalesce(power(1.0 * "
    + " * ".join(_oracle_kept(c) for c in _EXPERT_COLS)
    + ", 1.0 / CAST(nullif("
    + _oracle_n(_EXPERT_COLS)
    + ", 0) AS DOUBLE)), 0.0)"
)
ORACLE_QUALITY_ZERO = (
    "power(1.0 * "
    + " * ".join(f"greatest(coalesce({c}, 0.0), 0.0)" for c in _EXPERT_COLS)
    + ", 1.0 / 4.0)"
)

ORACLE_L = f"""
SELECT *, functional_correctness * {ORACLE_QUALITY_DROP} AS overall_score
FROM ({ORACLE_L_SCALED})
"""

ORACLE_D = """
SELECT d.source AS model, d.doc_id, CAST(d.doc_id AS VARCHAR) AS task_id, d.text AS completion,
       l.quality = 1 AS passed
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

ORACLE_E = """
SELECT event_type AS model, CAST(user_id AS VARCHAR) AS task_id, event_id AS attempt,
       value / 100 AS seconds, value > 50 AS passed, value, props
FROM events
"""

ORACLE_C = """
SELECT conv_id AS request_id, turn AS seq, text AS response,
       (role = 'assistant' AND turn >= 3) AS done
FROM conversations
"""
