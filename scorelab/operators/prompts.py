"""Prompt table for a generation run (P12-P14): problems x models x samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelab.functions.scale import safe_name

# The instruction wrapped around every problem (rendered, no placeholders).
PROMPT_PREFIX = """
Return ONLY a single JSON object with this exact schema:
{ "code": "<Python function code here>" }

Rules:
- Do NOT include markdown, backticks, or prose before/after the JSON.
- The JSON must be the first character of the response and be strictly valid.
- Put the entire solution in the "code" value.
- No tests, no prints, no explanations.

Example:
{ "code": "def add(a, b):\n    return a + b" }

Task:
"""
PROMPT_SUFFIX = "\n"

# Models of a default run.
DEFAULT_MODELS = ["qwen2.5-coder:7b", "codegemma:7b", "deepseek-coder:6.7b", "codellama:7b"]


def render_prompt(prompt, prefix: str = PROMPT_PREFIX, suffix: str = PROMPT_SUFFIX):
    """Template with one hole; plain concat (templates may hold % or braces)."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.concat(F.lit(prefix), p, F.lit(suffix))


def prompt_table(problems: DataFrame, models=None, samples_per_task: int = 1, task: str = "task_id",
                 prompt: str = "prompt") -> DataFrame:
    """P13 + P14 + K4: one row per (model, task, sample) with the rendered prompt.

    The model list is run configuration, expanded with explode (no join); the
    problems table is read once, map-only."""
    if samples_per_task < 1:
        raise ValueError("samples_per_task must be >= 1")
    models = DEFAULT_MODELS if models is None else list(models)
    out = problems.select(
        F.explode(F.array(*[F.lit(m) for m in models])).alias("model"),
        F.col(task).alias("task_id"),
        F.explode(F.sequence(F.lit(1), F.lit(int(samples_per_task)))).alias("sample_id"),
        render_prompt(prompt).alias("prompt"),
    )
    return out.withColumn("safe_model", safe_name("model"))
