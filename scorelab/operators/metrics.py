"""Metric extraction re-aimed as table jobs (M1-M5, J1) and the end-to-end scorer.

The per-row tools of an evaluation run (AST complexity, linter, timing harness,
test runner) are replaced by: lexical complexity and a rule-based style score
computed with array expressions per row (no shuffle, no Python), and joins with
recorded verdict and run tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelab.functions.poe import overall_score
from scorelab.functions.scale import _col, gate, let, scale_cc, scale_efficiency, scale_lint, scale_loc
from scorelab.functions.text import NONBLANK, split_lines
from scorelab.session import broadcast_if_small

# Decision keywords counted by the lexical complexity (McCabe-style).
PY_DECISION_WORDS = ["if", "elif", "for", "while", "except", "with", "assert", "and", "or"]
# A line opening a block (function or class definition).
PY_BLOCK_MARKER = r"^[ \t]*(?:async[ \t]+)?(?:def|class)(?![A-Za-z0-9_])"


def word_pattern(words) -> str:
    """Whole-word alternation; lookarounds instead of \\b (Java's \\b is accent-aware, RE2's is not)."""
    return "(?<![A-Za-z0-9_])(?:" + "|".join(words) + ")(?![A-Za-z0-9_])"


def decision_points(code, words=None, block_marker: str = PY_BLOCK_MARKER) -> Column:
    """M1 + M5: struct(avg_cc, max_cc, n_blocks) of a code text.

    A block starts at a marker line and runs to the next one; its complexity is
    1 + decision words in its lines. No block -> 0/0. Lines before the first
    marker belong to no block. Computed by one fold over the lines of the row.
    """
    rx = word_pattern(words or PY_DECISION_WORDS)
    lines = F.transform(
        split_lines(code),
        lambda line: F.struct(F.regexp_like(line, F.lit(block_marker)).alias("m"),
                              F.regexp_count(line, F.lit(rx)).alias("c")),
    )
    init = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("nb"), F.lit(0).alias("tot"), F.lit(0).alias("mx"))

    def step(st, x):
        open_ = st["nb"] > 0
        closed = F.lit(1) + st["cur"]
        on_marker = F.struct(
            x["c"].alias("cur"),
            (st["nb"] + 1).alias("nb"),
            (st["tot"] + F.when(open_, closed).otherwise(0)).alias("tot"),
            F.when(open_, F.greatest(st["mx"], closed)).otherwise(st["mx"]).alias("mx"),
        )
        inside = F.struct(
            (st["cur"] + F.when(open_, x["c"]).otherwise(0)).alias("cur"),
            st["nb"].alias("nb"), st["tot"].alias("tot"), st["mx"].alias("mx"),
        )
        return F.when(x["m"], on_marker).otherwise(inside)

    def finish(st):
        has = st["nb"] > 0
        last = F.lit(1) + st["cur"]
        return F.struct(
            F.when(has, (st["tot"] + last).cast("double") / st["nb"].cast("double")).otherwise(F.lit(0.0)).alias("avg_cc"),
            F.when(has, F.greatest(st["mx"], last)).otherwise(F.lit(0)).cast("double").alias("max_cc"),
            st["nb"].alias("n_blocks"),
        )

    return F.when(_col(code).isNotNull(), F.aggregate(lines, init, step, finish))


# Default style rules (id, regex on one line, weight).
DEFAULT_RULES = [
    ("line-too-long", r".{100}", 1.0),
    ("multiple-spaces", r"[^ \t] {2,}[^ \t]", 0.5),
    ("trailing-whitespace", r"[ \t]$", 1.0),
    ("bad-indentation", r"^\t", 1.0),
]


def rule_counts(code, rules=None) -> Column:
    """struct(penalty, n_lines): sum over lines of the weights of the rules each line
    matches, and the number of logical (non-blank) lines; one pass over the lines."""
    rules = DEFAULT_RULES if rules is None else rules
    init = F.struct(F.lit(0.0).alias("penalty"), F.lit(0).alias("n_lines"))

    def step(acc, line):
        pen = acc["penalty"]
        for _, rx, w in rules:
            pen = pen + F.when(F.regexp_like(line, F.lit(rx)), F.lit(float(w))).otherwise(F.lit(0.0))
        nb = acc["n_lines"] + F.when(F.regexp_like(line, F.lit(NONBLANK)), F.lit(1)).otherwise(F.lit(0))
        return F.struct(pen.alias("penalty"), nb.alias("n_lines"))

    return F.aggregate(split_lines(code), init, step)


def score_from_counts(rc) -> Column:
    """Lint-score shape from struct(penalty, n_lines); undefined or exactly 0 -> 0.05."""
    raw = F.lit(10.0) - F.lit(10.0) * rc["penalty"] / F.nullif(rc["n_lines"], F.lit(0)).cast("double")
    return F.when(raw.isNull() | (raw == F.lit(0.0)), F.lit(0.05)).otherwise(raw)


def rule_score(code, rules=None, syntax_ok=None) -> Column:
    """M2: 10 - 10 x penalty / logical lines, the lint-score shape.

    No logical line (score undefined) or a score of exactly 0 -> 0.05; a known
    syntax error (``syntax_ok`` false) -> 0.0."""

    out = F.when(_col(code).isNotNull(), let(rule_counts(code, rules), score_from_counts))
    if syntax_ok is not None:
        out = F.when(_col(syntax_ok) == F.lit(False), F.lit(0.0)).otherwise(out)
    return out


def list_avg_max(values) -> Column:
    """M5: struct(avg, max) of a numeric array, 0/0 when empty."""
    v = _col(values)
    n = F.size(v)
    s = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.struct(
        F.when(n > 0, s / n.cast("double")).otherwise(F.lit(0.0)).alias("avg"),
        F.coalesce(F.array_max(v).cast("double"), F.lit(0.0)).alias("max"),
    )


def mean_runtime(runs: DataFrame, keys=("model", "task_id"), seconds: str = "seconds",
                 max_time: float = 1.0) -> DataFrame:
    """M3: mean seconds over recorded attempts (failed calls are timed too) and the
    efficiency score; a sample with no runs gets NULL after the join."""
    g = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_attempts"), F.avg(seconds).alias("mean_seconds"))
    return g.withColumn("efficiency_score", scale_efficiency("mean_seconds", max_time))


def sample_keys(*tables: DataFrame, keys=None) -> list[str]:
    """``keys``, or model and task plus the sample number where every table has one."""
    if keys is not None:
        return list(keys)
    have = [set(t.columns) for t in tables if t is not None]
    return ["model", "task_id"] + (["sample_id"] if all("sample_id" in h for h in have) else [])


def attach_verdicts(samples: DataFrame, verdicts: DataFrame, keys=None) -> DataFrame:
    """Left join recorded verdicts; missing verdict -> not passed (gate 0).

    Keyed on the sample (model, task_id and, where both tables have it, sample_id).
    Several verdicts of one key become one before the join - it passed if every one of
    them says so - so the result has exactly one row for each sample row."""
    keys = sample_keys(samples, verdicts, keys=keys)
    v = verdicts.groupBy(*keys).agg(F.bool_and("passed").alias("_v"))
    return samples.drop("passed").join(v, keys, "left").withColumnRenamed("_v", "passed").withColumn(
        "functional_correctness", gate("passed"))


def unattempted(problems: DataFrame, samples: DataFrame, key: str = "task_id") -> DataFrame:
    """Problems with no sample (left anti join)."""
    return problems.join(samples.select(key).distinct(), key, "left_anti")


def lookup_tasks(samples: DataFrame, problems: DataFrame, key: str = "task_id", broadcast_rows: int = 2000) -> DataFrame:
    """Every sample with its problem's columns and ``known`` (its task has a problem).

    Of several problems of one task the smallest row counts, so there is one row for each sample.
    Up to ``broadcast_rows`` problems are broadcast, after counting; a larger table is joined by a shuffle,
    whose skewed partitions (hot tasks) adaptive execution splits."""
    rest = [c for c in problems.columns if c != key]
    one = problems.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest, F.lit(True).alias("known"))).alias("_p"))
    one = broadcast_if_small(one.select(key, "_p.*"), broadcast_rows)
    return samples.join(one, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def lookup_report(samples: DataFrame, problems: DataFrame, key: str = "task_id") -> DataFrame:
    """Each task with its number of samples and its status: ``matched``, ``unknown`` (samples but no problem) or
    ``unattempted`` (a problem without samples), all from one join of the counts of each task. A null task is unknown."""
    counts = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n_samples"))
    given = problems.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_given", F.lit(True))
    both = counts.join(given, key, "full")
    status = F.when(F.col("_given").isNull(), "unknown").when(F.col("n_samples").isNull(), "unattempted").otherwise("matched")
    return both.select(key, F.coalesce("n_samples", F.lit(0)).cast("bigint").alias("n_samples"), status.alias("status"))


def evaluate(samples: DataFrame, verdicts: DataFrame | None = None, runs: DataFrame | None = None,
             code: str = "completion", keys=None, words=None, block_marker: str = PY_BLOCK_MARKER, rules=None,
             zero_policy: str = "drop", syntax_ok: str | None = None, keep_code: bool = False) -> DataFrame:
    """The whole scoring run as one lazy plan: samples (+ verdicts) (+ runs) -> metrics ->
    scaled experts -> gated product of experts. Output: one row per sample, keys + the
    summary columns (and ``code`` with ``keep_code``).

    The text metrics come first, in the scan of the samples, so the joins move a few
    numbers of each sample and no text (unless ``keep_code`` asks for it). Keys are model,
    task_id and, where the samples have one, sample_id; verdicts and runs without a
    sample_id hold for all samples of their task. ``syntax_ok``: a boolean column of
    ``samples``; false means the code does not parse: no complexity, style score 0."""
    keys = sample_keys(samples, keys=keys)
    c = F.coalesce(F.col(code), F.lit(""))
    broken = F.lit(False) if syntax_ok is None else ~F.coalesce(F.col(syntax_ok), F.lit(True))
    given = [F.col("passed")] if verdicts is None and "passed" in samples.columns else []
    # the rule fold also counts logical lines (= LOC), so the text is split twice, not three times
    df = samples.select(
        *keys, *given, *([F.col(code)] if keep_code else []), broken.alias("_broken"),
        decision_points(c, words, block_marker).alias("_cc"),
        rule_counts(c, rules).alias("_rc"),
    )
    style = F.when(F.col("_broken"), F.lit(0.0)).otherwise(score_from_counts(F.col("_rc")))
    df = df.select(
        *keys, *([F.col("passed")] if given else []), *([F.col(code)] if keep_code else []),
        scale_cc(F.when(~F.col("_broken"), F.col("_cc.avg_cc"))).alias("avg_cyclomatic_complexity"),
        scale_cc(F.when(~F.col("_broken"), F.col("_cc.max_cc"))).alias("max_cyclomatic_complexity"),
        scale_lint(style).alias("style_score"),
        scale_loc(F.col("_rc.n_lines")).alias("loc_score"),
    )
    if verdicts is not None:
        df = attach_verdicts(df, verdicts, [k for k in keys if k in verdicts.columns])
    elif not given:
        df = df.withColumn("passed", F.lit(None).cast("boolean"))
    if runs is not None:
        on = [k for k in keys if k in runs.columns]
        df = df.join(mean_runtime(runs, on).select(*on, "efficiency_score"), on, "left")
    else:
        df = df.withColumn("efficiency_score", F.lit(None).cast("double"))
    df = df.withColumn("functional_correctness", gate("passed")).withColumn(
        "overall_score",
        overall_score("functional_correctness", "avg_cyclomatic_complexity", "style_score",
                      "efficiency_score", "loc_score", zero_policy=zero_policy),
    )
    return df.select(*keys, *([code] if keep_code else []), "passed", "avg_cyclomatic_complexity", "max_cyclomatic_complexity",
                     "style_score", "efficiency_score", "loc_score", "functional_correctness", "overall_score")
