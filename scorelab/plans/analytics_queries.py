"""Registered queries for cross-model analytics: ranks, normalisation, distributions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from scorelab.operators import agg, dist, norm, rank
from scorelab.plans import relations as R
from scorelab.plans.catalog import register, rounded
from scorelab.schemas import METRICS

L = R.ORACLE_L
E = R.ORACLE_E
MEAN_COLS = ["overall_score"] + METRICS

# DuckDB: per-model means of L and their long form with metric positions.
_MEANS = f"SELECT model, {', '.join(f'avg({c}) AS {c}' for c in MEAN_COLS)} FROM ({L}) WHERE overall_score IS NOT NULL GROUP BY model"
_MEANS_LONG = " UNION ALL ".join(
    f"SELECT model, {i} AS pos, '{m}' AS metric, round({m}, 12) AS v FROM means" for i, m in enumerate(METRICS)
)


def _avg_rank(col: str, part: str) -> str:
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {col} DESC) "
            f"+ (count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0::DOUBLE)")


def _pearson(x: str, y: str) -> str:
    return (f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) = 0 THEN NULL "
            f"ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END")


def _pvalue_sql(rho: str, n: str) -> str:
    """Two-sided t-test p-value of a correlation, same closed form as the Spark side."""
    v = f"({n} - 2)"
    theta = f"atan(abs({rho}) * sqrt({v} / (1.0 - {rho} * {rho})) / sqrt({v}))"
    c2 = f"(cos({theta}) * cos({theta}))"

    def series(last: str, a: float, b: float) -> str:
        return (f"list_sum(list_transform(range(0, ({last}) + 1), lambda i: "
                f"list_reduce(list_transform(range(0, i), lambda j: (2.0 * j + {a}) / (2.0 * j + {b})) || [1.0], "
                f"lambda x, y: x * y) * power({c2}, i)))")

    odd = f"(2.0 / pi()) * ({theta} + sin({theta}) * cos({theta}) * {series(f'greatest(({v} - 3) // 2, 0)', 2.0, 3.0)})"
    even = f"sin({theta}) * {series(f'({v} - 2) // 2', 1.0, 2.0)}"
    a = f"CASE WHEN {v} = 1 THEN (2.0 / pi()) * {theta} WHEN {v} % 2 = 1 THEN {odd} ELSE {even} END"
    return (f"CASE WHEN {rho} IS NULL OR {n} <= 2 THEN NULL WHEN abs({rho}) >= 1 THEN 0.0 "
            f"ELSE greatest(1.0 - ({a}), 0.0) END")


_SPEARMAN_SQL = f"""
WITH means AS ({_MEANS}), long AS ({_MEANS_LONG}),
pairs AS (
  SELECT a.pos AS pos_a, a.metric AS metric_a, a.v AS a, b.pos AS pos_b, b.metric AS metric_b, b.v AS b
  FROM long a JOIN long b ON a.model = b.model AND a.pos >= b.pos
  WHERE a.v IS NOT NULL AND b.v IS NOT NULL
), ranked AS (
  SELECT *, {_avg_rank('a', 'pos_a, pos_b')} AS ra, {_avg_rank('b', 'pos_a, pos_b')} AS rb FROM pairs
), corr AS (
  SELECT pos_a, metric_a, pos_b, metric_b, {_pearson('ra', 'rb')} AS rho, count(*) AS n
  FROM ranked GROUP BY pos_a, metric_a, pos_b, metric_b
)
"""


def _means(spark, sf_dir):
    return agg.model_means(R.measurements(spark, sf_dir), with_count=False)


@register("spearman_matrix",
          _SPEARMAN_SQL + "SELECT pos_a, metric_a, pos_b, metric_b, round(rho, 6) AS rho, n FROM corr")
def spearman_matrix(spark, sf_dir):
    """Spearman rho between metrics over per-model means, lower triangle."""
    s = rank.spearman_long(_means(spark, sf_dir), METRICS, bounded_groups=True)
    return rounded(s.select("pos_a", "metric_a", "pos_b", "metric_b", "rho", "n"))


@register("spearman_pvalues",
          _SPEARMAN_SQL + f"SELECT pos_a, metric_a, pos_b, metric_b, round({_pvalue_sql('rho', 'n')}, 6) AS p FROM corr")
def spearman_pvalues(spark, sf_dir):
    """Two-sided p-values of the Spearman matrix (t with n-2 d.o.f.)."""
    s = rank.spearman_long(_means(spark, sf_dir), METRICS, bounded_groups=True)
    return rounded(s.select("pos_a", "metric_a", "pos_b", "metric_b", "p"))


_CONC_SQL = f"""
WITH means AS ({_MEANS}), long AS ({_MEANS_LONG}),
pairs AS (
  SELECT l.pos, l.metric, l.v AS a, round(m.overall_score, 12) AS b
  FROM long l JOIN means m ON l.model = m.model WHERE l.v IS NOT NULL AND m.overall_score IS NOT NULL
), ranked AS (
  SELECT *, {_avg_rank('a', 'pos')} AS ra, {_avg_rank('b', 'pos')} AS rb FROM pairs
), corr AS (
  SELECT metric, {_pearson('ra', 'rb')} AS rho, count(*) AS n,
         least(min(ra), min(rb)) AS rank_min, greatest(max(ra), max(rb)) AS rank_max
  FROM ranked GROUP BY metric
)
SELECT metric, round(rho, 6) AS rho, round({_pvalue_sql('rho', 'n')}, 6) AS p, n,
       round(rank_min, 6) AS rank_min, round(rank_max, 6) AS rank_max FROM corr
"""


@register("rank_concordance", _CONC_SQL)
def rank_concordance(spark, sf_dir):
    """A16 + W2: each metric's model ranking against the overall ranking."""
    return rounded(rank.rank_concordance(_means(spark, sf_dir), METRICS))


_ROWS_SQL = f"""
WITH l AS ({L}), long AS (
  {" UNION ALL ".join(f"SELECT '{m}' AS metric, round({m}, 12) AS a, round(overall_score, 12) AS b FROM l" for m in METRICS)}
), pairs AS (SELECT * FROM long WHERE a IS NOT NULL AND b IS NOT NULL),
ranked AS (SELECT *, {_avg_rank('a', 'metric')} AS ra, {_avg_rank('b', 'metric')} AS rb FROM pairs)
SELECT metric, round({_pearson('ra', 'rb')}, 6) AS rho, count(*) AS n FROM ranked GROUP BY metric
"""


@register("spearman_rows", _ROWS_SQL)
def spearman_rows(spark, sf_dir):
    """A16 over every scored row: Spearman rho of each metric against the overall score,
    ranked with the distributed average-rank operator."""
    s = rank.spearman_long(R.measurements(spark, sf_dir), METRICS, against="overall_score")
    return rounded(s.select(F.col("metric_a").alias("metric"), "rho", "n"))


_PEARSON_SQL = "\nUNION ALL\n".join(
    f"""SELECT {i} AS pos_a, '{a}' AS metric_a, {j} AS pos_b, '{b}' AS metric_b,
       round({_pearson(a, b)}, 6) AS rho, count({a} + {b}) AS n FROM ({L}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""
    for i, a in enumerate(METRICS) for j, b in enumerate(METRICS[: i + 1])
)


@register("pearson_matrix", _PEARSON_SQL)
def pearson_matrix(spark, sf_dir):
    """Pearson correlation between metrics over all rows."""
    return rounded(rank.pearson_matrix(R.measurements(spark, sf_dir), METRICS))


def _norm_sql(constant: str | None, invert=()) -> str:
    ex = ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in MEAN_COLS)
    cols = []
    for c in MEAN_COLS:
        num = f"(mx_{c} - {c})" if c in invert else f"({c} - mn_{c})"
        if constant is None:
            e = f"CASE WHEN mx_{c} = mn_{c} THEN {c} - mn_{c} ELSE {num} / (mx_{c} - mn_{c}) END"
        else:
            e = f"CASE WHEN mx_{c} = mn_{c} THEN {constant} ELSE {num} / (mx_{c} - mn_{c}) END"
        cols.append(f"round({e}, 6) AS {c}")
    return f"WITH means AS ({_MEANS}), ex AS (SELECT {ex} FROM means) SELECT model, {', '.join(cols)} FROM means, ex"


@register("minmax_norm", _norm_sql(None))
def minmax_norm(spark, sf_dir):
    """Min-max normalised per-model means, constant column -> 0."""
    m = _means(spark, sf_dir)
    return rounded(norm.minmax_norm(m, MEAN_COLS))


_INVERT = [c for c in MEAN_COLS if "cyclomatic_complexity" in c or c == "loc_score"]


@register("heatmap_norm", _norm_sql("0.5", _INVERT))
def heatmap_norm(spark, sf_dir):
    """A9 + A3 + O1: heatmap normalisation, CC and LOC inverted, best model first."""
    return rounded(norm.heatmap_norm(_means(spark, sf_dir), METRICS))


_DELTA_BASE = f"""WITH n AS ({_norm_sql(None)}), d AS (
  {" UNION ALL ".join(f"SELECT model, '{m}' AS metric, overall_score - {m} AS delta FROM n" for m in METRICS)}
)"""
# the normalised values above are rounded; recompute the delta from unrounded ones
_DELTA_BASE = _DELTA_BASE.replace("round(", "(").replace(", 6) AS", ") AS")


@register("delta_table", _DELTA_BASE + """
SELECT model, metric, round(delta, 6) AS delta, CASE WHEN delta > 0 THEN 'positive' ELSE 'negative' END AS sign FROM d""")
def delta_table(spark, sf_dir):
    """Normalised overall minus normalised metric per model."""
    return rounded(norm.delta_table(_means(spark, sf_dir), METRICS))


@register("delta_summary", _DELTA_BASE + """
SELECT metric, round(avg(delta), 6) AS mean_delta, count_if(delta > 0) AS n_positive, count(*) AS n FROM d GROUP BY metric""")
def delta_summary(spark, sf_dir):
    """A10: mean delta and number of models with a positive delta per metric."""
    return rounded(norm.delta_summary(_means(spark, sf_dir), METRICS))


_TREND = ["style_score", "loc_score", "avg_cyclomatic_complexity"]


@register("trend_lines", "\nUNION ALL\n".join(
    f"""SELECT model, '{m}' AS metric,
       round(CASE WHEN regr_count(overall_score, {m}) >= 3 THEN regr_slope(overall_score, {m}) END, 6) AS slope,
       round(CASE WHEN regr_count(overall_score, {m}) >= 3 THEN regr_intercept(overall_score, {m}) END, 6) AS intercept,
       regr_count(overall_score, {m}) AS n
FROM ({L}) GROUP BY model""" for m in _TREND))
def trend_lines(spark, sf_dir):
    """Overall ~ metric least-squares line per model, pairwise complete."""
    return rounded(norm.trend_lines(R.measurements(spark, sf_dir), _TREND))


def _box_sql(src: str, key: str, value: str) -> str:
    return f"""
WITH e AS (SELECT {key} AS model, {value} AS value FROM ({src}) WHERE {value} IS NOT NULL),
q AS (SELECT model, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd,
             quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM e GROUP BY model),
w AS (SELECT q.model, min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END) AS wlo,
             max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whi
      FROM e JOIN q USING (model) GROUP BY q.model),
s AS (SELECT q.*, CASE WHEN wlo IS NULL OR wlo > q1 THEN q1 ELSE wlo END AS whislo,
             CASE WHEN whi IS NULL OR whi < q3 THEN q3 ELSE whi END AS whishi FROM q JOIN w USING (model))
"""


def _box_select(key: str) -> str:
    return f"""SELECT s.model AS {key}, s.n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(q1, 6) AS q1,
       round(median, 6) AS median, round(q3, 6) AS q3, round(whislo, 6) AS whislo, round(whishi, 6) AS whishi,
       CAST(count_if(e.value < whislo OR e.value > whishi) AS BIGINT) AS n_outliers
FROM s JOIN e USING (model) GROUP BY ALL"""


@register("box_stats", _box_sql(E, "model", "value") + _box_select("model"))
def box_stats(spark, sf_dir):
    """Box statistics of event values per event type (exact distributed quantiles)."""
    return rounded(dist.box_stats(R.runs(spark, sf_dir), "model", "value"))


@register("box_stats_overall", _box_sql(L, "model", "overall_score") + _box_select("model"))
def box_stats_overall(spark, sf_dir):
    """A6 on the reference's own view: overall score distribution per model."""
    return rounded(dist.box_stats(R.measurements(spark, sf_dir), "model", "overall_score"))


@register("box_outliers", _box_sql(E.replace("value / 100 AS seconds", "value / 100 AS seconds, event_id"), "model", "value").replace(
    "SELECT model AS model, value AS value", "SELECT model AS model, value AS value") + """
SELECT e2.model, e2.attempt, round(e2.value, 6) AS value
FROM (""" + E + """) e2 JOIN s ON e2.model = s.model
WHERE e2.value < s.whislo OR e2.value > s.whishi""")
def box_outliers(spark, sf_dir):
    """The attempts outside the whiskers."""
    return rounded(dist.box_outliers(R.runs(spark, sf_dir), "model", "value", carry=("attempt",)))


_SQRT2PI = math.sqrt(2.0 * math.pi)


@register("violin_kde", f"""
WITH e AS (SELECT event_type AS model, value FROM events WHERE value IS NOT NULL),
st AS (SELECT model, count(*) AS n, min(value) AS vmin, max(value) AS vmax,
              stddev_samp(value) * power(count(*), -0.2) AS h FROM e GROUP BY model),
pts AS (SELECT st.*, p.point,
               CASE WHEN p.point = 99 THEN vmax ELSE vmin + p.point * ((vmax - vmin) / 99.0) END AS x
        FROM st, (SELECT unnest(range(0, 100)) AS point) p)
SELECT pts.model, CAST(pts.point AS INTEGER) AS point, round(pts.x, 6) AS x,
       round(CASE WHEN h > 0 THEN sum(exp(-0.5 * ((x - e.value) / h) * ((x - e.value) / h))) / (n * h * {_SQRT2PI!r}) END, 6) AS density
FROM pts JOIN e ON pts.model = e.model GROUP BY pts.model, pts.point, pts.x, pts.n, pts.h""")
def violin_kde(spark, sf_dir):
    """Gaussian KDE (Scott bandwidth) of event values per type at 100 points."""
    return rounded(dist.violin_kde(R.runs(spark, sf_dir), "model", "value"))


@register("difficulty_dist", f"""
WITH l AS ({L}), bands AS (
  SELECT task_id, CASE WHEN avg(functional_correctness) < 1.0 / 3.0 THEN 'hard'
                       WHEN avg(functional_correctness) < 2.0 / 3.0 THEN 'medium' ELSE 'easy' END AS difficulty
  FROM l GROUP BY task_id
), x AS (SELECT b.difficulty, l.overall_score FROM l JOIN bands b USING (task_id))
""" + _box_sql("SELECT * FROM x", "difficulty", "overall_score").replace("WITH e AS", ", e AS") + _box_select("difficulty"))
def difficulty_dist(spark, sf_dir):
    """Overall-score box statistics by task-difficulty band."""
    return rounded(dist.difficulty_dist(R.measurements(spark, sf_dir)))


@register("violin_centers", """SELECT event_type AS model, 100 AS n_points, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median
FROM (SELECT event_type, value FROM events WHERE value IS NOT NULL) GROUP BY event_type""")
def violin_centers(spark, sf_dir):
    """Mean and median of each violin, with the number of its points."""
    v = dist.violin_kde(R.runs(spark, sf_dir), "model", "value", centers=True)
    return rounded(v.groupBy("model").agg(F.count("*").cast("int").alias("n_points"), F.first("mean").alias("mean"), F.first("median").alias("median")))
