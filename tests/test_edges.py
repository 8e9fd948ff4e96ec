"""Edge tables: empty input, one model, constant column, all-null metric, NaN strings, ties."""

import pytest

from scorelab.operators import agg, dist, norm, rank
from scorelab.operators.metrics import decision_points, list_avg_max, rule_score

SCHEMA = ("model string, task_id string, passed boolean, functional_correctness double, efficiency_score double, "
          "avg_cyclomatic_complexity double, max_cyclomatic_complexity double, style_score double, "
          "loc_score double, overall_score double")


def test_empty_input_gives_empty_results(spark):
    df = spark.createDataFrame([], SCHEMA)
    m = agg.model_means(df)
    assert m.count() == 0 and "overall_score" in m.columns
    assert dist.box_stats(df).count() == 0
    assert dist.violin_kde(df).count() == 0
    assert rank.spearman_long(m, bounded_groups=True).count() == 0
    assert norm.trend_lines(df, ["style_score"]).count() == 0
    assert agg.pass_at_k(df).count() == 0


def test_constant_and_null_columns(spark):
    rows = [("a", "t1", True, 1.0, None, 0.5, 0.5, 0.3, 0.9, 0.6),
            ("b", "t1", False, 0.0, None, 0.5, 0.5, 0.3, 0.8, 0.0),
            ("c", "t1", True, 1.0, None, 0.5, 0.5, 0.3, 0.7, float("nan"))]
    df = spark.createDataFrame(rows, SCHEMA)
    m = agg.model_means(df)
    assert m.count() == 2  # NaN overall is dropped like a missing value
    n = {r["model"]: r for r in norm.minmax_norm(m, ["overall_score", "style_score"]).collect()}
    assert n["a"]["style_score"] == 0.0 and n["a"]["overall_score"] == 1.0
    h = {r["model"]: r for r in norm.heatmap_norm(m).collect()}
    assert h["a"]["style_score"] == 0.5 and h["a"]["efficiency_score"] is None
    s = {(r["metric_a"], r["metric_b"]): r for r in rank.spearman_long(m, bounded_groups=True).collect()}
    assert ("efficiency_score", "efficiency_score") not in s  # all NULL: no pair rows
    assert s[("style_score", "style_score")]["rho"] is None  # constant: undefined, not an error


def test_one_model_box_and_kde(spark):
    df = spark.createDataFrame([("m", 0.5)] * 3, "model string, overall_score double")
    b = dist.box_stats(df).first()
    assert (b["q1"], b["median"], b["q3"], b["whislo"], b["whishi"], b["n_outliers"]) == (0.5, 0.5, 0.5, 0.5, 0.5, 0)
    k = dist.violin_kde(df).collect()
    assert len(k) == 1 and all(r["density"] is None for r in k)


def test_list_avg_max(spark):
    df = spark.createDataFrame([([1.0, 3.0],), ([],)], "v array<double>")
    got = [tuple(r[0]) for r in df.select(list_avg_max("v")).collect()]
    assert got == [(2.0, 3.0), (0.0, 0.0)]


def test_python_complexity_defaults(spark):
    code = "import os\ndef f(a):\n    if a and not a:\n        return 1\n    for x in a:\n        pass\n" \
           "class K:\n    def g(self):\n        while True or False:\n            break\n"
    df = spark.createDataFrame([(code,), ("x = 1\n",), (None,)], "c string")
    got = [r[0] for r in df.select(decision_points("c")).collect()]
    # blocks: f = 1 + if + and + for = 4; K = 1; g = 1 + while + or = 3
    assert (got[0]["avg_cc"], got[0]["max_cc"], got[0]["n_blocks"]) == (8 / 3, 4.0, 3)
    assert (got[1]["avg_cc"], got[1]["max_cc"], got[1]["n_blocks"]) == (0.0, 0.0, 0)
    assert got[2] is None


def test_rule_score_floors(spark):
    df = spark.createDataFrame([("",), ("x  = 1 ",), ("ok",)], "c string")
    got = [r[0] for r in df.select(rule_score("c")).collect()]
    assert got[0] == 0.05  # no logical line
    assert got[1] == pytest.approx(10 - 10 * (0.5 + 1.0) / 1)
    assert got[2] == 10.0


def test_violin_of_large_and_constant_values(spark):
    rows = [("a", 1e9 + x) for x in (0.1, 0.2, 0.3, 0.4)] + [("b", 7.0)] * 3
    df = spark.createDataFrame(rows, "model string, overall_score double")
    got = dist.violin_kde(df, points=5, centers=True).collect()
    a, b = [r for r in got if r.model == "a"], [r for r in got if r.model == "b"]
    assert len(a) == 5 and all(r.density > 0 for r in a) and a[0].median == pytest.approx(1e9 + 0.25) and a[0].mean == pytest.approx(1e9 + 0.25)
    assert [(r.point, r.x, r.density, r.median) for r in b] == [(0, 7.0, None, 7.0)]
    binned = dist.violin_kde(df.where("model = 'a'"), points=5, bin_width=0.5).collect()
    assert len(binned) == 5 and all(r.density > 0 for r in binned)
