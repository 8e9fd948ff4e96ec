"""Golden checks (values in FIXTURES.md). Per-model analytics start from the fixed means below;
checks that need the published rows are defined only where those rows are at hand."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import GOLDEN_DIR, local_scratch
from scorelab.functions.poe import overall_score
from scorelab.functions.scale import gate
from scorelab.operators import agg, dist, norm, rank
from scorelab.sources.io import read_summaries, write_summary_csv

SUMMARY_GLOB = os.path.join(GOLDEN_DIR, "summary", "*_summary.csv")
HAVE_ROWS = bool(GOLDEN_DIR and glob.glob(SUMMARY_GLOB))

# Per-model means, score distributions, matrices, deltas and counts of the published results.

MODELS = ["codegemma_7b", "codellama_7b", "deepseek-coder_6.7b", "qwen2.5-coder_7b"]
MEANS = {
    "codegemma_7b": (0.164474106, 0.286585366, 0.999998602, 0.704455446, 0.703960396, 0.237610960, 0.892560976),
    "codellama_7b": (0.110118645, 0.286585366, 0.999998746, 0.727205882, 0.724264706, 0.155740750, 0.875243902),
    "deepseek-coder_6.7b": (0.251774322, 0.408536585, 0.999998403, 0.655263158, 0.653508772, 0.303493990, 0.875121951),
    "qwen2.5-coder_7b": (0.458634465, 0.731707317, 0.999998740, 0.668402778, 0.667361111, 0.421287847, 0.880000000),
}
COLS = ["overall_score", "functional_correctness", "efficiency_score", "avg_cyclomatic_complexity",
        "max_cyclomatic_complexity", "style_score", "loc_score"]


@pytest.fixture(scope="module")
def summaries(spark):
    return read_summaries(spark, SUMMARY_GLOB).cache()


@pytest.fixture(scope="module")
def means(spark):
    """Means that ``model_means`` takes over rows around the published means: some lie above and below them by the same
    amount, some lack a metric, and some have no score and count for nothing."""
    rows = []
    for m, want in MEANS.items():
        rows += [(m, *[v + d for v in want]) for d in (-0.0625, 0.0625, 0.03125, -0.03125)]
        rows += [(m, want[0], *[None if i % 2 else float("nan") for i in range(len(want) - 1)]), (m, None, *[99.0] * (len(want) - 1)),
                 (m, float("nan"), *[-99.0] * (len(want) - 1))]
    table = spark.createDataFrame(rows, "model string, " + ", ".join(f"{c} double" for c in COLS)).repartition(3)
    return agg.model_means(table, with_count=False).cache()


# Published rows (passed, avg CC, style, efficiency, LOC -> overall).
ROWS = [(False, None, 0.0, None, 0.98, 0.0), (True, 0.9, 0.5, 0.9999979337056478, 0.96, 0.8107196740873088),
        (True, 0.7, 0.14285714285714288, None, 0.86, 0.4414004962442104), (True, 0.6, 0.005, None, 0.88, 0.1382084646002237),
        (False, 0.5, 0.909090909090909, 0.9999972184499105, 0.78, 0.0)]


# Published summary rows, every 33rd of each model (model and the nine summary columns).
SUMMARY_ROWS = [
    ("codegemma_7b", "HumanEval/0", False, None, None, 0.0, None, 0.98, 0.0, 0.0),
    ("codegemma_7b", "HumanEval/33", False, 0.7, 0.7, 0.005, 0.9999990463256836, 0.96, 0.0, 0.0),
    ("codegemma_7b", "HumanEval/66", True, 0.7, 0.7, 0.33333333333333337, 0.9999989668528239, 0.88, 1.0, 0.6731544981654126),
    ("codegemma_7b", "HumanEval/99", False, 0.9, 0.9, 0.5, 0.9999979337056478, 0.96, 0.0, 0.0),
    ("codegemma_7b", "HumanEval/132", False, None, None, 0.0, None, 0.8, 0.0, 0.0),
    ("codellama_7b", "HumanEval/0", True, 0.6, 0.6, 0.005, None, 0.88, 1.0, 0.1382084646002237),
    ("codellama_7b", "HumanEval/33", False, 0.9, 0.9, 0.005, 0.9999988873799642, 0.96, 0.0, 0.0),
    ("codellama_7b", "HumanEval/66", True, 0.7, 0.7, 0.005, 0.9999989668528239, 0.96, 1.0, 0.24076020651532115),
    ("codellama_7b", "HumanEval/99", False, 0.5, 0.4, 0.7647058823529411, None, 0.62, 0.0, 0.0),
    ("codellama_7b", "HumanEval/132", False, 0.4, 0.4, 0.005, 0.9999989668528239, 0.78, 0.0, 0.0),
    ("deepseek-coder_6.7b", "HumanEval/0", False, None, None, 0.0, None, 0.86, 0.0, 0.0),
    ("deepseek-coder_6.7b", "HumanEval/33", False, 0.19999999999999996, 0.19999999999999996, 0.005, 0.9999974568684896, 0.96, 0.0, 0.0),
    ("deepseek-coder_6.7b", "HumanEval/66", False, None, None, 0.0, None, 0.96, 0.0, 0.0),
    ("deepseek-coder_6.7b", "HumanEval/99", False, None, None, 0.0, None, 0.88, 0.0, 0.0),
    ("deepseek-coder_6.7b", "HumanEval/132", False, 0.5, 0.5, 0.9, 0.9999987284342448, 0.8, 0.0, 0.0),
    ("qwen2.5-coder_7b", "HumanEval/0", True, 0.6, 0.6, 0.7142857142857143, 0.999992291132609, 0.86, 1.0, 0.7791652577263217),
    ("qwen2.5-coder_7b", "HumanEval/33", True, 0.5, 0.5, 0.75, 0.9999984900156657, 0.84, 1.0, 0.7491649913587983),
    ("qwen2.5-coder_7b", "HumanEval/66", True, 0.7, 0.7, 0.005, 0.9999990463256836, 0.96, 1.0, 0.24076021129880149),
    ("qwen2.5-coder_7b", "HumanEval/99", True, 0.7, 0.7, 0.7142857142857143, 0.9999988873799642, 0.8200000000000001, 1.0, 0.800195018436737),
    ("qwen2.5-coder_7b", "HumanEval/132", False, 0.4, 0.4, 0.8181818181818181, 0.9999986489613851, 0.78, 0.0, 0.0),
]
SUMMARY_DDL = ("model string, task_id string, passed boolean, avg_cyclomatic_complexity double, max_cyclomatic_complexity double, style_score double, "
               "efficiency_score double, loc_score double, functional_correctness double, overall_score double")


@pytest.fixture(scope="module")
def published(spark):
    """The published rows, written as summary files and read back."""
    out = local_scratch(spark, "published")
    write_summary_csv(spark.createDataFrame(SUMMARY_ROWS, SUMMARY_DDL), out)
    return read_summaries(spark, out, model_from="partition").cache()


def test_published_rows_survive_files_and_scores_are_reproduced(published):
    def key(r):
        return r[:2]

    names = ["model", *SUMMARY_DDL.replace(" string", "").replace(" boolean", "").replace(" double", "").split(", ")[1:]]
    assert sorted(map(tuple, published.select(*names).collect()), key=key) == sorted(SUMMARY_ROWS, key=key)
    scored = published.select("overall_score", overall_score(gate("passed"), "avg_cyclomatic_complexity", "style_score", "efficiency_score", "loc_score").alias("o"))
    assert scored.agg(F.max(F.abs(F.col("o") - F.col("overall_score")))).first()[0] < 1e-12


def test_published_rows_by_model(published):
    rows = {m: [r for r in SUMMARY_ROWS if r[0] == m] for m in MODELS}
    got = {r["model"]: r for r in agg.model_means(published).collect()}
    for m, some in rows.items():
        assert got[m]["n"] == len(some) and got[m]["overall_score"] == pytest.approx(sum(r[9] for r in some) / len(some))
        known = [r[6] for r in some if r[6] is not None]
        assert got[m]["efficiency_score"] == pytest.approx(sum(known) / len(known))
    rate = {r["model"]: r["pass_at_k"] for r in agg.pass_at_k(published, ks=(1,)).collect()}
    assert rate == pytest.approx({m: sum(r[2] for r in some) / len(some) for m, some in rows.items()})
    for buckets in (256, 3, 1):
        for r in dist.box_stats(published, buckets=buckets).collect():
            q = np.quantile([x[9] for x in rows[r["model"]]], [0.25, 0.5, 0.75])
            assert (r["q1"], r["median"], r["q3"]) == pytest.approx(tuple(q), abs=1e-12)


# Tasks passed of 164 by each model.
PASSED = {"codegemma_7b": 47, "codellama_7b": 47, "deepseek-coder_6.7b": 67, "qwen2.5-coder_7b": 120}


def test_published_pass_rates(spark):
    rows = [(m, f"T/{i}", i < n) for m, n in PASSED.items() for i in range(164)]
    got = agg.pass_at_k(spark.createDataFrame(rows, "model string, task_id string, passed boolean"), ks=(1, 10)).collect()
    for r in got:
        assert r["pass_at_k"] == (pytest.approx(MEANS[r["model"]][1], abs=1e-9) if r["k"] == 1 else None)


def test_published_rows(spark):
    df = spark.createDataFrame(ROWS, "passed boolean, cc double, style double, eff double, loc double, want double")
    for r in df.select("want", overall_score(gate("passed"), "cc", "style", "eff", "loc").alias("o")).collect():
        assert r.o == pytest.approx(r.want, abs=1e-12)


def test_model_means(means):
    assert means.count() == len(MEANS)
    for r in means.collect():
        for c, want in zip(COLS, MEANS[r["model"]]):
            assert r[c] == pytest.approx(want, abs=1e-9), (r["model"], c)


SPEARMAN = {  # lower triangle, metric order
    ("efficiency_score", "functional_correctness"): -0.2108,
    ("avg_cyclomatic_complexity", "functional_correctness"): -0.7379,
    ("avg_cyclomatic_complexity", "efficiency_score"): 0.8,
    ("max_cyclomatic_complexity", "functional_correctness"): -0.7379,
    ("max_cyclomatic_complexity", "efficiency_score"): 0.8,
    ("max_cyclomatic_complexity", "avg_cyclomatic_complexity"): 1.0,
    ("style_score", "functional_correctness"): 0.9487,
    ("style_score", "efficiency_score"): -0.4,
    ("style_score", "avg_cyclomatic_complexity"): -0.8,
    ("style_score", "max_cyclomatic_complexity"): -0.8,
    ("loc_score", "functional_correctness"): -0.2108,
    ("loc_score", "efficiency_score"): 0.2,
    ("loc_score", "avg_cyclomatic_complexity"): 0.4,
    ("loc_score", "max_cyclomatic_complexity"): 0.4,
    ("loc_score", "style_score"): 0.0,
}


@pytest.mark.parametrize("bounded", [True, False])
def test_spearman_matrix_and_pvalues(means, bounded):
    s = rank.spearman_long(means, bounded_groups=bounded).collect()
    assert len(s) == 21
    for r in s:
        if r["metric_a"] == r["metric_b"]:
            assert r["rho"] == pytest.approx(1.0)
            continue
        want = SPEARMAN[(r["metric_a"], r["metric_b"])]
        assert round(r["rho"], 4) == pytest.approx(want, abs=1e-9)
        assert r["p"] == pytest.approx(1 - abs(r["rho"]), abs=1e-9)  # n = 4


def test_wide_matrix_layout(means):
    w = rank.wide_matrix(rank.full_matrix(rank.spearman_long(means))).collect()
    assert [r["metric"] for r in w][0] == "functional_correctness"
    assert w[4]["functional_correctness"] == pytest.approx(0.9487)


def test_rank_concordance(means):
    got = {r["metric"]: r["rho"] for r in rank.rank_concordance(means).collect()}
    want = {"functional_correctness": 0.9487, "style_score": 1.0, "efficiency_score": -0.4,
            "avg_cyclomatic_complexity": -0.8, "max_cyclomatic_complexity": -0.8, "loc_score": 0.0}
    for k, v in want.items():
        assert round(got[k], 4) == pytest.approx(v, abs=1e-9)


DELTAS = {
    "codegemma_7b": (0.155963, -0.425027, -0.527807, -0.557075, -0.152345, -0.844037),
    "codellama_7b": (0, -1, -1, -1, 0, -0.006993),
    "deepseek-coder_6.7b": (0.132481, 0.406454, 0.406454, 0.406454, -0.149957, 0.406454),
    "qwen2.5-coder_7b": (0, 0.018203, 0.817360, 0.804224, 0, 0.720280),
}
ORDER = ["functional_correctness", "efficiency_score", "avg_cyclomatic_complexity",
         "max_cyclomatic_complexity", "style_score", "loc_score"]


def test_deltas(means):
    for r in norm.delta_table(means).collect():
        # the means above have nine places; efficiency differs between models by 1e-7 only
        near = 5e-3 if r["metric"] == "efficiency_score" else 1e-6
        assert r["delta"] == pytest.approx(DELTAS[r["model"]][ORDER.index(r["metric"])], abs=near)
    summ = {r["metric"]: r for r in norm.delta_summary(means).collect()}
    assert summ["functional_correctness"]["mean_delta"] == pytest.approx(0.072111, abs=1e-6)
    assert summ["style_score"]["n_positive"] == 0 and summ["loc_score"]["n_positive"] == 2


def test_heatmap_norm(means):
    h = norm.heatmap_norm(means).collect()
    assert [r["model"] for r in h] == ["qwen2.5-coder_7b", "deepseek-coder_6.7b", "codegemma_7b", "codellama_7b"]
    assert h[0]["efficiency_score"] == pytest.approx(0.981797, abs=5e-3)
    assert h[2]["avg_cyclomatic_complexity"] == pytest.approx(0.316230, abs=1e-6)
    assert h[3]["loc_score"] == pytest.approx(0.993007, abs=1e-6)


BOX = {  # q1, median, q3, low whisker, high whisker, outliers, sd
    "codegemma_7b": (0, 0, 0.240760171, 0, 0.562852, 29, 0.294617),
    "codellama_7b": (0, 0, 0.221051175, 0, 0.256372, 13, 0.219855),
    "deepseek-coder_6.7b": (0, 0, 0.692142394, 0, 0.866602, 0, 0.338790),
    "qwen2.5-coder_7b": (0, 0.633684609, 0.781575930, 0, 0.875181, 0, 0.346432),
}


def test_rank_table(means):
    got = {(r["model"], r["metric"]): (r["overall_rank"], r["metric_rank"]) for r in rank.rank_table(means).collect()}
    assert got[("qwen2.5-coder_7b", "functional_correctness")] == (1.0, 1.0)
    # codegemma and codellama tie on correctness: average rank 3.5
    assert got[("codegemma_7b", "functional_correctness")][1] == 3.5
    assert got[("codellama_7b", "functional_correctness")] == (4.0, 3.5)


if HAVE_ROWS:
    def test_scan_shape(summaries):
        assert summaries.count() == 656
        assert sorted(r[0] for r in agg.distinct_models(summaries).collect()) == MODELS

    def test_null_counts(summaries):
        got = {r["model"]: (r["a"], r["m"], r["e"]) for r in summaries.groupBy("model").agg(
            F.count_if(F.col("avg_cyclomatic_complexity").isNull()).alias("a"),
            F.count_if(F.col("max_cyclomatic_complexity").isNull()).alias("m"),
            F.count_if(F.col("efficiency_score").isNull()).alias("e")).collect()}
        assert got == {"codegemma_7b": (63, 63, 69), "codellama_7b": (28, 28, 37),
                       "deepseek-coder_6.7b": (50, 50, 53), "qwen2.5-coder_7b": (20, 20, 23)}

    def test_poe_reproduces_every_published_score(summaries):
        recomputed = summaries.select(
            "overall_score",
            overall_score(gate("passed"), "avg_cyclomatic_complexity", "style_score", "efficiency_score",
                          "loc_score").alias("o"))
        worst = recomputed.agg(F.max(F.abs(F.col("o") - F.col("overall_score")))).first()[0]
        assert worst < 1e-12

    def test_pass_at_1(summaries):
        got = {r["model"]: r["pass_at_k"] for r in agg.pass_at_k(summaries, ks=(1, 10)).where("k = 1").collect()}
        assert got["qwen2.5-coder_7b"] == pytest.approx(120 / 164)
        assert got["codellama_7b"] == pytest.approx(47 / 164)
        k10 = agg.pass_at_k(summaries, ks=(10,)).collect()
        assert all(r["pass_at_k"] is None for r in k10)

    def test_trend_lines(summaries):
        got = {(r["model"], r["metric"]): (r["slope"], r["intercept"])
               for r in norm.trend_lines(summaries, ["style_score", "loc_score"]).collect()}
        assert got[("codegemma_7b", "style_score")][0] == pytest.approx(0.450100, abs=1e-6)
        assert got[("qwen2.5-coder_7b", "loc_score")][1] == pytest.approx(1.081644, abs=1e-6)

    def test_jitter_counts(summaries):
        got = {(r["model"], r["metric"]): r["n_distinct"] for r in agg.distinct_rounded(
            summaries, ["style_score", "loc_score", "avg_cyclomatic_complexity"]).collect()}
        assert [got[("codegemma_7b", m)] for m in ["style_score", "loc_score", "avg_cyclomatic_complexity"]] == [26, 18, 8]
        assert [got[("qwen2.5-coder_7b", m)] for m in ["style_score", "loc_score", "avg_cyclomatic_complexity"]] == [31, 16, 11]

    def test_grade_bands(summaries):
        got = {(r["model"], r["grade"]): r["n"] for r in agg.grade_counts(summaries).collect()}
        assert got[("qwen2.5-coder_7b", "good")] == 61 and got[("qwen2.5-coder_7b", "critical")] == 75
        assert got[("codellama_7b", "regular")] == 3 and ("codellama_7b", "poor") not in got

    def test_passing_per_task(summaries):
        got = {r["n_passing"]: r["n_tasks"] for r in agg.passing_models_per_task(summaries).collect()}
        assert got == {0: 31, 1: 44, 2: 43, 3: 33, 4: 13}

    @pytest.mark.parametrize("buckets", [256, 3, 1])
    def test_box_stats(summaries, buckets):
        for r in dist.box_stats(summaries, buckets=buckets).collect():
            q1, med, q3, lo, hi, nout, sd = BOX[r["model"]]
            assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, med, q3), abs=1e-9)
            assert (r["whislo"], r["whishi"]) == pytest.approx((lo, hi), abs=1e-6)
            assert r["n_outliers"] == nout and r["sd"] == pytest.approx(sd, abs=1e-6)

    def test_box_stats_approx(summaries):
        got = {r["model"]: r for r in dist.box_stats(summaries, method="approx").collect()}
        assert got["qwen2.5-coder_7b"]["n"] == 164
        assert got["qwen2.5-coder_7b"]["median"] == pytest.approx(0.633684609, abs=0.02)
        assert got["codegemma_7b"]["q1"] == 0.0 and got["codegemma_7b"]["whislo"] == 0.0

    def test_means_of_the_rows(summaries):
        for r in agg.model_means(summaries, with_count=False).collect():
            for c, want in zip(COLS, MEANS[r["model"]]):
                assert r[c] == pytest.approx(want, abs=1e-9), (r["model"], c)
