"""Scaling, gate, product of experts, grade bands, coercion."""

import pytest
from pyspark.sql import functions as F

from scorelab.functions.poe import overall_score, poe_quality, weighted_poe
from scorelab.functions.scale import (coerce_numeric, display_label, gate, grade_band, safe_name, scale_cc,
                                      scale_efficiency, scale_lint, scale_loc, title_case)


def one(spark, expr, value, schema="x double"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("cc,expected", [(1, 0.9), (5, 0.5), (15, 0.0), (0, 1.0), (None, None)])
def test_scale_cc_examples(spark, cc, expected):
    got = one(spark, scale_cc, None if cc is None else float(cc))
    assert (got is None and expected is None) or got == pytest.approx(expected)


@pytest.mark.parametrize("t,expected", [(0.1, 0.9), (0.5, 0.5), (2.0, 0.0), (None, None)])
def test_scale_efficiency_examples(spark, t, expected):
    got = one(spark, scale_efficiency, t)
    assert (got is None and expected is None) or got == pytest.approx(expected)


@pytest.mark.parametrize("loc,expected", [(10, 0.8), (25, 0.5), (50, 0.0), (80, 0.0)])
def test_scale_loc_examples(spark, loc, expected):
    assert one(spark, scale_loc, float(loc)) == pytest.approx(expected)


@pytest.mark.parametrize("s,expected", [(9.0, 0.9), (10.0, 1.0), (12.0, 1.0), (-3.0, -0.3), (None, None)])
def test_scale_lint(spark, s, expected):
    got = one(spark, scale_lint, s)
    assert (got is None and expected is None) or got == pytest.approx(expected)


def test_gate(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "p boolean")
    assert [r[0] for r in df.select(gate("p")).collect()] == [1.0, 0.0, 0.0]


# Golden rows: passed, avg CC, style, efficiency, LOC -> overall (published scored rows).
GOLDEN = [
    (False, None, 0.0, None, 0.98, 0.0),
    (True, 0.9, 0.5, 0.9999979337056478, 0.96, 0.8107196740873088),
    (True, 0.7, 0.14285714285714288, None, 0.86, 0.4414004962442104),
    (True, 0.6, 0.005, None, 0.88, 0.1382084646002237),
    (False, 0.5, 0.909090909090909, 0.9999972184499105, 0.78, 0.0),
]


def test_poe_golden_rows(spark):
    df = spark.createDataFrame(GOLDEN, "passed boolean, cc double, style double, eff double, loc double, want double")
    got = df.select(overall_score(gate("passed"), "cc", "style", "eff", "loc").alias("o"), "want").collect()
    for r in got:
        assert r["o"] == pytest.approx(r["want"], abs=1e-15)


def test_poe_zero_policy(spark):
    df = spark.createDataFrame([(0.0, 0.5, 0.5, 0.5)], "a double, b double, c double, d double")
    drop = df.select(poe_quality("a", "b", "c", "d")).first()[0]
    zero = df.select(poe_quality("a", "b", "c", "d", zero_policy="zero")).first()[0]
    assert drop == pytest.approx(0.5) and zero == 0.0


def test_poe_none_kept_is_zero(spark):
    df = spark.createDataFrame([(None, 0.0, -1.0)], "a double, b double, c double")
    assert df.select(poe_quality("a", "b", "c")).first()[0] == 0.0


def test_weighted_poe(spark):
    df = spark.createDataFrame([(0.25, 0.5, 0.0)], "a double, b double, c double")
    got = df.select(weighted_poe(["a", "b", "c"], [2.0, 1.0, 3.0])).first()[0]
    assert got == pytest.approx((0.25 ** 2 * 0.5) ** (1 / 3))
    ones = df.select(weighted_poe(["a", "b", "c"], [1, 1, 1])).first()[0]
    assert ones == pytest.approx(df.select(poe_quality("a", "b", "c")).first()[0])


@pytest.mark.parametrize("s,band", [(0.95, "excellent"), (0.90, "excellent"), (0.8999, "good"), (0.75, "good"),
                                    (0.6, "regular"), (0.4, "poor"), (0.39, "critical"), (0.0, "critical"),
                                    (None, None)])
def test_grade_band(spark, s, band):
    assert one(spark, grade_band, s) == band


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), ("NaN",), (None,), (" 2 ",)], "s string")
    got = [r[0] for r in df.select(coerce_numeric("s")).collect()]
    assert got[0] == 1.5 and got[1] is None and got[2] is None and got[3] is None


@pytest.mark.parametrize("s", ["loc_score", "abc1def ghi", "x_y-z", "ALL CAPS", "o'neil", "3rd place", ""])
def test_title_case_matches_python(spark, s):
    assert one(spark, title_case, s, "x string") == s.title()


def test_display_label_and_safe_name(spark):
    df = spark.createDataFrame([("style_score",), ("my_metric",)], "x string")
    assert [r[0] for r in df.select(display_label("x")).collect()] == ["Code Style", "My Metric"]
    assert one(spark, safe_name, "org/model:7b", "x string") == "org_model_7b"


def test_nan_is_a_missing_measurement(spark):
    from scorelab.functions.poe import poe_quality, weighted_poe
    from scorelab.functions.scale import coerce_numeric, grade_band, scale_cc, scale_efficiency, scale_lint, scale_loc

    df = spark.createDataFrame([(float("nan"), 0.5)], "a double, b double")
    row = df.select(grade_band("a"), scale_cc("a"), scale_lint("a"), scale_efficiency("a"), scale_loc("a")).first()
    assert list(row) == [None] * 5
    q = df.select(poe_quality("a", "b").alias("p"), weighted_poe(["a", "b"], [1, 1]).alias("w"), poe_quality("a", "b", zero_policy="zero").alias("z")).first()
    assert (q.p, q.w, q.z) == (0.5, 0.5, 0.0)
    text = [("1d", None), ("2f", None), ("NaN", None), (" 2 ", 2.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("", None), ("0x10", None), ("-inf", float("-inf"))]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(text)], "i int, s string")
    assert [r[1] for r in df.select("i", coerce_numeric("s")).orderBy("i").collect()] == [v for _, v in text]
