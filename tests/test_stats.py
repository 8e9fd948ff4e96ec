"""Closed-form p-values and pass@k."""

import pytest
from pyspark.sql import functions as F

from scorelab.functions.stats import pass_at_k_expr, t_test_pvalue

# (rho, n) -> p: values from the closed-form Student-t CDF.
P_CASES = [(-0.2108185, 4, 0.789182), (0.4, 4, 0.6), (0.5, 5, 0.391002), (0.3, 10, 0.399691),
           (0.942857, 6, 0.004805), (0.6, 21, 0.004036)]


@pytest.mark.parametrize("rho,n,p", P_CASES)
def test_t_pvalue(spark, rho, n, p):
    df = spark.createDataFrame([(rho, n)], "rho double, n long")
    assert df.select(t_test_pvalue(F.col("rho"), F.col("n"))).first()[0] == pytest.approx(p, abs=2e-6)


def test_t_pvalue_edges(spark):
    df = spark.createDataFrame([(1.0, 5), (0.3, 2), (None, 9), (0.5, 3)], "rho double, n long")
    got = [r[0] for r in df.select(t_test_pvalue(F.col("rho"), F.col("n"))).collect()]
    assert got[0] == 0.0 and got[1] is None and got[2] is None
    # v = 1: p = 1 - 2*atan(|t|)/pi
    import math

    t = 0.5 * math.sqrt(1 / (1 - 0.25))
    assert got[3] == pytest.approx(1 - 2 * math.atan(t) / math.pi)


@pytest.mark.parametrize("k,n,c,v", [(1, 5, 2, 0.4), (2, 5, 2, 0.7), (4, 5, 2, 1.0), (1, 5, 0, 0.0), (3, 10, 10, 1.0)])
def test_pass_at_k(spark, k, n, c, v):
    df = spark.createDataFrame([(n, c, k)], "n long, c long, k int")
    assert df.select(pass_at_k_expr(F.col("n"), F.col("c"), F.col("k"))).first()[0] == pytest.approx(v)


def test_pass_at_k_operator_reports_missing_k(spark):
    from scorelab.operators.agg import pass_at_k

    data = [("m", "t1", True), ("m", "t1", False), ("m", "t2", False), ("m", "t2", False), ("m", "t2", True)]
    df = spark.createDataFrame(data, "model string, task_id string, passed boolean")
    got = {r["k"]: r for r in pass_at_k(df, ks=(1, 2, 3)).collect()}
    assert got[1]["pass_at_k"] == pytest.approx((0.5 + 1 / 3) / 2)
    assert got[2]["pass_at_k"] == pytest.approx((1.0 + (1 - (2 / 3) * (1 / 2))) / 2)
    assert got[3]["pass_at_k"] is None and got[3]["min_n"] == 2


# Two-sided p of a correlation, by an independent Simpson rule or, for large n, the normal tail.
@pytest.mark.parametrize("rho,n,p", [(0.9, 100, 4.063405277490615e-37), (0.01, 1000, 0.7521238409748395), (0.0, 10**12, 1.0), (1e-5, 10**12, 1.523970604832105e-23),
                                     (1e-4, 10**8, 0.3173105124), (0.5, 3, 2 / 3), (0.999999, 50, 1.92208574376e-138), (-0.9, 100, 4.063405277490615e-37)])
def test_t_pvalue_for_every_n(spark, rho, n, p):
    df = spark.createDataFrame([(rho, n)], "rho double, n long")
    assert df.select(t_test_pvalue(F.col("rho"), F.col("n"))).first()[0] == pytest.approx(p, rel=2e-8)


def test_p_value_of_nan_and_large_pass_counts(spark):
    df = spark.createDataFrame([(float("nan"), 9, 10**9, 10**8, 3)], "rho double, m long, n long, c long, k int")
    r = df.select(t_test_pvalue(F.col("rho"), F.col("m")).alias("p"), pass_at_k_expr(F.col("n"), F.col("c"), F.col("k")).alias("v")).first()
    assert r.p is None and r.v == pytest.approx(1 - 0.9**3, rel=1e-6)
