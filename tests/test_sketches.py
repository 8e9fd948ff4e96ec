"""Stored sketches: merged over parts they answer like one pass over all rows, within their bounds."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import local_scratch
from scorelab.operators import sketches
from scorelab.operators.agg import distinct_rounded
from scorelab.operators.dist import box_stats


def frame(spark, n=20000, seed=3):
    rnd = random.Random(seed)
    rows = [(rnd.choice("aab"), i % 5, rnd.gauss(0, 1), rnd.randint(0, 12) / 7, None) for i in range(n)]
    rows += [("a", 1, float("nan"), None, None), ("z", 1, None, -0.0, None), ("z", 2, None, 0.0, None), (None, 3, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "model string, day int, wide double, narrow double, nothing double")


METRICS = ["wide", "narrow", "nothing"]


def test_distinct_counts_keep_their_bound_and_flags(spark):
    df = frame(spark)
    exact = {(r.model, r.metric): r for r in distinct_rounded(df, METRICS).collect()}
    got = {(r.model, r.metric): r for r in sketches.merged_distinct(sketches.distinct_sketches(df, METRICS, part="day")).collect()}
    assert set(got) == set(exact)
    for key, r in got.items():
        assert abs(r.n_distinct - exact[key].n_distinct) <= max(0.5, sketches.distinct_error() * exact[key].n_distinct)
        assert r.needs_jitter == exact[key].needs_jitter
    assert got["z", "narrow"].n_distinct == 1     # -0.0 and 0.0


def test_merged_days_equal_one_pass_and_a_day_stored_again_counts_once(spark):
    df, path = frame(spark), local_scratch(spark, "sketches")
    for days in ([0, 1, 2], [2, 3], [4]):
        sketches.store(sketches.distinct_sketches(df.where(F.col("day").isin(days)), METRICS, part="day"), path, "day")
    merged = {(r.model, r.metric): r.n_distinct for r in sketches.merged_distinct(sketches.load(spark, path)).collect()}
    once = {(r.model, r.metric): r.n_distinct for r in sketches.merged_distinct(sketches.distinct_sketches(df, METRICS)).collect()}
    assert set(merged) == set(once)
    assert all(abs(merged[k] - once[k]) <= sketches.distinct_error() * once[k] for k in once)
    assert sketches.load(spark, path).groupBy("model", "metric", "day").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("k", [50, 400])
def test_quantile_ranks_keep_their_bound(spark, k):
    df, path = frame(spark), local_scratch(spark, "quantiles")
    sketches.store(sketches.quantile_sketches(df, "model", "wide", part="day", k=k), path, "day")
    merged = sketches.merged_quantiles(sketches.load(spark, path), "model")
    names = {"q1": 0.25, "median": 0.5, "q3": 0.75, "top": 0.99}
    q = sketches.quantiles(merged, "model", names.values(), list(names))
    n = {r["model"]: r["n"] for r in df.where("wide is not null and not isnan(wide)").groupBy("model").agg(F.count("*").alias("n")).collect()}
    assert {r["model"]: r["n"] for r in q.collect()} == n      # groups without values have no row
    check = sketches.rank_check(df, q, "model", "wide", names, 2 * sketches.rank_error(k)).collect()
    assert check and all(r["within"] for r in check if r["model"] is not None)


def test_box_from_sketches_is_near_the_exact_box(spark):
    df = frame(spark).where("model in ('a', 'b')")
    exact = {r["model"]: r for r in box_stats(df, "model", "wide").collect()}
    for r in sketches.box(sketches.merged_quantiles(sketches.quantile_sketches(df, "model", "wide", part="day"), "model"), "model").collect():
        e = exact[r["model"]]
        assert r["n"] == e["n"]
        assert all(abs(r[c] - e[c]) < 0.15 for c in ("q1", "median", "q3")) and abs(r["whislo"] - e["whislo"]) < 0.3 and abs(r["whishi"] - e["whishi"]) < 0.3
        assert abs(r["n_outliers"] - e["n_outliers"]) <= 4 * sketches.rank_error() * e["n"]


def test_empty(spark):
    df = frame(spark).limit(0)
    assert sketches.merged_distinct(sketches.distinct_sketches(df, METRICS)).count() == 0
    assert sketches.merged_quantiles(sketches.quantile_sketches(df, "model", "wide"), "model").count() == 0
