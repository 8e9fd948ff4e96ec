"""Rank statistics between metrics.

Pairs of metrics are formed per row with an ``explode`` of the (a, b) pairs
(no self-join); pairwise-complete rows are kept, ranked inside their pair
with the distributed average-rank operator, and correlated with
``covar_pop / (stddev_pop * stddev_pop)`` (``corr`` raises on a constant column
under ANSI).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelab.functions.scale import nan_to_null
from scorelab.functions.stats import t_test_pvalue
from scorelab.operators.positions import average_ranks
from scorelab.session import materialize
from scorelab.schemas import METRICS, available


def metric_pairs(df: DataFrame, metrics, lower: bool = True, against: str | None = None,
                 places: int | None = None) -> DataFrame:
    """Long table of pairwise-complete (pos_a, metric_a, a, pos_b, metric_b, b).

    ``lower``: only pos_a >= pos_b (F5, lower triangle with diagonal); ``against``:
    pair every metric with that one column only (metric_b = against).
    """
    cols = available(df.columns, metrics)

    def val(c):
        v = nan_to_null(F.col(c)).cast("double")
        return F.round(v, places) if places is not None else v

    # one column object per metric and per literal, reused by every pair (fewer JVM calls)
    vals = {c: val(c) for c in cols + ([against] if against is not None else [])}
    pos = {i: F.lit(i) for i in range(-1, len(cols))}
    name = {c: F.lit(c) for c in vals}

    def pair(i, a, j, b):
        return F.struct(pos[i].alias("pos_a"), name[a].alias("metric_a"), vals[a].alias("a"),
                        pos[j].alias("pos_b"), name[b].alias("metric_b"), vals[b].alias("b"))

    if against is not None:
        structs = [pair(i, a, -1, against) for i, a in enumerate(cols)]
    else:
        structs = [pair(i, a, j, b) for i, a in enumerate(cols) for j, b in enumerate(cols)
                   if not (lower and j > i)]
    p = df.select(F.explode(F.array(*structs)).alias("p")).select("p.*")
    return p.where(F.col("a").isNotNull() & F.col("b").isNotNull())


def _pearson(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    rho = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return df.groupBy(*keys).agg(rho.alias("rho"), F.count(F.lit(1)).alias("n"))


def ranked_pairs(pairs: DataFrame, descending: bool = True, bounded_groups: bool = False) -> DataFrame:
    """W1 inside each (metric_a, metric_b) pair on the distinct (a, b) combinations.

    Pair rows are first reduced to distinct (pair, a, b) with a count ``_w`` (partial
    aggregation: repeated value combinations collapse map-side), then both columns
    get average ranks over the pair's rows and the ranks are joined onto that
    distinct table. ``bounded_groups``: the input holds a bounded number of rows per
    pair (per-model means), so a window per pair is used for the ranks."""
    keys = ["pos_a", "metric_a", "pos_b", "metric_b"]
    jd = (pairs.select(*keys, F.round("a", 12).alias("a"), F.round("b", 12).alias("b"))
          .groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("_w")))
    if bounded_groups:
        return _window_ranked(jd, keys, descending)
    jd = materialize(jd)  # both rank sides and the final join read it
    ra = average_ranks(jd, keys, "a", descending, None, weight="_w", checkpoint=False).select(
        *keys, "a", F.col("rank").alias("rank_a"), "_n")
    rb = average_ranks(jd, keys, "b", descending, None, weight="_w", checkpoint=False).select(
        *keys, "b", F.col("rank").alias("rank_b"))
    return jd.join(ra, keys + ["a"], "inner").join(rb, keys + ["b"], "inner")


def _window_ranked(jd: DataFrame, keys, descending: bool) -> DataFrame:
    """Average ranks of a and b by windows over each pair's rows (bounded groups only):
    rows ahead = weight of strictly better values (RANGE frame takes ties together)."""
    def ranks(col):
        o = F.col(col).desc() if descending else F.col(col).asc()
        upto = F.sum("_w").over(Window.partitionBy(*keys).orderBy(o).rangeBetween(Window.unboundedPreceding, 0))
        ties = F.sum("_w").over(Window.partitionBy(*keys, col))
        return (upto - ties + (ties + F.lit(1)) / F.lit(2.0)).cast("double")

    return jd.select("*", ranks("a").alias("rank_a"), ranks("b").alias("rank_b"),
                     F.sum("_w").over(Window.partitionBy(*keys)).alias("_n"))


def _rank_pearson(r: DataFrame, keys) -> DataFrame:
    """Count-weighted Pearson of average ranks. Average ranks of n rows have mean
    (n+1)/2 exactly, so the sums are centred with it (no cancellation)."""
    mu = (F.col("_n").cast("double") + F.lit(1.0)) / F.lit(2.0)
    da, db, w = F.col("rank_a") - mu, F.col("rank_b") - mu, F.col("_w").cast("double")
    g = r.groupBy(*keys).agg(
        F.sum(w * da * db).alias("_sxy"), F.sum(w * da * da).alias("_sxx"), F.sum(w * db * db).alias("_syy"),
        F.sum("_w").alias("n"),
        F.least(F.min("rank_a"), F.min("rank_b")).alias("rank_min"),
        F.greatest(F.max("rank_a"), F.max("rank_b")).alias("rank_max"))
    rho = F.try_divide(F.col("_sxy"), F.sqrt(F.col("_sxx") * F.col("_syy")))
    return g.select(*keys, F.when((F.col("_sxx") > 0) & (F.col("_syy") > 0), rho).alias("rho"), "n",
                    "rank_min", "rank_max")


def spearman_long(df: DataFrame, metrics=None, lower: bool = True, against: str | None = None,
                  bounded_groups: bool = False) -> DataFrame:
    """Spearman rho and two-sided p-value per metric pair, long form
    (pos_a, metric_a, pos_b, metric_b, rho, p, n). ``df`` holds one row per unit
    (e.g. per-model means or per-sample rows)."""
    metrics = METRICS if metrics is None else metrics
    keys = ["pos_a", "metric_a", "pos_b", "metric_b"]
    r = _rank_pearson(ranked_pairs(metric_pairs(df, metrics, lower, against), bounded_groups=bounded_groups), keys)
    return r.withColumn("p", t_test_pvalue(F.col("rho"), F.col("n")))


def full_matrix(long: DataFrame) -> DataFrame:
    """Mirror a lower-triangle long matrix to the full square."""
    upper = long.where(F.col("pos_a") != F.col("pos_b")).select(
        F.col("pos_b").alias("pos_a"), F.col("metric_b").alias("metric_a"),
        F.col("pos_a").alias("pos_b"), F.col("metric_a").alias("metric_b"),
        *[c for c in long.columns if c not in ("pos_a", "metric_a", "pos_b", "metric_b")],
    )
    return long.unionByName(upper)


def wide_matrix(long: DataFrame, value: str = "rho", metrics=None, places: int = 4) -> DataFrame:
    """K3: labelled square matrix (rows in metric position order), rounded."""
    metrics = METRICS if metrics is None else metrics
    present = [m for m in metrics]
    w = long.groupBy("pos_a", "metric_a").pivot("metric_b", present).agg(F.first(F.round(value, places)))
    return w.orderBy("pos_a").drop("pos_a").withColumnRenamed("metric_a", "metric")


def rank_table(means: DataFrame, metrics=None, unit: str = "model", overall: str = "overall_score") -> DataFrame:
    """W1 on per-model means (one row per model): (model, metric, overall_rank, metric_rank),
    descending average ranks."""
    metrics = METRICS if metrics is None else metrics
    cols = available(means.columns, metrics)
    long = means.select(
        unit,
        F.round(nan_to_null(F.col(overall)).cast("double"), 12).alias("_o"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"),
                                     F.round(nan_to_null(F.col(c)).cast("double"), 12).alias("_v"))
                            for c in cols])).alias("s"),
    ).select(unit, "_o", "s.*")
    ro = average_ranks(means.select(F.col(overall).alias("_o")), [], "_o", bounded_groups=True).select(
        "_o", F.col("rank").alias("overall_rank"))
    rm = average_ranks(long, ["metric"], "_v", bounded_groups=True).select("metric", "_v", F.col("rank").alias("metric_rank"))
    out = long.join(ro, "_o", "left").join(rm, ["metric", "_v"], "left")
    return out.select(unit, "metric", "overall_rank", "metric_rank")


def rank_concordance(means: DataFrame, metrics=None, overall: str = "overall_score") -> DataFrame:
    """A16 + W2: per metric, Spearman rho/p of its model ranking against the overall
    ranking and the axis extent of both rank columns (models with both values)."""
    metrics = METRICS if metrics is None else metrics
    s = spearman_long(means, metrics, against=overall, bounded_groups=True)
    return s.select(F.col("metric_a").alias("metric"), "rho", "p", "n", "rank_min", "rank_max")


def pearson_matrix(df: DataFrame, metrics=None) -> DataFrame:
    """Pearson correlation per metric pair over all rows, pairwise complete; long
    form, lower triangle. Values are first shifted by their means (a one-row aggregate,
    broadcast), so plain sums of products keep their digits; one aggregate then holds
    the sums of every pair, and its one-row result is unfolded into a row per pair."""
    metrics = METRICS if metrics is None else metrics
    cols = available(df.columns, metrics)
    if not cols:
        return _pearson(metric_pairs(df, metrics), ["pos_a", "metric_a", "pos_b", "metric_b"], "a", "b")
    names = [f"m{i}" for i in range(len(cols))]
    rows = df.select(*[nan_to_null(F.col(c)).cast("double").alias(m) for m, c in zip(names, cols)])
    means = rows.agg(*[F.avg(m).alias(f"mean_{m}") for m in names])
    rows = rows.join(F.broadcast(means)).select(*[(F.col(m) - F.col(f"mean_{m}")).alias(m) for m in names])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    sums = []
    for i, j in pairs:
        a, b = F.col(names[i]), F.col(names[j])
        of_both = {"ab": a * b, "a": a + b * 0, "b": b + a * 0, "aa": a * a + b * 0, "bb": b * b + a * 0} if i != j else {"ab": a * a, "a": a}
        sums += [F.sum(x).alias(f"{k}{i}_{j}") for k, x in of_both.items()] + [F.count(a * b).alias(f"n{i}_{j}")]

    def rho(i, j):
        n, x, ab = (F.col(f"{k}{i}_{j}") for k in ("n", "a", "ab"))
        if i == j:
            return F.try_divide(ab - x * x / n, ab - x * x / n)
        y, aa, bb = (F.col(f"{k}{i}_{j}") for k in ("b", "aa", "bb"))
        return F.try_divide(ab - x * y / n, F.sqrt(F.greatest(aa - x * x / n, F.lit(0.0))) * F.sqrt(F.greatest(bb - y * y / n, F.lit(0.0))))

    unfolded = F.array(*[F.struct(F.lit(i).alias("pos_a"), F.lit(cols[i]).alias("metric_a"), F.lit(j).alias("pos_b"), F.lit(cols[j]).alias("metric_b"),
                                  F.when(F.col(f"n{i}_{j}") > 0, rho(i, j)).alias("rho"), F.col(f"n{i}_{j}").alias("n")) for i, j in pairs])
    return rows.agg(*sums).select(F.inline(unfolded)).where("n > 0")
