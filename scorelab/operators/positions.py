"""Order statistics that stay distributed when one group holds a large share of the rows.

Exact quantiles and average ranks need, for every value, the number of rows of
its group with a smaller value. A window ``partitionBy(group).orderBy(value)``
would put a whole group into one task. Instead:

1. pre-aggregate to distinct ``(group, value, count)`` (partial aggregation, so a
   repeated value such as a score of 0 becomes one row per map task);
2. cut every group into ``buckets`` value ranges at split points taken from a
   hash-selected sample of its distinct values (bounded size, and a pure function of
   the data, unlike an order-sensitive sketch);
3. running sums inside ``(group, bucket)`` ranges (a window over ~1/buckets of
   the group's distinct values) plus bucket offsets from a table of at most
   groups x buckets rows.

Split points and bucket ids are pure functions of the data, so a lost task or a
recomputed branch gets the same answer; correctness needs no checkpoint or row ids.
The distinct-value table is checkpointed only so that its several branches (split
points, range windows, range totals) do not each recompute the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelab.functions.scale import nan_to_null
from scorelab.session import broadcast_if_small, materialize

DEFAULT_BUCKETS = 256
SAMPLE_PER_BUCKET = 16
#: Up to so many (group, range) offsets (about 50 bytes each: 10 MB) are broadcast.
BROADCAST_OFFSETS = 200_000


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def value_counts(df: DataFrame, keys, value: str, weight: str | None = None) -> DataFrame:
    """Distinct (keys, value) with their multiplicity ``_cnt`` (sum of ``weight`` when the
    input is already pre-aggregated); NULL/NaN values dropped."""
    ks = _keys(keys)
    v = nan_to_null(F.col(value)).cast("double")
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    # missing values are left out by their count: a filter on the value would be pushed below
    # the projections and evaluate a computed value a second time for each row
    rows = df.select(*ks, v.alias(value), w.alias("_w"))
    counts = rows.groupBy(*ks, value).agg(F.sum(F.when(F.col(value).isNotNull(), F.col("_w"))).alias("_cnt"))
    return counts.where(F.col("_cnt").isNotNull())


def split_points(counts: DataFrame, keys, value: str, buckets: int = DEFAULT_BUCKETS,
                 per_bucket: int = SAMPLE_PER_BUCKET) -> DataFrame:
    """Per group: ``_n`` (rows), ``_d`` (distinct values) and ``_splits``, ``buckets - 1``
    ascending split points taken from a sample of the distinct values.

    The sample keeps a value when a hash of the value falls below
    ``per_bucket * buckets / _d``, so it is a deterministic, order-independent
    function of the data (a retried task or a recomputed branch gets the same
    splits) and holds about ``per_bucket * buckets`` values per group."""
    ks = _keys(keys)
    stats = broadcast_if_small(counts.groupBy(*ks).agg(F.sum("_cnt").alias("_n"), F.count(F.lit(1)).alias("_d")))
    if buckets <= 1:
        return stats.withColumn("_splits", F.lit(None).cast("array<double>"))
    j = counts.join(stats, ks, "inner") if ks else counts.crossJoin(F.broadcast(stats))
    u = F.xxhash64(F.col(value)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)).cast("double") / F.lit(float(2 ** 63))
    keep = u < F.lit(float(per_bucket * buckets)) / F.col("_d").cast("double")
    samp = j.where(keep).groupBy(*ks).agg(F.array_sort(F.collect_list(value)).alias("_s"))
    picks = F.transform(
        F.sequence(F.lit(1), F.lit(buckets - 1)),
        lambda i: F.element_at("_s", F.ceil(i * F.size("_s") / F.lit(buckets)).cast("int")),
    )
    samp = samp.select(*ks, F.when(F.size("_s") > 0, picks).alias("_splits"))
    return stats.join(samp, ks, "left") if ks else stats.crossJoin(samp)


BLOCK = 16


def _bucket_of(splits, v, buckets: int):
    """Number of split points below ``v`` (the value's range id), by a two-level search
    over the sorted splits: count the 16-wide blocks whose last split is below ``v``,
    then count inside the next block (about 31 comparisons instead of buckets - 1)."""
    n_blocks = (buckets - 1) // BLOCK
    if n_blocks < 2:
        return F.coalesce(F.greatest(F.size(F.filter(splits, lambda s: s < v)), F.lit(0)), F.lit(0))
    block_last = F.transform(F.sequence(F.lit(1), F.lit(n_blocks)), lambda k: F.element_at(splits, k * BLOCK))
    full = F.size(F.filter(block_last, lambda s: s < v))
    inside = F.size(F.filter(F.slice(splits, full * BLOCK + 1, BLOCK), lambda s: s < v))
    # never null, so that a later join on the range does not evaluate it once more as a filter
    return F.coalesce(full * BLOCK + inside, F.lit(0))


def cumulative_counts(counts: DataFrame, keys, value: str, buckets: int = DEFAULT_BUCKETS,
                      checkpoint: bool = True) -> DataFrame:
    """Add ``_before`` (rows of the group with a smaller value) and ``_n`` (group size)
    to a ``value_counts`` table. ``checkpoint=False`` when the caller already cut the
    lineage of ``counts`` (or of its input)."""
    ks = _keys(keys)
    if checkpoint:
        counts = materialize(counts)  # read by the split, bucket-total and window branches
    # one row per group, computed once: with few groups the values of a hot one are not shuffled to join it
    per_group = broadcast_if_small(split_points(counts, ks, value, buckets).drop("_d"))
    c = counts.join(per_group, ks, "inner") if ks else counts.crossJoin(F.broadcast(per_group))
    c = c.withColumn("_b", _bucket_of(F.col("_splits"), F.col(value), buckets)).drop("_splits")
    w_in = Window.partitionBy(*ks, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_in", F.coalesce(F.sum("_cnt").over(w_in), F.lit(0)))
    tot = c.groupBy(*ks, "_b").agg(F.sum("_cnt").alias("_bt"))
    w_off = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_off", F.coalesce(F.sum("_bt").over(w_off), F.lit(0))).drop("_bt")
    c = c.join(broadcast_if_small(tot, BROADCAST_OFFSETS), ks + ["_b"], "inner")
    return c.withColumn("_before", (F.col("_off") + F.col("_in")).cast("bigint")).drop("_off", "_in", "_b")


def window_ranks(df: DataFrame, keys, value: str, descending: bool = True, places: int | None = 12,
                 weight: str | None = None) -> DataFrame:
    """Average ranks with one window per group. Only for inputs whose groups are bounded
    by construction (e.g. one row per model after ``groupBy(model)``): each group is
    sorted inside one task."""
    ks = _keys(keys)
    v = nan_to_null(F.col(value)).cast("double")
    if places is not None:
        v = F.round(v, places)
    src = df.select(*ks, v.alias(value), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"))
    c = src.where(F.col(value).isNotNull()).groupBy(*ks, value).agg(F.sum("_w").alias("_cnt"))
    o = F.col(value).desc() if descending else F.col(value).asc()
    w = Window.partitionBy(*ks).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_ahead", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    c = c.withColumn("_n", F.sum("_cnt").over(Window.partitionBy(*ks)))
    return c.withColumn("rank", (F.col("_ahead") + (F.col("_cnt") + F.lit(1)) / F.lit(2.0)).cast("double")).drop("_ahead")


def average_ranks(df: DataFrame, keys, value: str, descending: bool = True, places: int | None = 12,
                  buckets: int = DEFAULT_BUCKETS, bounded_groups: bool = False,
                  weight: str | None = None, checkpoint: bool = True) -> DataFrame:
    """Average rank (ties share the mean of their positions, 1-based) of every distinct
    value within its group: columns keys..., value, rank, _cnt, _n.

    Values are rounded to ``places`` first so float noise does not break ties;
    NULL/NaN get no rank.
    """
    if bounded_groups:
        return window_ranks(df, keys, value, descending, places, weight)
    ks = _keys(keys)
    src = df
    if places is not None:
        src = df.withColumn(value, F.round(nan_to_null(F.col(value)).cast("double"), places))
    c = cumulative_counts(value_counts(src, ks, value, weight), ks, value, buckets, checkpoint)
    asc = F.col("_before") + (F.col("_cnt") + F.lit(1)) / F.lit(2.0)
    desc = F.col("_n") - F.col("_before") - (F.col("_cnt") - F.lit(1)) / F.lit(2.0)
    return c.withColumn("rank", (desc if descending else asc).cast("double"))


def quantiles_from(c: DataFrame, keys, value: str, qs=(0.25, 0.5, 0.75), names=None) -> DataFrame:
    """Exact quantiles from a ``cumulative_counts`` table (linear interpolation between
    closest ranks, numpy's default and DuckDB ``quantile_cont``): one row per group."""
    ks = _keys(keys)
    names = names or [f"q{int(round(q * 100)):02d}" for q in qs]
    h = {nm: (F.col("_n") - F.lit(1)).cast("double") * F.lit(float(q)) for nm, q in zip(names, qs)}
    lo = {nm: F.floor(h[nm]) for nm in names}
    hi = {nm: F.least(lo[nm] + F.lit(1), F.col("_n") - F.lit(1)) for nm in names}
    end = F.col("_before") + F.col("_cnt")  # positions [_before, end) hold this value
    aggs = [F.first("_n").alias("_n")]
    for nm in names:
        aggs.append(F.min(F.when(end > lo[nm], F.col(value))).alias(f"{nm}__lo"))
        aggs.append(F.min(F.when(end > hi[nm], F.col(value))).alias(f"{nm}__hi"))
        aggs.append(F.first(h[nm] - lo[nm]).alias(f"{nm}__f"))
    g = c.groupBy(*ks).agg(*aggs)
    out = [F.col(k) for k in ks]
    for nm in names:
        a, b, f = F.col(f"{nm}__lo"), F.col(f"{nm}__hi"), F.col(f"{nm}__f")
        out.append((a + (b - a) * f).alias(nm))
    return g.select(*out, F.col("_n").alias("n"))


def quantiles(df: DataFrame, keys, value: str, qs=(0.25, 0.5, 0.75), names=None,
              buckets: int = DEFAULT_BUCKETS, method: str = "exact", accuracy: int = 10000) -> DataFrame:
    """Quantiles per group straight from a row table.

    method="exact" (default): see ``quantiles_from``.
    method="approx": one ``percentile_approx`` aggregate (a mergeable sketch with rank
    error about n/accuracy, nearest-rank rather than interpolated); a single pass with no
    ranges or windows, for very large groups where exactness is not needed."""
    ks = _keys(keys)
    names = names or [f"q{int(round(q * 100)):02d}" for q in qs]
    if method == "approx":
        v = nan_to_null(F.col(value)).cast("double")
        g = df.select(*ks, v.alias(value)).where(F.col(value).isNotNull()).groupBy(*ks).agg(
            F.percentile_approx(value, F.lit([float(q) for q in qs]), accuracy).alias("_q"),
            F.count(F.lit(1)).alias("n"))
        return g.select(*ks, *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)], "n")
    if method != "exact":
        raise ValueError(f"unknown method {method!r}")
    c = cumulative_counts(value_counts(df, ks, value), ks, value, buckets)
    return quantiles_from(c, ks, value, qs, names)
