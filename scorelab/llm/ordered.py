"""Totally ordered tables: rows in key order over files, and numbers that run through all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelab.llm.store import written
from scorelab.session import broadcast_if_small


def in_order(df: DataFrame, *keys: Column) -> DataFrame:
    """Rows dealt to partitions by ranges of ``keys`` and sorted inside them.

    The last key is the row's place in the input, so that rows with equal keys (one key may hold
    a third of all rows) are dealt to several partitions too. Adds the keys as ``_k0``,
    ``_k1``, ... Nulls come first."""
    names = [f"_k{i}" for i in range(len(keys) + 1)]
    keyed = df.withColumns(dict(zip(names, [*keys, F.monotonically_increasing_id()])))
    return keyed.repartitionByRange(*names).sortWithinPartitions(*names)


def running_start(parts: DataFrame, part: str, amount: str) -> DataFrame:
    """``part`` and ``start``: the sum of ``amount`` over all smaller parts. ``parts`` has one row for
    each file that a job wrote, so one window over all of them stays small."""
    before = F.sum(amount).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    return parts.select(part, F.coalesce(before, F.lit(0)).cast("bigint").alias("start"))


def numbered(df: DataFrame, name: str, *keys: Column) -> DataFrame:
    """``df`` as a written table with ``at``, the number (from 0) of each row in the order of ``keys``."""
    sort = in_order(df, *keys).drop(*[f"_k{i}" for i in range(len(keys) + 1)])
    rows = written(sort.withColumn("_m", F.monotonically_increasing_id()), name)
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.withColumns({"_part": part, "_in": inside})
    starts = running_start(rows.groupBy("_part").agg(F.count("*").alias("_rows")), "_part", "_rows")
    return rows.join(broadcast_if_small(starts), "_part").withColumn("at", F.col("start") + F.col("_in")).drop("_m", "_part", "_in", "start")
