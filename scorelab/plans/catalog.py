"""Registered queries: each maps a driver table onto the evaluation data model
(see ``relations``) and runs one or more operators over the whole table.

Every entry has a Spark builder ``(spark, sf_dir) -> DataFrame`` and, where the
semantics are SQL-expressible, an equivalent DuckDB SQL string over the same
parquet tables. Floating outputs are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def round_like_sql(c, places: int = 6):
    """round(x * 10^p) / 10^p with halves away from zero: the form SQL engines use for
    doubles, so a tie such as 0.6625625 lands on the same side in both engines."""
    scale = float(10 ** places)
    return F.round(c.cast("double") * F.lit(scale)) / F.lit(scale)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every floating column (presentation rounding, both engines)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(round_like_sql(F.col(f.name), places).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
