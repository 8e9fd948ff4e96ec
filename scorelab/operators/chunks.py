"""Assemble streamed responses from chunk tables (T7, batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assemble_responses(chunks: DataFrame, key: str = "request_id", seq: str = "seq",
                       text: str = "response", done: str = "done") -> DataFrame:
    """Concatenate chunk texts in ``seq`` order up to and including the first chunk
    whose ``done`` is true; NULL texts are skipped. Several copies of a chunk count once
    (the smallest text; done if any copy says so), and chunks after the first done one
    are dropped before texts are gathered, so the buffered array holds one response.

    Output: key, response, n_chunks (chunks used), done (a done chunk was seen)."""
    each = chunks.groupBy(key, seq).agg(F.min(text).alias(text), F.coalesce(F.bool_or(F.col(done).cast("boolean")), F.lit(False)).alias(done))
    end = F.min(F.when(F.col(done), F.col(seq))).over(Window.partitionBy(key))
    each = each.withColumn("_end", end).where(F.col("_end").isNull() | (F.col(seq) <= F.col("_end")))
    g = each.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t"), F.col(done).alias("d")))).alias("_c")
    )
    first_done = F.array_position(F.transform("_c", lambda c: c["d"]), True)
    used = F.when(first_done > 0, F.slice("_c", 1, first_done)).otherwise(F.col("_c"))
    g = g.withColumn("_u", used)
    return g.select(
        key,
        F.array_join(F.transform("_u", lambda c: c["t"]), "").alias("response"),
        F.size("_u").alias("n_chunks"),
        (first_done > 0).alias("done"),
    )
