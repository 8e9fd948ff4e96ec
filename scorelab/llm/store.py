"""Intermediate tables in the shared folder that the session names for checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scorelab.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Cuts the lineage and lets several branches read one computed result; a lost executor
    costs only the task it ran. The folder's owner clears it, as with checkpoints."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
