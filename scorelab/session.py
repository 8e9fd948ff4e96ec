"""Session helpers: a local session for tests/bench and the checkpoint folder.

On a cluster the session is provided by the caller and ``spark.checkpoint.dir``
names a shared, reliable folder. Only a local master without that setting gets
a fresh scratch folder (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Tuned for local[N] tests; a cluster session keeps its own settings.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    # remove checkpoint files once the checkpointed DataFrame is garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "scorelab") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only for a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="scorelab-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder (stream checkpoints, sinks)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


@contextmanager
def open_writers(spark: SparkSession, writers: int = 16):
    """Writes by ``partitionBy`` in this block keep up to ``writers`` files open in a task instead of sorting all of its rows
    by folder; rows of further folders are sorted, as without it."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, writers)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df):
    """Cut lineage with a reliable checkpoint in the session's checkpoint folder.

    Used where a small intermediate (e.g. distinct values with counts) feeds several
    branches of one plan: the branches differ (join-key filters are inferred on some),
    so they cannot share an exchange and would each recompute the expensive input."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Up to so many rows, a table of one row per group is broadcast (2 kB a row at most: 4 MB).
BROADCAST_ROWS = 2000


def broadcast_if_small(df, rows: int = BROADCAST_ROWS):
    """Cut the lineage of a small table and broadcast it if it has at most ``rows`` rows; a
    larger one is returned for a plain join. The rows are counted, not estimated."""
    from pyspark.sql import functions as F

    df = materialize(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
