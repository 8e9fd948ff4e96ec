"""A keyed sink for update-mode streams (R2): each micro-batch holds the keys that changed.

A batch is a folder of its own, named by the batch's number, and is complete once a log names it. A
complete batch is ignored when it is replayed; a half-written one is written anew. The newest batch counts for
each key, so readers see one row a key. ``compact`` folds the batches into a base table, which
keeps reads and state of the sink proportional to the number of keys.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "_batch"


class KeyedSink:
    """Rows by ``keys`` under ``path``; ``schema`` is that of the batches."""

    def __init__(self, spark: SparkSession, path: str, keys, schema):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), list(keys), schema

    def _done(self, kind: str) -> list[int]:
        """Numbers of the batches (or bases) that are complete: those in the log."""
        try:
            log = self.spark.read.schema("kind string, number bigint").parquet(f"{self.path}/log")
            return sorted({r["number"] for r in log.where(F.col("kind") == kind).collect()})
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _put(self, rows: DataFrame, kind: str, number: int) -> None:
        """Write a folder anew, then say in the log that it is complete."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}={number}")
        self.spark.range(1).select(F.lit(kind).alias("kind"), F.lit(number).cast("bigint").alias("number")).write.mode("append").parquet(f"{self.path}/log")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: write a batch, or nothing if it was written before."""
        if batch_id in self._done("batch") or any(batch_id <= b for b in self._done("base")):
            return
        self._put(batch.select(*self.schema.fieldNames()), "batch", batch_id)

    def _versions(self) -> DataFrame:
        base = self._done("base")[-1:]
        batches = [b for b in self._done("batch") if not base or b > base[0]]
        out = self.spark.createDataFrame([], self.schema).withColumn(BATCH, F.lit(0).cast("bigint"))
        read = self.spark.read.schema(self.schema)
        for b in base:
            out = out.union(read.parquet(f"{self.path}/base={b}").withColumn(BATCH, F.lit(-1).cast("bigint")))
        if batches:
            number = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("bigint")
            out = out.union(read.parquet(*[f"{self.path}/batch={b}" for b in batches]).withColumn(BATCH, number))
        return out

    def read(self) -> DataFrame:
        """One row for each key: that of its newest batch."""
        rest = [f.name for f in self.schema.fields if f.name not in self.keys]
        newest = self._versions().groupBy(*self.keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_row"))
        return newest.select(*[F.col(k) if k in self.keys else F.col("_row")[k].alias(k) for k in self.schema.fieldNames()])

    def compact(self) -> None:
        """Write the rows of all complete batches as one base; later reads begin with it."""
        batches = self._done("batch")
        if batches and batches[-1] not in self._done("base"):
            self._put(self.read(), "base", batches[-1])


def run_updates(df: DataFrame, sink: KeyedSink, checkpoint: str) -> None:
    """Run an update-mode stream over everything available into ``sink``."""
    df.writeStream.option("checkpointLocation", checkpoint).outputMode("update").foreachBatch(sink.write).trigger(availableNow=True).start().awaitTermination()
