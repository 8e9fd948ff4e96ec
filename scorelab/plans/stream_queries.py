"""Registered streaming queries: each runs a Structured Streaming job over a driver
table as a file source (trigger availableNow) and returns the sink's contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelab.plans import relations as R
from scorelab.plans.catalog import register, rounded
from scorelab.session import scratch_path
from scorelab.streaming import sink as K
from scorelab.streaming import stream as S


def _stream_table(spark, sf_dir, name, max_files: int = 1):
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema  # footer only
    # a file source lists a folder or a glob; the one-name glob selects just this table
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(
        f"{sf_dir}/{{{name}}}.parquet")


def _raw_from(li):
    return li.select(
        F.col("l_linenumber").cast("string").alias("model"),
        F.col("l_orderkey").cast("string").alias("task_id"),
        (F.col("l_returnflag") != F.lit("R")).alias("passed"),
        (F.col("l_quantity") / F.lit(5)).alias("raw_cc_avg"),
        (F.col("l_quantity") / F.lit(4)).alias("raw_cc_max"),
        (F.nullif(F.col("l_tax"), F.lit(0.0)) * F.lit(100)).alias("raw_style"),
        (F.col("l_discount") * F.lit(10)).alias("raw_seconds"),
        F.col("l_quantity").alias("loc"),
    )


@register("stream_scores", f"SELECT model, task_id, round(overall_score, 6) AS overall_score FROM ({R.ORACLE_L})")
def stream_scores(spark, sf_dir):
    """Arriving measurement rows scored in append mode."""
    scored = S.score_stream(_raw_from(_stream_table(spark, sf_dir, "lineitem")))
    out = S.run_available(spark, scored.select("model", "task_id", "overall_score"), "stream_scores")
    return rounded(spark.read.parquet(out))


@register("stream_means", f"""SELECT model, count(*) AS n, round(avg(overall_score), 6) AS overall_score,
       round(avg(functional_correctness), 6) AS pass_rate FROM ({R.ORACLE_L}) GROUP BY model""")
def stream_means(spark, sf_dir):
    """R2: running per-model means in complete mode."""
    scored = S.score_stream(_raw_from(_stream_table(spark, sf_dir, "lineitem")))
    out = S.run_available(spark, S.running_means(scored), "stream_means", mode="complete")
    return rounded(spark.read.parquet(out))


@register("stream_means_updated", f"""SELECT model, count(*) AS n, round(avg(overall_score), 6) AS overall_score,
       round(avg(functional_correctness), 6) AS pass_rate FROM ({R.ORACLE_L}) GROUP BY model""")
def stream_means_updated(spark, sf_dir):
    """R2 in update mode: the table arrives in several files, a quarter of them at a time, each micro-batch writes the models that changed
    to a keyed sink; the first half is folded into a base, and the last batches are delivered again."""
    src, out = scratch_path(spark, "measurement-files"), scratch_path(spark, "updated-means")
    raw = R.raw_measurements(spark, sf_dir)
    files = -(-raw.rdd.getNumPartitions() // 2)     # of one arrival: with the input's splits, so that a file's rows are bounded
    raw.repartition(4 * files, "task_id").write.parquet(src)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", files).parquet(src)
    means = S.running_means(S.score_stream(stream))
    sink = K.KeyedSink(spark, out, ["model"], means.schema)
    seen = []

    def deliver(batch, batch_id):
        sink.write(batch, batch_id)
        seen.append(batch_id)
        if batch_id == 1:
            sink.compact()
        for earlier in seen[-2:]:      # a source that delivers at least once: other rows under a number that is written
            sink.write(batch.limit(1), earlier)

    means.writeStream.option("checkpointLocation", scratch_path(spark, "updated-ckpt")).outputMode("update").foreachBatch(deliver).trigger(
        availableNow=True).start().awaitTermination()
    return rounded(sink.read())


_CHUNKS_SQL = f"""
WITH c AS ({R.ORACLE_C}),
fd AS (SELECT request_id, min(seq) FILTER (WHERE done) AS first_done FROM c GROUP BY request_id)
SELECT c.request_id, string_agg(c.response, '' ORDER BY c.seq) AS response, count(*) AS n_chunks, true AS done
FROM c JOIN fd USING (request_id)
WHERE fd.first_done IS NOT NULL AND c.seq <= fd.first_done
GROUP BY c.request_id
HAVING count(DISTINCT c.seq) = max(fd.first_done) + 1 AND min(c.seq) = 0"""


@register("stream_chunks", _CHUNKS_SQL)
def stream_chunks(spark, sf_dir):
    """Responses reassembled from arriving chunks by a stateful operator."""
    cv = _stream_table(spark, sf_dir, "conversations")
    chunks = cv.select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.col("text").alias("response"),
        ((F.col("role") == F.lit("assistant")) & (F.col("turn") >= F.lit(3))).alias("done"),
    )
    out = S.run_available(spark, S.assemble_stream(chunks), "stream_chunks")
    return spark.read.parquet(out)


@register("stream_chunks_replayed", _CHUNKS_SQL)
def stream_chunks_replayed(spark, sf_dir):
    """R3 with chunks out of order, twice, and replayed after their response was emitted."""
    src = scratch_path(spark, "chunk-files")
    chunks = R.chunks(spark, sf_dir)
    half = F.pmod(F.xxhash64("request_id", "seq"), F.lit(2))
    chunks.where(half == 1).write.json(src)
    chunks.where(half == 0).unionByName(chunks.where(half == 1)).write.mode("append").json(src)
    chunks.write.mode("append").json(src)
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 8).json(src)
    return spark.read.parquet(S.run_available(spark, S.assemble_stream(stream), "stream_chunks_replayed"))


# Chunk (conv, turn): lost if conv % 5 = 1 and turn = 1; late (it comes after its response has expired) if conv % 5 = 2 and turn = 2.
_LOST, _LATE = "(request_id % 5 = 1 AND seq = 1)", "(request_id % 5 = 2 AND seq = 2)"


@register("stream_chunks_expired", f"""
WITH c AS (SELECT * FROM ({R.ORACLE_C}) WHERE NOT {_LOST} AND NOT {_LATE}),
s AS (SELECT request_id, min(seq) FILTER (WHERE done) AS last, count(*) AS n,
             string_agg(coalesce(response, ''), '' ORDER BY seq) AS whole FROM c GROUP BY request_id),
u AS (SELECT c.request_id, count(DISTINCT seq) AS k, string_agg(coalesce(response, ''), '' ORDER BY seq) AS response
      FROM c JOIN s USING (request_id) WHERE seq <= s.last GROUP BY c.request_id)
SELECT s.request_id, CASE WHEN coalesce(u.k = s.last + 1, false) THEN u.response ELSE s.whole END AS response,
       CASE WHEN coalesce(u.k = s.last + 1, false) THEN u.k ELSE s.n END AS n_chunks, coalesce(u.k = s.last + 1, false) AS done
FROM s LEFT JOIN u USING (request_id)""")
def stream_chunks_expired(spark, sf_dir):
    """R3 by event time over several files: chunks out of order, some lost, some after their response has
    expired, all replayed at the end. Complete responses come once; the others as incomplete at expiry."""
    src = scratch_path(spark, "timed-chunks")
    chunks = R.chunks(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    lost, late = F.expr(_LOST), F.expr(_LATE)
    here = chunks.where(~lost & ~late)
    later = lambda hours: spark.range(1).select(F.lit(-1).cast("bigint").alias("request_id"), F.lit(0).cast("bigint").alias("seq"),
                                                F.lit(None).cast("string").alias("response"), F.lit(False).alias("done"),
                                                F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hours)).alias("at"))
    half = F.pmod(F.xxhash64("request_id", "seq"), F.lit(2))
    # one file for each arrival: two halves in any order; time passes; late chunks and replays; time passes
    for rows in (here.where(half == 1), here.where(half == 0), later(2), later(4), chunks.where(late).unionByName(here), later(6), later(8)):
        rows.coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).json(src).withWatermark("at", "10 minutes")
    out = S.run_available(spark, S.assemble_stream(stream, event_time="at"), "stream_chunks_expired")
    return spark.read.parquet(out).where("request_id >= 0")
