"""Structured Streaming jobs for arriving evaluation data.

R1 and R2 reuse the batch column expressions unchanged; R3 is the one custom
stateful operator (chunk reassembly tolerant to reordering and duplicates).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scorelab.operators.scoring import score_measurements
from scorelab.session import scratch_path


def score_stream(raw: DataFrame, zero_policy: str = "drop") -> DataFrame:
    """Scale and score arriving raw measurement rows (row-local, append mode)."""
    return score_measurements(raw, zero_policy)


def running_means(scored: DataFrame, by: str = "model") -> DataFrame:
    """R2: running per-model mean score and pass rate (complete/update mode)."""
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("overall_score").alias("overall_score"),
        F.avg("functional_correctness").alias("pass_rate"),
    )


STATE_SCHEMA = T.StructType([
    T.StructField("seqs", T.ArrayType(T.LongType())),
    T.StructField("texts", T.ArrayType(T.StringType())),
    T.StructField("dones", T.ArrayType(T.BooleanType())),
    T.StructField("emitted", T.BooleanType()),
    T.StructField("latest", T.LongType()),
])


def _text(t):
    return None if t is None or (isinstance(t, float) and pd.isna(t)) else t


def _assembler(key_field: str, timeout_ms: int | None, event_time: str | None, expire_ms: int):
    cols = [key_field, "response", "n_chunks", "done"]

    def fold(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, texts, dones, emitted, latest = state.get if state.exists else ([], [], [], False, 0)
        if state.hasTimedOut:
            state.remove()
            if not emitted:
                order = sorted(range(len(seqs)), key=lambda i: seqs[i])
                yield pd.DataFrame([[key[0], "".join(texts[i] for i in order if texts[i] is not None), len(seqs), False]], columns=cols)
            return
        chunks = {s: (t, d) for s, t, d in zip(seqs, texts, dones)}
        for pdf in pdfs:
            if event_time and len(pdf):
                latest = max(latest, int(pdf[event_time].max().timestamp() * 1000))
            for s, t, d in zip(pdf["seq"], pdf["response"], pdf["done"]) if not emitted else ():
                t, d = _text(t), bool(d) if d is not None and not pd.isna(d) else False
                old_t, old_d = chunks.get(int(s), (None, False))
                # of several copies the smallest text counts, whatever came first; done if any says so
                chunks[int(s)] = (min((x for x in (old_t, t) if x is not None), default=None), old_d or d)
        done_seqs = sorted(s for s, (_, d) in chunks.items() if d)
        if not emitted and done_seqs and all(s in chunks for s in range(done_seqs[0] + 1)):
            used = range(done_seqs[0] + 1)
            yield pd.DataFrame([[key[0], "".join(chunks[s][0] for s in used if chunks[s][0] is not None), len(used), True]], columns=cols)
            emitted, chunks = True, {}      # a marker stays, so replayed and late chunks start nothing
        order = sorted(chunks)
        state.update(([int(s) for s in order], [chunks[s][0] for s in order], [chunks[s][1] for s in order], emitted, latest))
        if event_time:
            state.setTimeoutTimestamp(max(latest + expire_ms, state.getCurrentWatermarkMs() + 1))
        elif timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)

    return fold


def assemble_stream(chunks: DataFrame, key: str = "request_id", timeout_ms: int | None = None,
                    event_time: str | None = None, expire_ms: int = 3_600_000) -> DataFrame:
    """Emit a response once its first done chunk and every earlier chunk (seq 0..done)
    have arrived, in any order, with duplicates, replays and late copies: once.

    State is the chunks of an unfinished response and, once it is emitted, a marker of a
    few numbers. With ``event_time`` (a timestamp column with a watermark) both go when the
    watermark is ``expire_ms`` past the key's latest chunk; an unfinished response is then
    emitted as incomplete (done = false), and chunks older than the watermark are ignored.
    ``timeout_ms`` does the same by processing time, for triggers that keep running (a run that
    ends when everything is read would wait for the time to pass). With neither, markers stay
    for as long as the query runs: replays of any age are recognised, and state grows by one
    marker for each response, so a stream that never ends wants one of the two."""
    out = T.StructType([
        T.StructField(key, chunks.schema[key].dataType),
        T.StructField("response", T.StringType()),
        T.StructField("n_chunks", T.LongType()),
        T.StructField("done", T.BooleanType()),
    ])
    kind = (GroupStateTimeout.EventTimeTimeout if event_time else
            GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
    return chunks.groupBy(key).applyInPandasWithState(
        _assembler(key, timeout_ms, event_time, expire_ms), out, STATE_SCHEMA, "append", kind)


def run_available(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> str:
    """Run a streaming DataFrame over everything available and stop; results land in a
    parquet folder under the checkpoint folder (complete mode rewrites it per batch)."""
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    w = df.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).outputMode("append").start()
    else:
        def write_batch(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        q = w.foreachBatch(write_batch).outputMode(mode).start()
    q.awaitTermination()
    return out
