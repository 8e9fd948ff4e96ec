"""R1-R3 with file sources and trigger(availableNow): stream results equal the batch ones."""

import json
import os


from conftest import SF001, local_scratch
from scorelab.operators.chunks import assemble_responses
from scorelab.plans import relations as R
from scorelab.schemas import CHUNK_SCHEMA
from scorelab.streaming import stream as S


def test_scores_and_means_equal_batch(spark):
    src = local_scratch(spark, "raw-src")
    raw = R.raw_measurements(spark, SF001)
    raw.repartition(3).write.parquet(src)  # several files arrive as several batches
    stream_raw = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = S.run_available(spark, S.score_stream(stream_raw).select("model", "task_id", "overall_score"), "t-r1")
    batch = R.score_measurements(raw).select("model", "task_id", "overall_score")
    assert sorted(spark.read.parquet(out).collect()) == sorted(batch.collect())
    stream_raw2 = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out2 = S.run_available(spark, S.running_means(S.score_stream(stream_raw2)), "t-r2", mode="complete")
    want = {r["model"]: r for r in S.running_means(R.score_measurements(raw)).collect()}
    for r in spark.read.parquet(out2).collect():
        assert r["n"] == want[r["model"]]["n"]
        assert abs(r["overall_score"] - want[r["model"]]["overall_score"]) < 1e-12


def test_chunks_out_of_order_and_duplicated(spark):
    src = local_scratch(spark, "chunks-src")
    os.makedirs(src)
    chunks = [("a", 2, "c", True), ("a", 0, "a", False), ("b", 0, "x", False), ("a", 1, "b", False),
              ("a", 1, "b", False), ("b", 1, None, False), ("c", 0, "p", False), ("a", 3, "zz", False),
              ("b", 2, "y", True), ("d", 1, "late", True)]
    files = [chunks[0:3], chunks[3:7], chunks[7:]]
    for i, part in enumerate(files):
        with open(os.path.join(src, f"part-{i}.json"), "w") as f:
            for k, s, t, d in part:
                f.write(json.dumps({"request_id": k, "seq": s, "response": t, "done": d}) + "\n")
    stream = spark.readStream.schema(CHUNK_SCHEMA).option("maxFilesPerTrigger", 1).json(src)
    out = S.run_available(spark, S.assemble_stream(stream), "t-r3")
    got = {r["request_id"]: (r["response"], r["n_chunks"], r["done"]) for r in spark.read.parquet(out).collect()}
    # a: 0..2 complete (done at 2), b: 0..2 with a NULL text, c: no done, d: gap before done
    assert got == {"a": ("abc", 3, True), "b": ("xy", 3, True)}
    batch = {r["request_id"]: r["response"] for r in assemble_responses(spark.read.schema(CHUNK_SCHEMA).json(src)).collect()}
    assert batch["a"] == "abc" and batch["b"] == "xy"


def test_replays_and_late_chunks_are_emitted_once(spark):
    src = local_scratch(spark, "chunks-replay")
    os.makedirs(src)
    one = [("a", 0, "x", False), ("a", 1, "z", True)]
    for i, part in enumerate([one, one, [("a", 1, "late", True)], [("b", 0, "q", True)] + one]):
        with open(os.path.join(src, f"part-{i}.json"), "w") as f:
            for k, s, t, d in part:
                f.write(json.dumps({"request_id": k, "seq": s, "response": t, "done": d}) + "\n")
        os.utime(f.name, (1_700_000_000 + 60 * i,) * 2)
    stream = spark.readStream.schema(CHUNK_SCHEMA).option("maxFilesPerTrigger", 1).json(src)
    out = spark.read.parquet(S.run_available(spark, S.assemble_stream(stream), "t-replay")).collect()
    assert sorted((r.request_id, r.response, r.n_chunks, r.done) for r in out) == [("a", "xz", 2, True), ("b", "q", 1, True)]
    # copies that differ: the smallest text, in batch too
    batch = assemble_responses(spark.read.schema(CHUNK_SCHEMA).json(src)).where("request_id = 'a'").first()
    assert (batch.response, batch.n_chunks, batch.done) == ("xlate", 2, True)


def test_event_time_ends_state(spark):
    from pyspark.sql import functions as F

    src = local_scratch(spark, "chunks-event-time")
    os.makedirs(src)
    for i, part in enumerate([[("a", 0, "x", False, 10)], [("b", 0, "y", True, 5000)], [("c", 0, "z", True, 9000)]]):
        with open(os.path.join(src, f"part-{i}.json"), "w") as f:
            for k, s, t, d, sec in part:
                f.write(json.dumps({"request_id": k, "seq": s, "response": t, "done": d, "sec": sec}) + "\n")
        os.utime(f.name, (1_700_000_000 + 60 * i,) * 2)     # files arrive in order of their times
    stream = spark.readStream.schema("request_id string, seq long, response string, done boolean, sec long").option("maxFilesPerTrigger", 1).json(src)
    stream = stream.withColumn("at", F.timestamp_seconds("sec")).withWatermark("at", "1 second")
    out = spark.read.parquet(S.run_available(spark, S.assemble_stream(stream, event_time="at", expire_ms=60_000), "t-event")).collect()
    assert sorted((r.request_id, r.response, r.done) for r in out) == [("a", "x", False), ("b", "y", True), ("c", "z", True)]


def test_chunks_timeout_emits_incomplete(spark):
    import time

    src = local_scratch(spark, "chunks-timeout")
    os.makedirs(src)
    with open(os.path.join(src, "part-0.json"), "w") as f:
        for s, t in [(1, "b"), (0, "a")]:
            f.write(json.dumps({"request_id": "z", "seq": s, "response": t, "done": False}) + "\n")
    stream = spark.readStream.schema(CHUNK_SCHEMA).json(src)
    q = (S.assemble_stream(stream, timeout_ms=300).writeStream.format("memory").queryName("r3_timeout")
         .outputMode("append").trigger(processingTime="300 milliseconds").start())
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("r3_timeout").count() == 0:
            time.sleep(0.5)
    finally:
        q.stop()
    got = [(r["request_id"], r["response"], r["n_chunks"], r["done"]) for r in spark.table("r3_timeout").collect()]
    assert got == [("z", "ab", 2, False)]
