"""The keyed sink: replays change nothing, half-written batches are written anew, compaction keeps the rows."""

from conftest import local_scratch
from scorelab.streaming.sink import KeyedSink
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("model", T.StringType()), T.StructField("n", T.LongType()), T.StructField("score", T.DoubleType())])


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def state(sink):
    return sorted(map(tuple, sink.read().collect()), key=str)


def test_newest_batch_wins_and_replays_are_ignored(spark):
    sink = KeyedSink(spark, local_scratch(spark, "sink"), ["model"], SCHEMA)
    assert state(sink) == []
    sink.write(rows(spark, ("a", 1, 0.5), ("b", 1, 0.1), (None, 1, 0.0)), 0)
    sink.write(rows(spark, ("a", 2, None)), 1)
    want = sorted([("a", 2, None), ("b", 1, 0.1), (None, 1, 0.0)], key=str)
    assert state(sink) == want
    sink.write(rows(spark, ("a", 99, 9.0), ("c", 9, 9.0)), 0)      # delivered again, with other rows
    assert state(sink) == want
    sink.compact()
    assert state(sink) == want
    sink.write(rows(spark, ("a", 98, 9.0)), 1)                     # a replay of a folded batch
    sink.write(rows(spark, ("b", 3, 0.3)), 2)
    assert state(sink) == sorted([("a", 2, None), ("b", 3, 0.3), (None, 1, 0.0)], key=str)
    sink.compact()
    sink.compact()
    assert state(sink) == sorted([("a", 2, None), ("b", 3, 0.3), (None, 1, 0.0)], key=str)


def test_half_written_batch_is_not_read_and_written_anew(spark):
    path = local_scratch(spark, "sink")
    sink = KeyedSink(spark, path, ["model"], SCHEMA)
    sink.write(rows(spark, ("a", 1, 0.5)), 0)
    rows(spark, ("a", 7, 0.7)).write.parquet(f"{path}/batch=1")    # the writer was lost before the log was written
    assert state(sink) == [("a", 1, 0.5)]
    sink.write(rows(spark, ("a", 2, 0.2)), 1)
    assert state(sink) == [("a", 2, 0.2)]
