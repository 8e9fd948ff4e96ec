"""Sources and sinks whose memory must not grow with a file, a model or the number of tasks."""

import hashlib
import os
import tracemalloc
from contextlib import contextmanager

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from conftest import local_scratch
from scorelab.session import open_writers
from scorelab.sources import io, quarantine


@contextmanager
def conf(spark, key, value):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def put(base, name, data):
    os.makedirs(os.path.dirname(os.path.join(base, name)), exist_ok=True)
    with open(os.path.join(base, name), "wb") as f:
        f.write(data)


def test_raw_answers_stream_in_pieces(spark):
    """answers of many splits and several files are digested as they are on disk."""
    base = local_scratch(spark, "answers")
    lines = b"".join(b"line %d\r\n\n  x\ty\xc3\xa9 %d\n" % (i, i * i) for i in range(400))
    whole = {"a": [lines, b"\xef\xbb\xbf" + lines[:-1], b""], "b": [b"no end"], "d": [b"\n\n"], "e": [b"\xef\xbb\xbfx\n"], "f*[1]": [b"odd"]}
    for name, parts in whole.items():
        for i, part in enumerate(parts):
            put(base, f"{name}/part-{i}", part)
    with conf(spark, "spark.sql.files.maxPartitionBytes", "1000"), conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "37"):
        pieces = io.read_raw_answers(spark, f"{base}/*", pieces=True)
        assert pieces.rdd.getNumPartitions() == len(whole) + 2      # a task for each answer
        got = {os.path.basename(r["path"]): r["raw_md5"] for r in io.raw_digests(pieces).collect()}
    assert got == {name: hashlib.md5(b"".join(parts)).hexdigest() for name, parts in whole.items()}


def test_large_files_without_a_header_are_listed_once(spark):
    """a text over the size of whole files is one row of the quarantine, as a small one is."""
    base = local_scratch(spark, "texts")
    put(base, "a_summary.csv", b"task_id,overall_score\nT/1,0.5\nT/2,0.25\n")
    put(base, "b_summary.csv", b"Once upon, a time\nthere were\n\nlines, and more lines\n")
    for size in (1 << 20, 10):
        good, bad = quarantine.load_summaries(spark, base, whole_file=size)
        assert sorted((r["model"], r["task_id"], r["overall_score"]) for r in good.collect()) == [("a", "T/1", 0.5), ("a", "T/2", 0.25)]
        assert [(os.path.basename(r["path"]), r["line"], r["reason"]) for r in bad.collect()] == [("b_summary.csv", 1, "no summary header in line 1")]


def test_tasks_are_counted_where_they_are(spark):
    """exact counts without a set of the tasks' ids."""
    rows = [(f"m{i % 3}", None if i % 10 == 0 else f"T/{i % 70}") for i in range(1000)]
    df = spark.createDataFrame(rows, "model string, task_id string").repartition(5)
    counted, seen = io.counted(df)
    assert counted.columns == df.columns and "collect_set(task_id" not in counted._jdf.queryExecution().analyzed().toString()
    out = local_scratch(spark, "counted")
    io.write_jsonl(counted, out)
    assert seen.get == {"n_rows": 1000, "n_models": 3, "n_tasks": len({t for _, t in rows if t})}
    assert spark.read.schema(df.schema).json(out).exceptAll(df).count() == 0


def test_a_file_is_parsed_in_pieces():
    """what the parser holds does not follow the file's size."""
    content = b"task_id,overall_score\n" + b"".join(b'"T,%d",0.5\n' % i for i in range(400_000))
    tracemalloc.start()
    n = sum(row[-2] is None for row in quarantine._parse("f", content))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400_000 and peak < len(content)


def test_writes_by_folder_do_not_sort(spark, monkeypatch):
    """the rows of a task go to open files, not through a sort of all of them."""
    key, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    before = spark.conf.get(key, None)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: seen.append(int(spark.conf.get(key))) or write(self, *a, **k))
    df = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, "three").alias("why"))
    good, bad = quarantine.split_rows(df, F.col("why"), local_scratch(spark, "parts"))
    assert seen and seen[0] >= 2 and spark.conf.get(key, None) == before
    assert good.count() == 66 and bad.count() == 34
    with pytest.raises(ValueError), open_writers(spark):
        raise ValueError
    assert spark.conf.get(key, None) == before


def test_arriving_files_follow_the_input(spark, monkeypatch):
    """the files that a stream reads grow in number, not in size."""
    from scorelab.plans.stream_queries import stream_means, stream_means_updated

    base = local_scratch(spark, "tables")
    li = spark.range(600).select((F.col("id") % 200).alias("l_orderkey"), (F.col("id") % 3).cast("int").alias("l_linenumber"), F.lit(7.0).alias("l_quantity"),
                                 F.lit(0.05).alias("l_tax"), F.lit(0.02).alias("l_discount"), F.when(F.col("id") % 2 == 0, "R").otherwise("A").alias("l_returnflag"))
    li.repartition(6).write.parquet(f"{base}/lineitem.parquet")
    sizes, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (write(self, path, *a, **k), sizes.append(path))[0])
    with conf(spark, "spark.sql.files.maxPartitionBytes", "1000"):
        got = sorted(map(tuple, stream_means_updated(spark, base).collect()))
        src = next(p for p in sizes if "measurement-files" in p).removeprefix("file:")
        assert sum(f.endswith(".parquet") for f in os.listdir(src)) > 4
    assert got == sorted(map(tuple, stream_means(spark, base).collect()))
