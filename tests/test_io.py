"""Readers and writers round-trip through the checkpoint scratch folder."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF001, local_scratch
from scorelab.sources import io


def test_samples_discovery(spark):
    base = local_scratch(spark, "samples")
    os.makedirs(base)
    with open(os.path.join(base, "org_m_7b_samples.jsonl"), "w") as f:
        f.write(json.dumps({"task_id": "T/1", "completion": "x"}) + "\n\n")
        f.write(json.dumps({"task_id": "T/2"}) + "\n")
    with open(os.path.join(base, "other.jsonl"), "w") as f:
        f.write(json.dumps({"task_id": "T/1", "completion": "y"}) + "\n")
    got = sorted((r["model"], r["task_id"], r["completion"]) for r in io.read_samples(spark, base).collect())
    assert got == [("org_m_7b", "T/1", "x"), ("org_m_7b", "T/2", None), ("other", "T/1", "y")]
    missing = io.read_samples(spark, os.path.join(base, "nope"))
    assert missing.count() == 0 and "model" in missing.columns


def test_summary_roundtrip(spark):
    out = local_scratch(spark, "summary")
    rows = [("m:1", "T/1", True, 0.9, 0.9, 0.5, None, 0.96, 1.0, 0.7),
            ("m:1", "T/2", False, None, None, 0.0, None, 0.98, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "model string, task_id string, passed boolean, avg_cyclomatic_complexity double, "
                               "max_cyclomatic_complexity double, style_score double, efficiency_score double, "
                               "loc_score double, functional_correctness double, overall_score double")
    io.write_summary_csv(df, out)
    part = [d for d in os.listdir(out) if d.startswith("model=")]
    assert part == ["model=m_1"]
    folder = os.path.join(out, part[0])
    text = "".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.endswith(".csv"))
    assert text.splitlines()[0].startswith("task_id,passed,avg_cyclomatic_complexity")
    assert ",True," in text and ",False," in text
    # read back with the summary reader (file-name model = partition file, so rename-free check of values)
    back = io.read_summaries(spark, os.path.join(out, "model=m_1", "*.csv"))
    got = sorted((r["task_id"], r["passed"], r["overall_score"]) for r in back.collect())
    assert got == [("T/1", True, 0.7), ("T/2", False, 0.0)]


def test_jsonl_writes_nulls(spark):
    out = local_scratch(spark, "jsonl")
    df = spark.createDataFrame([("T/1", None)], "task_id string, completion string")
    io.write_jsonl(df, out)
    lines = [line for f in os.listdir(out) if f.endswith(".json") for line in open(os.path.join(out, f))]
    assert json.loads(lines[0]) == {"task_id": "T/1", "completion": None}


def test_raw_answers_and_chunks(spark):
    base = local_scratch(spark, "raw")
    os.makedirs(base)
    with open(os.path.join(base, "a.txt"), "w") as f:
        f.write('line1\n{"code": "x"}\n')
    assert io.read_raw_answers(spark, base).first()["raw"] == 'line1\n{"code": "x"}\n'
    with open(os.path.join(base, "c.ndjson"), "w") as f:
        f.write('{"request_id": "r", "seq": 0, "response": "a", "done": false}\n\n')
        f.write('{"request_id": "r", "seq": 1, "response": "b", "done": true}\n')
    assert io.read_chunks(spark, os.path.join(base, "c.ndjson")).count() == 2


def test_matrix_csv(spark):
    from scorelab.operators import rank

    out = local_scratch(spark, "matrix")
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 1.0, 1.0), (3.0, 3.0, 2.0)], "a double, b double, c double")
    io.write_matrix_csv(rank.full_matrix(rank.spearman_long(df, ["a", "b", "c"], bounded_groups=True)), out,
                        metrics=["a", "b", "c"])
    text = open([os.path.join(out, f) for f in os.listdir(out) if f.endswith(".csv")][0]).read().splitlines()
    assert text[0] == "metric,a,b,c" and text[1].startswith("a,1.0,0.5,")


def test_prompt_table(spark):
    from scorelab.operators.prompts import prompt_table

    b = spark.read.parquet(f"{SF001}/benchmark.parquet").select(
        F.col("item_id").cast("string").alias("task_id"), F.col("text").alias("prompt"))
    t = prompt_table(b, ["a/b:1", "c"], samples_per_task=3)
    assert t.count() == b.count() * 2 * 3
    r = t.where("model = 'a/b:1'").first()
    assert r["safe_model"] == "a_b_1" and '{ "code": "<Python function code here>" }' in r["prompt"]


def test_problems_gzip(spark):
    import gzip

    base = local_scratch(spark, "problems")
    os.makedirs(base)
    with gzip.open(os.path.join(base, "problems.jsonl.gz"), "wt") as f:
        for i in range(5):
            f.write(json.dumps({"task_id": f"T/{i}", "prompt": f"def f{i}():", "extra": i}) + "\n")
    df = io.read_problems(spark, os.path.join(base, "*.jsonl.gz"), partitions=3)
    assert df.rdd.getNumPartitions() == 3
    assert sorted(r["task_id"] for r in df.collect()) == [f"T/{i}" for i in range(5)]


def _write(base, name, text):
    os.makedirs(base, exist_ok=True)
    with open(os.path.join(base, name), "w") as f:
        f.write(text)


def test_summaries_are_read_by_column_name(spark):
    import pytest

    base = local_scratch(spark, "by-name")
    _write(base, "a_7b_summary.csv", "task_id,passed,style_score,avg_cyclomatic_complexity,extra\nT/1,True,0.11,0.92,9\nT/2,False,,nan?,9\n")
    _write(base, "b_summary.csv", "overall_score,task_id\n0.7,T/1\n")
    got = {(r.model, r.task_id): r for r in io.read_summaries(spark, f"{base}/*_summary.csv").collect()}
    assert set(got) == {("a_7b", "T/1"), ("a_7b", "T/2"), ("b", "T/1")}
    r = got[("a_7b", "T/1")]
    assert (r.passed, r.style_score, r.avg_cyclomatic_complexity, r.overall_score) == (True, 0.11, 0.92, None)
    assert got[("b", "T/1")].overall_score == 0.7 and got[("b", "T/1")].max_cyclomatic_complexity is None
    assert got[("a_7b", "T/2")].avg_cyclomatic_complexity is None
    assert io.read_summaries(spark, f"{base}/none*.csv").count() == 0
    _write(base, "c_summary.csv", "1,2\n3,4\n")
    with pytest.raises(ValueError):
        io.read_summaries(spark, f"{base}/*_summary.csv")


def test_unreadable_files_and_lines_are_told(spark):
    import pytest

    base = local_scratch(spark, "broken")
    os.makedirs(base)
    import gzip

    whole = gzip.compress(b"task_id,passed\n" + b"".join(b"T/%d,True\n" % i for i in range(20000)))
    with open(os.path.join(base, "x_summary.csv.gz"), "wb") as f:
        f.write(whole[:len(whole) // 2])
    with pytest.raises(Exception):
        io.read_summaries(spark, f"{base}/*.csv.gz").count()
    _write(base, "c.ndjson", '{"request_id": "r", "seq": 0, "response": "a", "done": false}\n{"request_id": "r", "se\n')
    with pytest.raises(Exception):
        io.read_chunks(spark, os.path.join(base, "c.ndjson")).collect()
    kept = io.read_chunks(spark, os.path.join(base, "c.ndjson"), bad_lines="keep").collect()
    assert len(kept) == 2 and sum(r.bad_line is not None for r in kept) == 1


def test_evaluate_has_one_row_per_sample(spark):
    from scorelab.operators.metrics import evaluate

    samples = spark.createDataFrame([("m", "t", 0, "def f():\n    if a: pass", True), ("m", "t", 1, "def f(", False)],
                                    "model string, task_id string, sample_id int, completion string, ok boolean")
    verdicts = spark.createDataFrame([("m", "t", 0, True), ("m", "t", 0, True), ("m", "t", 1, False)], "model string, task_id string, sample_id int, passed boolean")
    got = {r.sample_id: r for r in evaluate(samples, verdicts, syntax_ok="ok", keep_code=True).collect()}
    assert len(got) == 2 and got[0].passed and not got[1].passed and got[0].completion.startswith("def")
    assert got[1].avg_cyclomatic_complexity is None and got[1].style_score == 0.0 and got[0].avg_cyclomatic_complexity == 0.8
