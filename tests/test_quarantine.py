"""Summary files and answers that cannot be read are listed with a reason; everything else loads."""

import gzip
import os
import warnings

import pytest
from pyspark.sql import functions as F

from conftest import local_scratch
from scorelab.functions import text as TX
from scorelab.sources import io, quarantine


def put(base, name, data):
    os.makedirs(base, exist_ok=True)
    with open(os.path.join(base, name), "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def folder(spark):
    base = local_scratch(spark, "summaries")
    put(base, "a_summary.csv", 'task_id,passed,overall_score\nT/1,True,0.5\n"T,2",False,x\n\nT/3\nT/4,True,0.1,9\n')
    put(base, "b c_summary.csv", '﻿overall_score,note,task_id\n0.25,"two\nlines, and ""quotes""",T/1\n1,"a \\"b\\"",task_id\n')
    put(base, "d_summary.csv.gz", gzip.compress(b"task_id,overall_score\nT/1,0.5\n") + gzip.compress(b"T/2,0.75\n"))
    whole = gzip.compress(b"task_id\n" + b"".join(b"T/%d\n" % i for i in range(9000)))
    put(base, "cut_summary.csv.gz", whole[:len(whole) // 2])
    put(base, "head_summary.csv", "1,2\ntask_id,passed\n")
    put(base, "bytes_summary.csv", b"task_id,passed\n\xff\xfe,True\n")
    put(base, "empty_summary.csv", "")
    return base


def test_bad_files_and_rows_are_listed_and_none_is_lost(spark):
    good, bad = quarantine.load_summaries(spark, f"{folder(spark)}/*")
    got = sorted(((r["model"], r["task_id"], r["passed"], r["overall_score"]) for r in good.collect()), key=str)
    assert got == sorted([("a", "T/1", True, 0.5), ("a", "T,2", False, None), ("a", "T/3", None, None), ("b c", "T/1", None, 0.25), ("b c", "task_id", None, 1.0),
                          ("d.csv", "T/1", None, 0.5), ("d.csv", "T/2", None, 0.75)], key=str)
    assert {r["task_id"] for r in good.where("model like 'd%'").collect()} == {"T/1", "T/2"}
    listed = {os.path.basename(r["path"]).replace("%20", " "): r for r in bad.collect()}
    assert set(listed) == {"a_summary.csv", "cut_summary.csv.gz", "head_summary.csv", "bytes_summary.csv"}
    assert listed["a_summary.csv"]["raw"] == "T/4,True,0.1,9" and listed["a_summary.csv"]["line"] == 6
    assert "header" in listed["head_summary.csv"]["reason"] and "unreadable" in listed["cut_summary.csv.gz"]["reason"]


def test_reader_fails_or_warns_by_name(spark):
    base = folder(spark)
    with pytest.raises(ValueError):
        io.read_summaries(spark, f"{base}/*")
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        assert io.read_summaries(spark, f"{base}/*", ignore_corrupt=True).count() == 7
    said = " ".join(str(w.message) for w in told)
    assert all(name in said for name in ("cut_summary", "head_summary", "bytes_summary", "a_summary"))


def test_large_files_are_split_and_agree(spark):
    base = local_scratch(spark, "large")
    put(base, "a_summary.csv", 'task_id,overall_score\n"T,1",0.5\nT/2,0.75,1\nT/3\n')
    put(base, "b_summary.csv", "overall_score,task_id,more\n0.5,T/1,x\n")
    small, large = (quarantine.load_summaries(spark, base, whole_file=size) for size in (1 << 20, 10))
    for which in (0, 1):
        rows = [sorted(str([r[c] for c in ("model", "task_id", "overall_score") if c in part[which].columns]) + os.path.basename(r["path"] if "path" in part[which].columns else "")
                       for r in part[which].collect()) for part in (small, large)]
        assert rows[0] == rows[1] and rows[0]


def test_one_scan_of_the_files(spark):
    base = folder(spark)
    scans = []
    plans = quarantine._scan_small
    quarantine._scan_small = lambda files: scans.append(1) or plans(files)
    try:
        good, bad = quarantine.load_summaries(spark, f"{base}/*")
    finally:
        quarantine._scan_small = plans
    assert len(scans) == 1
    for part in (good, bad):
        assert "binaryFile" not in part._jdf.queryExecution().executedPlan().toString()     # they read what was written


def test_missing_folder(spark):
    good, bad = quarantine.load_summaries(spark, local_scratch(spark, "nowhere") + "/*.csv")
    assert good.count() == bad.count() == 0 and "model" in good.columns


def test_answers_are_split_by_reason(spark):
    rows = [(1, 'x {"code": "a"} y'), (2, "none"), (3, '{"code": "a"'), (4, "{'code': 1}"), (5, '{"note": 1}'), (6, None), (7, '{"completion": "b"}')]
    df = spark.createDataFrame(rows, "id int, raw string").withColumn("r", TX.extract_strict(F.col("raw")))
    good, bad = quarantine.split_rows(df.select("id", "r.code", "r.error"), F.col("error"), local_scratch(spark, "answers"))
    assert sorted((r["id"], r["code"]) for r in good.collect()) == [(1, "a"), (7, "b")]
    assert sorted((r["id"], r["reason"]) for r in bad.collect()) == [(2, "no_object"), (3, "unclosed"), (4, "invalid_json"), (5, "no_code_field"), (6, "no_object")]


def test_one_file_a_model_and_splits_of_a_hot_one(spark):
    out = local_scratch(spark, "files")
    n = {"hot": 2500, "b/c:1": 300, "d": 1}
    rows = [(m, "T/1", True, 0.5, 0.5, 0.5, 0.5, 0.5, 1.0, 0.5) for m, k in n.items() for _ in range(k)]
    df = spark.createDataFrame(rows, "model string, task_id string, passed boolean, avg_cyclomatic_complexity double, max_cyclomatic_complexity double, "
                               "style_score double, efficiency_score double, loc_score double, functional_correctness double, overall_score double").repartition(6)
    io.write_summary_csv(df, out, max_rows=1000)
    count = {d: sum(f.endswith(".csv") for f in os.listdir(os.path.join(out, d))) for d in os.listdir(out) if d.startswith("model=")}
    assert count == {"model=hot": 3, "model=b_c_1": 1, "model=d": 1}
    back = {r["model"]: r["count"] for r in io.read_summaries(spark, out, model_from="partition").groupBy("model").count().collect()}
    assert back == {"hot": 2500, "b_c_1": 300, "d": 1}


def test_named_sample_files(spark):
    out = local_scratch(spark, "named")
    df = spark.createDataFrame([("org/m:7b", "T/1", "x"), ("org/m:7b", "T/2", None), ("e e=%", "T/1", "y")], "model string, task_id string, completion string")
    io.write_samples(df, out)
    assert sorted(f for f in os.listdir(out) if f.endswith(".jsonl")) == ["e e=%_samples.jsonl", "org_m_7b_samples.jsonl"]
    assert sorted((r["task_id"], r["completion"]) for r in io.read_samples(spark, out).where("model = 'org_m_7b'").collect()) == [("T/1", "x"), ("T/2", None)]


def test_counts_are_observed_without_another_pass(spark):
    df = spark.createDataFrame([("a", "T/1"), ("a", "T/2"), ("b", "T/1"), (None, None)], "model string, task_id string")
    for tasks in ("exact", "sketch"):
        rows, seen = io.counted(df, tasks=tasks)
        rows.write.format("noop").mode("overwrite").save()
        assert seen.get == {"n_rows": 4, "n_models": 2, "n_tasks": 2}
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan") == 1 and "Exchange" not in plan


def test_lookups(spark):
    from scorelab.operators import metrics as M

    samples = spark.createDataFrame([("m", "T/1"), ("m", "T/1"), ("n", "T/9"), ("n", None)], "model string, task_id string")
    problems = spark.createDataFrame([("T/1", "p"), ("T/1", "a"), ("T/2", "q"), (None, "z")], "task_id string, prompt string")
    for limit in (2000, 0):
        got = sorted(map(tuple, M.lookup_tasks(samples, problems, broadcast_rows=limit).select("model", "task_id", "prompt", "known").collect()), key=str)
        assert got == sorted([("m", "T/1", "a", True), ("m", "T/1", "a", True), ("n", "T/9", None, False), ("n", None, None, False)], key=str)
    report = {r["task_id"]: (r["n_samples"], r["status"]) for r in M.lookup_report(samples, problems).collect()}
    assert report == {"T/1": (2, "matched"), "T/9": (1, "unknown"), "T/2": (0, "unattempted"), None: (1, "unknown")}
