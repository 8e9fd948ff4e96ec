"""Registered queries exercising sinks and sources: results are written to the
checkpoint folder and read back, so the check covers the on-disk formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelab.operators import agg, rank
from scorelab.plans import relations as R
from scorelab.plans.catalog import register, rounded
from scorelab.plans.analytics_queries import MEAN_COLS, _MEANS, _MEANS_LONG, _SPEARMAN_SQL, _avg_rank, _means
from scorelab.operators import metrics as M
from scorelab.plans.text_queries import PROSE_MARKER, PROSE_WORDS, _duck_eval, _verdicts
from scorelab.schemas import HEATMAP_METRICS, METRICS
from scorelab.session import open_writers, scratch_path
from scorelab.sources import io


@register("summary_csv_roundtrip", f"""SELECT model, count(*) AS n,
       {', '.join(f'round(avg({c}), 6) AS {c}' for c in MEAN_COLS)}
FROM ({R.ORACLE_L}) WHERE overall_score IS NOT NULL GROUP BY model""")
def summary_csv_roundtrip(spark, sf_dir):
    """K2 -> S3/U1: scored rows written as per-model summary CSVs (True/False booleans,
    empty cells for NULL), scanned back in one pass, then per-model means."""
    out = scratch_path(spark, "summary-csv")
    io.write_summary_csv(R.measurements(spark, sf_dir), out)
    back = io.read_summaries(spark, out, model_from="partition")
    return rounded(agg.model_means(back))


@register("results_jsonl_roundtrip", f"""
WITH r AS ({_duck_eval()})
SELECT r.*, md5(d.text) AS completion_md5, CAST(length(d.text) AS INTEGER) AS completion_len
FROM r JOIN documents d ON r.task_id = CAST(d.doc_id AS VARCHAR)""")
def results_jsonl_roundtrip(spark, sf_dir):
    """K1 -> scan: full result rows with their texts written as JSONL, NULLs kept, read back by
    schema; all columns and digests of the texts."""
    out = scratch_path(spark, "results-jsonl")
    docs = R.table(spark, sf_dir, "documents").select(
        F.col("source").alias("model"), F.col("doc_id").cast("string").alias("task_id"), F.col("text").alias("completion"))
    io.write_jsonl(rounded(M.evaluate(docs, _verdicts(spark, sf_dir), None, words=PROSE_WORDS, block_marker=PROSE_MARKER, keep_code=True)), out)
    back = io.read_results(spark, out)
    return back.select("*", F.md5("completion").alias("completion_md5"), F.length("completion").alias("completion_len")).drop("completion")


def _wide_sql() -> str:
    full = """fullm AS (SELECT pos_a, metric_a, pos_b, metric_b, rho FROM corr
                       UNION ALL SELECT pos_b, metric_b, pos_a, metric_a, rho FROM corr WHERE pos_a <> pos_b)"""
    cols = ", ".join(f"max(CASE WHEN metric_b = '{m}' THEN round(rho, 4) END) AS {m}" for m in METRICS)
    return _SPEARMAN_SQL + f", {full} SELECT metric_a AS metric, {cols} FROM fullm GROUP BY metric_a"


@register("spearman_wide", _wide_sql())
def spearman_wide(spark, sf_dir):
    """K3 shape: the full labelled Spearman matrix, rounded to 4 places."""
    # all ordered pairs in one pass (mirroring a triangle with a union would compute it twice)
    long = rank.spearman_long(_means(spark, sf_dir), METRICS, lower=False, bounded_groups=True)
    return rank.wide_matrix(long, "rho", METRICS, 4)


_L_MODELS = [str(i) for i in range(1, 8)]


@register("task_matrix_wide", f"""SELECT task_id,
       {', '.join(f"round(avg(CASE WHEN model = '{m}' THEN overall_score END), 6) AS \"{m}_score\", "
                  f"round(max(CASE WHEN model = '{m}' THEN functional_correctness END), 6) AS \"{m}_passed\""
                  for m in _L_MODELS)}
FROM ({R.ORACLE_L}) GROUP BY task_id""")
def task_matrix_wide(spark, sf_dir):
    """A21 wide: task x model score and correctness with the model list fixed up front
    (no extra pass to discover pivot values)."""
    return rounded(agg.task_matrix(R.measurements(spark, sf_dir), models=_L_MODELS))


@register("heatmap_means", f"""SELECT model, {', '.join(f'round(avg({c}), 6) AS {c}' for c in HEATMAP_METRICS)}
FROM ({R.ORACLE_L}) GROUP BY model""")
def heatmap_means(spark, sf_dir):
    """A2 + O2: per-model means of the heatmap metric list, ordered by model."""
    df = R.measurements(spark, sf_dir)
    m = df.groupBy("model").agg(*[F.avg(c).alias(c) for c in HEATMAP_METRICS]).orderBy("model")
    return rounded(m)


@register("summary_csv_by_name", f"""SELECT model, count(*) AS n, round(avg(overall_score), 6) AS overall_score,
       round(avg(CASE WHEN model IN ('1', '2', '3') THEN style_score END), 6) AS style_score
FROM ({R.ORACLE_L}) GROUP BY model""")
def summary_csv_by_name(spark, sf_dir):
    """S3 + U1: summary files with their columns in another order, without some of them, and with
    one too many, scanned together by column name."""
    out = scratch_path(spark, "summary-by-name")
    rows = R.measurements(spark, sf_dir)
    first = rows.where(F.col("model").isin("1", "2", "3")).select("style_score", F.lit("x").alias("note"), "overall_score", "task_id", "model")
    with open_writers(spark):
        first.write.partitionBy("model").option("header", True).csv(out)
    rest = rows.where(~F.col("model").isin("1", "2", "3")).select("task_id", "passed", "overall_score", "model")
    with open_writers(spark):
        rest.write.mode("append").partitionBy("model").option("header", True).csv(out)
    back = io.read_summaries(spark, out, model_from="partition")
    return rounded(back.groupBy("model").agg(F.count("task_id").alias("n"), F.avg("overall_score").alias("overall_score"), F.avg("style_score").alias("style_score")))


@register("problems_gzip_scan", """SELECT CAST(doc_id AS VARCHAR) AS task_id, md5(text) AS prompt_md5 FROM documents""")
def problems_gzip_scan(spark, sf_dir):
    """A gzip problems file of the documents, with a key that the scan ignores."""
    out = scratch_path(spark, "problems")
    R.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("task_id"), F.col("text").alias("prompt"), "lang").write.option(
        "compression", "gzip").json(out)
    return io.read_problems(spark, out).select("task_id", F.md5("prompt").alias("prompt_md5"))


@register("chunks_ndjson_scan", f"""SELECT CAST(request_id AS VARCHAR) AS request_id, count(*) AS n_chunks, sum(CAST(done AS INTEGER)) AS n_done,
       CAST(sum(length(coalesce(response, ''))) AS BIGINT) AS n_chars FROM ({R.ORACLE_C}) GROUP BY request_id""")
def chunks_ndjson_scan(spark, sf_dir):
    """Chunk logs written as NDJSON and scanned back; a line that is no chunk would fail the scan."""
    out = scratch_path(spark, "chunks")
    R.chunks(spark, sf_dir).select(F.col("request_id").cast("string").alias("request_id"), "seq", "response", "done").write.json(out)
    return io.read_chunks(spark, out).groupBy("request_id").agg(
        F.count("*").alias("n_chunks"), F.sum(F.col("done").cast("int")).alias("n_done"),
        F.sum(F.length(F.coalesce("response", F.lit("")))).alias("n_chars"))


@register("matrix_csv_roundtrip", _wide_sql())
def matrix_csv_roundtrip(spark, sf_dir):
    """K3: the labelled matrix as a CSV file, read back."""
    out = scratch_path(spark, "matrix")
    io.write_matrix_csv(rank.spearman_long(_means(spark, sf_dir), METRICS, lower=False, bounded_groups=True), out, "rho", METRICS)
    return spark.read.schema("metric string, " + ", ".join(f"{m} double" for m in METRICS)).option("header", True).csv(out)


@register("rank_table", f"""
WITH means AS ({_MEANS}), o AS (SELECT model, {_avg_rank('round(overall_score, 12)', '1')} AS overall_rank FROM means),
l AS (SELECT model, metric, v FROM ({_MEANS_LONG})),
r AS (SELECT model, metric, {_avg_rank('v', 'metric')} AS metric_rank FROM l WHERE v IS NOT NULL)
SELECT l.model, l.metric, o.overall_rank, r.metric_rank FROM l JOIN o USING (model) LEFT JOIN r USING (model, metric)""")
def rank_table(spark, sf_dir):
    """Average ranks of every model, overall and by metric."""
    return rank.rank_table(_means(spark, sf_dir), METRICS)


@register("list_avg_max", """SELECT user_id, round(avg(value), 6) AS avg, round(max(value), 6) AS max FROM events GROUP BY user_id""")
def list_avg_max(spark, sf_dir):
    """M5 on the list of each user's values."""
    lists = R.table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("v"))
    return rounded(lists.select("user_id", M.list_avg_max(F.col("v")).alias("s")).select("user_id", "s.avg", "s.max"))
