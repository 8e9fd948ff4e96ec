"""Registered queries for answer extraction, cleaning, chunk assembly, metric extraction and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelab.functions import text as TX
from scorelab.functions.scale import display_label, safe_name, scale_lint
from scorelab.operators import chunks as CH
from scorelab.operators import metrics as M
from scorelab.operators import prompts as P
from scorelab.plans import relations as R
from scorelab.plans.catalog import register, rounded


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def duck_strip(x: str) -> str:
    return f"trim({x}, {_q(TX.WS_LITERAL)})"


def duck_clean(x: str) -> str:
    """The cleaner in DuckDB SQL (RE2): same patterns, same order."""
    s = f"regexp_replace({x}, {_q(TX.FENCE)}, '', 'g')"
    s = duck_strip(s)
    s = f"regexp_replace({s}, {_q(TX.LEAD_WRAPPER)}, '')"
    s = f"regexp_replace({s}, {_q(TX.TRAIL_WRAPPER)}, '')"
    s = f"regexp_replace({s}, {_q(TX.ANGLE_TOKEN)}, '', 'g')"
    s = f"translate({s}, {_q(chr(0x2581) + chr(0xFF5C))}, ' |')"
    s = f"regexp_replace({s}, {_q(TX.ZERO_WIDTH)}, '', 'g')"
    s = f"regexp_replace({s}, {_q(TX.TRAILING_BLANKS)}, chr(10), 'g')"
    s = f"regexp_replace({s}, {_q(TX.MANY_NEWLINES)}, chr(10) || chr(10), 'g')"
    return duck_strip(s)


def duck_lines(x: str) -> str:
    return f"regexp_split_to_array({x}, {_q(TX.SPLITLINES)})"


def duck_loc(x: str) -> str:
    return f"CAST(len(list_filter({duck_lines(x)}, lambda l: regexp_matches(l, {_q(TX.NONBLANK)}))) AS INTEGER)"


@register("json_extract", f"""SELECT doc_id, md5({duck_clean('text')}) AS code_md5,
       CAST(length({duck_clean('text')}) AS INTEGER) AS code_len, CAST(NULL AS VARCHAR) AS error FROM documents""")
def json_extract(spark, sf_dir):
    """First balanced JSON object of a chatty answer, its code field, cleaned."""
    x = R.wrapped_answers(spark, sf_dir)
    r = x.select("doc_id", TX.extract_strict(F.col("raw")).alias("r")).select("doc_id", "r.code", "r.error")
    return r.select("doc_id", F.md5("code").alias("code_md5"), F.length("code").alias("code_len"), "error")


@register("json_lenient", f"""SELECT doc_id, md5({duck_clean('text')}) AS code_md5 FROM documents""")
def json_lenient(spark, sf_dir):
    """T4: lenient mode (JSON code field, else the cleaned raw answer)."""
    x = R.wrapped_answers(spark, sf_dir)
    return x.select("doc_id", F.md5(TX.extract_lenient(F.col("raw"))).alias("code_md5"))


@register("json_fallback", f"""SELECT doc_id, md5({duck_clean('text')}) AS code_md5,
       CASE WHEN position('{{' IN text) = 0 THEN 'no_object' END AS error FROM documents""")
def json_fallback(spark, sf_dir):
    """T4/T5 on answers without any JSON: strict mode reports the error, lenient mode
    falls back to cleaning the raw text."""
    d = R.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(TX.extract_lenient(F.col("text"))).alias("code_md5"),
                    TX.extract_strict(F.col("text"))["error"].alias("error"))


@register("clean_text", f"""SELECT doc_id, md5({duck_clean('text')}) AS clean_md5,
       CAST(length({duck_clean('text')}) AS INTEGER) AS clean_len FROM documents""")
def clean_text(spark, sf_dir):
    """T6 on documents (blank runs, trailing blanks, strip, tokens)."""
    d = R.table(spark, sf_dir, "documents").select("doc_id", TX.clean_code(F.col("text")).alias("c"))
    return d.select("doc_id", F.md5("c").alias("clean_md5"), F.length("c").alias("clean_len"))


@register("clean_pages", f"""SELECT page_id, md5({duck_clean('html')}) AS clean_md5,
       CAST(length({duck_clean('html')}) AS INTEGER) AS clean_len FROM pages""")
def clean_pages(spark, sf_dir):
    """T6 on raw web pages: tag-like spans removed."""
    g = R.table(spark, sf_dir, "pages").select("page_id", TX.clean_code(F.col("html")).alias("c"))
    return g.select("page_id", F.md5("c").alias("clean_md5"), F.length("c").alias("clean_len"))


@register("loc_count", f"SELECT doc_id, {duck_loc('text')} AS loc FROM documents")
def loc_count(spark, sf_dir):
    """P5: logical (non-blank) lines per document."""
    d = R.table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.logical_lines(F.col("text")).alias("loc"))


@register("assemble_chunks", f"""
WITH c AS ({R.ORACLE_C}),
fd AS (SELECT request_id, min(seq) FILTER (WHERE done) AS first_done FROM c GROUP BY request_id)
SELECT c.request_id, string_agg(c.response, '' ORDER BY c.seq) AS response, count(*) AS n_chunks,
       bool_or(fd.first_done IS NOT NULL) AS done
FROM c JOIN fd USING (request_id)
WHERE fd.first_done IS NULL OR c.seq <= fd.first_done
GROUP BY c.request_id""")
def assemble_chunks(spark, sf_dir):
    """Responses assembled from ordered chunks up to the first done chunk."""
    return CH.assemble_responses(R.chunks(spark, sf_dir))


# Prose stand-ins for the complexity scan of documents: block marker and decision words.
PROSE_MARKER = r"^(?:The|And|Of)(?![A-Za-z0-9_])"
PROSE_MARKER_RE2 = r"^(The|And|Of)\b"
PROSE_WORDS = ["if", "for", "and", "or", "while"]
PROSE_WORDS_RE2 = r"\b(if|for|and|or|while)\b"


def _duck_blocks() -> str:
    return f"""
dl AS (SELECT doc_id, {duck_lines('text')} AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS idx FROM dl),
m AS (SELECT doc_id, idx, CASE WHEN regexp_matches(line, {_q(PROSE_MARKER_RE2)}) THEN 1 ELSE 0 END AS mk,
             len(regexp_extract_all(line, {_q(PROSE_WORDS_RE2)})) AS c FROM l),
b AS (SELECT doc_id, sum(mk) OVER (PARTITION BY doc_id ORDER BY idx) AS blk, c FROM m),
blocks AS (SELECT doc_id, blk, 1 + sum(c) AS cc FROM b WHERE blk > 0 GROUP BY doc_id, blk),
cc AS (SELECT d.doc_id, CAST(coalesce(avg(cc), 0) AS DOUBLE) AS avg_cc, CAST(coalesce(max(cc), 0) AS DOUBLE) AS max_cc,
              count(blk) AS n_blocks FROM documents d LEFT JOIN blocks USING (doc_id) GROUP BY d.doc_id)"""


@register("decision_points", f"WITH {_duck_blocks()} SELECT doc_id, round(avg_cc, 6) AS avg_cc, round(max_cc, 6) AS max_cc, n_blocks FROM cc")
def decision_points(spark, sf_dir):
    """M1 + M5: lexical block complexity (avg and max over blocks) per document."""
    d = R.table(spark, sf_dir, "documents")
    cc = d.select("doc_id", M.decision_points(F.col("text"), PROSE_WORDS, PROSE_MARKER).alias("cc"))
    return rounded(cc.select("doc_id", "cc.avg_cc", "cc.max_cc", F.col("cc.n_blocks").cast("bigint").alias("n_blocks")))


def _duck_rules() -> str:
    terms = " + ".join(
        f"{float(w)!r} * len(list_filter(lines, lambda l: regexp_matches(l, {_q(rx)})))" for _, rx, w in M.DEFAULT_RULES
    )
    return f"""
rl AS (SELECT doc_id, {duck_lines('text')} AS lines FROM documents),
rp AS (SELECT doc_id, 0.0 + {terms} AS penalty,
              len(list_filter(lines, lambda l: regexp_matches(l, {_q(TX.NONBLANK)}))) AS n_lines FROM rl),
rs AS (SELECT doc_id, penalty, n_lines,
              CASE WHEN n_lines = 0 THEN 0.05
                   WHEN 10.0 - 10.0 * penalty / n_lines = 0.0 THEN 0.05
                   ELSE 10.0 - 10.0 * penalty / n_lines END AS raw_score FROM rp)"""


@register("rule_score", f"""WITH {_duck_rules()}
SELECT doc_id, round(raw_score, 6) AS raw_score, round(least(raw_score / 10.0, 1.0), 6) AS style_score FROM rs""")
def rule_score(spark, sf_dir):
    """M2: rule-based style score per document (lint-score shape, floors kept)."""
    d = R.table(spark, sf_dir, "documents").select("doc_id", M.rule_score(F.col("text")).alias("raw_score"))
    return rounded(d.select("doc_id", "raw_score", scale_lint("raw_score").alias("style_score")))


@register("mean_runtime", f"""SELECT model, task_id, count(*) AS n_attempts, round(avg(seconds), 6) AS mean_seconds,
       round(1.0 - least(avg(seconds) / 1.0, 1.0), 6) AS efficiency_score FROM ({R.ORACLE_E}) GROUP BY model, task_id""")
def mean_runtime(spark, sf_dir):
    """M3: mean recorded run time per (model, task) and its efficiency score."""
    return rounded(M.mean_runtime(R.runs(spark, sf_dir)))


@register("verdict_join", f"""SELECT model, task_id, passed, coalesce(CAST(passed AS DOUBLE), 0.0) AS functional_correctness
FROM ({R.ORACLE_D})""")
def verdict_join(spark, sf_dir):
    """M4 + J1: samples left-joined with recorded verdicts; missing -> gate 0."""
    d = R.table(spark, sf_dir, "documents").select(
        F.col("source").alias("model"), F.col("doc_id").cast("string").alias("task_id"))
    lab = R.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("task_id"), (F.col("quality") == 1).alias("passed"))
    return M.attach_verdicts(d, lab, keys=["task_id"]).select("model", "task_id", "passed", "functional_correctness")


@register("unattempted", """SELECT CAST(d.doc_id AS VARCHAR) AS task_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def unattempted(spark, sf_dir):
    """J1 (anti join): tasks without any verdict."""
    d = R.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("task_id"))
    lab = R.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("task_id"))
    return M.unattempted(d, lab)


def _duck_eval() -> str:
    q = (
        "(CASE WHEN coalesce({c}, 0.0) > 0 THEN {c} ELSE 1.0 END)"
    )
    experts = ["avg_cyclomatic_complexity", "style_score", "efficiency_score", "loc_score"]
    prod = " * ".join(q.format(c=c) for c in experts)
    n = " + ".join(f"(CASE WHEN coalesce({c}, 0.0) > 0 THEN 1 ELSE 0 END)" for c in experts)
    return f"""WITH {_duck_blocks()}, {_duck_rules()},
base AS (
  SELECT d.source AS model, CAST(d.doc_id AS VARCHAR) AS task_id, lb.quality = 1 AS passed,
         1.0 - least(cc.avg_cc / 10.0, 1.0) AS avg_cyclomatic_complexity,
         1.0 - least(cc.max_cc / 10.0, 1.0) AS max_cyclomatic_complexity,
         least(rs.raw_score / 10.0, 1.0) AS style_score,
         CAST(NULL AS DOUBLE) AS efficiency_score,
         greatest(0.0, 1.0 - least({duck_loc('d.text')} / 50.0, 1.0)) AS loc_score,
         coalesce(CAST(lb.quality = 1 AS DOUBLE), 0.0) AS functional_correctness
  FROM documents d JOIN cc USING (doc_id) JOIN rs USING (doc_id) LEFT JOIN labels lb ON lb.doc_id = d.doc_id
)
SELECT model, task_id, passed,
       round(avg_cyclomatic_complexity, 6) AS avg_cyclomatic_complexity,
       round(max_cyclomatic_complexity, 6) AS max_cyclomatic_complexity,
       round(style_score, 6) AS style_score, efficiency_score, round(loc_score, 6) AS loc_score,
       functional_correctness,
       round(functional_correctness * coalesce(power(1.0 * {prod}, 1.0 / CAST(nullif({n}, 0) AS DOUBLE)), 0.0), 6) AS overall_score
FROM base"""


@register("evaluate_documents", _duck_eval())
def evaluate_documents(spark, sf_dir):
    """The whole scoring run on documents as completions: verdicts from labels,
    lexical complexity, rule style score, LOC, gated product of experts."""
    docs = R.table(spark, sf_dir, "documents").select(
        F.col("source").alias("model"), F.col("doc_id").cast("string").alias("task_id"),
        F.col("text").alias("completion"))
    out = M.evaluate(docs, _verdicts(spark, sf_dir), None, words=PROSE_WORDS, block_marker=PROSE_MARKER)
    return rounded(out)


def _verdicts(spark, sf_dir):
    return R.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("task_id"), (F.col("quality") == 1).alias("passed"))


@register("evaluate_samples", f"""
WITH e AS ({_duck_eval()}),
b AS (SELECT e.*, sample_id, CAST(task_id AS BIGINT) % 4 = 3 AS broken,
             CASE WHEN sample_id = 0 THEN e.passed ELSE CAST(task_id AS BIGINT) % 3 = 0 END AS ok
      FROM e, (SELECT unnest(range(0, 2)) AS sample_id)),
x AS (SELECT model, task_id, CAST(sample_id AS INTEGER) AS sample_id, ok AS passed,
             CASE WHEN NOT broken THEN avg_cyclomatic_complexity END AS avg_cyclomatic_complexity,
             CASE WHEN NOT broken THEN max_cyclomatic_complexity END AS max_cyclomatic_complexity,
             CASE WHEN broken THEN 0.0 ELSE style_score END AS style_score, loc_score FROM b)
SELECT model, task_id, sample_id, passed, avg_cyclomatic_complexity, max_cyclomatic_complexity, style_score, loc_score,
       coalesce(CAST(passed AS DOUBLE), 0.0) AS functional_correctness FROM x""")
def evaluate_samples(spark, sf_dir):
    """M1, M2, M4, J1 per sample: two samples of every document with their own verdicts (each
    recorded twice), a quarter of the texts not parsing: one row per sample."""
    docs = R.table(spark, sf_dir, "documents").select(
        F.col("source").alias("model"), F.col("doc_id").cast("string").alias("task_id"), F.col("text").alias("completion"),
        (F.col("doc_id") % 4 != 3).alias("parses")).withColumn("sample_id", F.explode(F.array(F.lit(0), F.lit(1))))
    keyed = R.table(spark, sf_dir, "documents").select(F.col("source").alias("model"), F.col("doc_id").cast("string").alias("task_id"), "doc_id")
    first = keyed.join(R.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select(
        "model", "task_id", F.lit(0).alias("sample_id"), (F.col("quality") == 1).alias("passed"))
    second = keyed.select("model", "task_id", F.lit(1).alias("sample_id"), (F.col("doc_id") % 3 == 0).alias("passed"))
    verdicts = first.unionByName(second)
    verdicts = verdicts.unionByName(verdicts)
    out = M.evaluate(docs, verdicts, None, words=PROSE_WORDS, block_marker=PROSE_MARKER, syntax_ok="parses")
    return rounded(out.drop("efficiency_score", "overall_score"))


def _models_values() -> str:
    return ", ".join(f"({_q(m)})" for m in P.DEFAULT_MODELS)


@register("prompt_table", f"""SELECT m.model, CAST(b.item_id AS VARCHAR) AS task_id, CAST(s.sample_id AS INTEGER) AS sample_id,
       {_q(P.PROMPT_PREFIX)} || b.text || {_q(P.PROMPT_SUFFIX)} AS prompt, translate(m.model, '/:', '__') AS safe_model
FROM benchmark b, (VALUES {_models_values()}) m(model), (SELECT unnest(range(1, 3)) AS sample_id) s""")
def prompt_table(spark, sf_dir):
    """Rendered prompts for every model x benchmark item x 2 samples."""
    b = R.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("task_id"), F.col("text").alias("prompt"))
    return P.prompt_table(b, samples_per_task=2)


def _duck_title(x: str) -> str:
    chars = f"string_split({x}, '')"
    prev = f"{chars}[i - 1]"
    return (f"array_to_string(list_transform({chars}, lambda c, i: CASE WHEN i > 1 AND upper({prev}) <> lower({prev}) "
            f"THEN lower(c) ELSE upper(c) END), '')")


@register("labels_pretty", f"""SELECT page_id, {_duck_title("replace(url, '_', ' ')")} AS label,
       translate(url, '/:', '__') AS safe_name FROM pages""")
def labels_pretty(spark, sf_dir):
    """P15 + K4: display label (mapped, else title case) and file-safe name of each URL."""
    g = R.table(spark, sf_dir, "pages")
    return g.select("page_id", display_label(F.col("url")).alias("label"), safe_name(F.col("url")).alias("safe_name"))


@register("json_mixed", f"""
WITH t AS (SELECT doc_id, doc_id % 7 AS k, {duck_clean("translate(text, '{}', '')")} AS clean FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN md5(clean) WHEN 1 THEN md5(clean) WHEN 6 THEN md5('d = {{"a": {{}}}}') END AS code_md5,
       CASE k WHEN 2 THEN 'no_code_field' WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'unclosed' WHEN 5 THEN 'no_object' END AS error FROM t""")
def json_mixed(spark, sf_dir):
    """T1-T3, T5 on mixed answers: code key, completion key, a number as code, single quotes, an
    unclosed object, no object, and braces inside the code."""
    plain = F.translate("text", "{}", "")
    wrap = lambda key: F.concat(F.lit("Sure: "), F.to_json(F.struct(plain.alias(key))), F.lit(" ok"))
    k = F.col("doc_id") % 7
    raw = (F.when(k == 0, wrap("code")).when(k == 1, wrap("completion")).when(k == 2, F.lit('say {"code": 12} ok'))
           .when(k == 3, F.lit("{'code': 'x'}")).when(k == 4, F.concat(F.lit('{"code": "'), plain)).when(k == 5, plain)
           .otherwise(F.lit('so {"code": "d = {\\"a\\": {}}"} and }')))
    d = R.table(spark, sf_dir, "documents").select("doc_id", TX.extract_strict(raw).alias("r"))
    return d.select("doc_id", F.md5("r.code").alias("code_md5"), F.col("r.error").alias("error"))
