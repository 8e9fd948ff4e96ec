import collections
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from scorelab.llm import bpe, toxicity
from test_ngram_join import brute as brute_classes
from test_suffix_dedup import fixture

SF = "/root/testdata/sf0.001"
COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in cp.STAGES:
        before = docs
        docs = f(spark, docs, SF)
        if f is not cp.STAGES[-1][1]:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
            docs = spark.createDataFrame(docs.toPandas().astype(object).where(lambda x: x.notna(), None).values.tolist(), docs.schema).persist()
        out.append((before, docs))
    return out


def test_names():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_join", "suffix_dedup", "mixing", "bpe"]


def test_toxicity_stage(spark, stages):
    before, after = stages[0]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(before, model).where("predicted = 1").collect()}
    assert rows_of(after) == rows_of(before.where(~F.col("doc_id").isin(list(bad)))) and after.count() < before.count()


def test_ngram_stage(stages):
    before, after = stages[1]
    first = {c for i, c, _ in brute_classes([(r.doc_id, r.text) for r in before.collect()])}
    assert rows_of(after) == [r for r in rows_of(before) if r[0] in first]


def test_suffix_stage(stages):
    before, after = stages[2]
    texts = {r.doc_id: r.text.encode() for r in before.collect()}
    at = collections.Counter(t[i:i + 200] for t in texts.values() for i in range(len(t) - 199))
    for r in after.collect():
        t = texts[r.doc_id]
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if at[t[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        assert r.text == bytes(x for x, g in zip(t, gone) if not g).decode("utf-8", "ignore")
        assert r.n_chars == len(r.text) or not any(gone)
    assert after.count() == before.count()


def test_mix_stage(stages):
    before, after = stages[3]
    have = collections.Counter(rows_of(before))
    times = collections.Counter(rows_of(after))
    assert set(times) <= set(have) and all(times[r] <= 2 * have[r] for r in times)
    words = lambda rs: sum(len((r[1] or "").split()) * n for r, n in rs.items())
    assert abs(words(times) / words(have) - 1.5) < 0.05


def test_last_stage_and_run(spark, stages):
    before, after = stages[4]
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((r.doc_id, own.encode_ordinary(r.text or "")) for r in before.collect())
    assert sorted((r.doc_id, list(r.ids)) for r in after.collect()) == want
    assert rows_of(cp.run(spark, SF).select("doc_id", "ids_sha256")) == rows_of(after.select("doc_id", "ids_sha256"))


def test_odd_rows(spark):
    rnd = random.Random(1)
    rows = [(i, t, None if n % 5 == 0 else f"s{n % 3}", None, None, "x") for n, (i, t) in enumerate(fixture())]
    rows += [(1, "You pathetic stupid idiot", "s1", "en", 3, "y"), (400, "same words in this one row", "s1", "en", 3, "y"), (400, "same words in this one row", "s1", "en", 3, "z"),
             (401, "", "s1", "en", 0, None), (401, "", "s1", "en", 0, None), (None, "same words in this one row", "s2", "en", 1, None),
             (402, " ".join(rnd.choice(["a", "bc"]) for _ in range(200000)), "s0", "en", 1, None)]
    docs = spark.createDataFrame([(a, b, e, c, d, f) for a, b, c, e, d, f in rows], "doc_id long, text string, lang string, source string, n_chars long, c string")
    for clash in ("_id", "_key", "_row", "_h", "mix_pass", "mix_size", "toxic", "text_", "kept", "key", "id", "body"):
        docs = docs.withColumn(clash, F.concat(F.lit("own "), F.lit(clash)))
    sizes = []
    for name, f in cp.STAGES:
        out = f(spark, docs, SF)
        assert f(spark, docs.limit(0), SF).count() == 0
        if name != "bpe":
            assert out.columns == docs.columns
            assert out.where("_id <> 'own _id' or mix_pass <> 'own mix_pass' or _row <> 'own _row' or kept <> 'own kept'").count() == 0
            docs = out.persist()
        sizes.append(out.count())
        if name == "ngram_join":
            left = [r.doc_id for r in docs.where("text = 'same words in this one row'").collect()]
            assert left == [400] and docs.where("doc_id = 401").count() == 2
    assert sizes[0] <= len(rows) and sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[4] == sizes[3]
