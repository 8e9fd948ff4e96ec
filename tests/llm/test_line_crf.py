import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelab.llm import line_crf as crf

SF = "/root/testdata/sf0.01"


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    pair, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    score, counts = rng.normal(size=(3, 5)), np.array([5, 1, 3])
    p, expected = crf.forward_backward(score, counts, pair, start)
    for r, n in enumerate(counts):
        z, good, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product([0, 1], repeat=int(n)):
            w = np.exp(start[y[0]] + sum(score[r, t] * y[t] for t in range(n)) + sum(pair[y[t - 1], y[t]] for t in range(1, n)))
            z += w
            good += w * np.array(y)
            for t in range(1, n):
                moves[y[t - 1], y[t]] += w
        assert np.allclose(p[r, :n], good / z) and np.allclose(expected[r], moves / z)


def test_held_out_accuracy_and_cases(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = crf.train(docs, labels)
    got = crf.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    odd = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (None, "x", 5.0), (1, None, 5.0), (3, "word " * 200000, 5.0), (4, "a line\n" * 20000, 5.0), (5, "\n \n", 5.0)],
                                "doc_id long, text string, score double")
    out = crf.score(odd, model).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.score == pytest.approx(model["prior"]) for r in out if r.doc_id in (1, 2, 5))
    assert crf.score(odd.limit(0), model).count() == 0
    none = crf.train(docs, labels.limit(0))
    assert {r.score for r in crf.score(odd, none).collect()} == {0.5}


def test_labels_of_the_fold_and_other_columns_do_not_count(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    changed = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = crf.train(docs, labels), crf.train(docs, changed)
    assert np.allclose(a["w"], b["w"]) and a["prior"] == b["prior"]


def test_batches_agree():
    rnd = random.Random(2)
    texts = ["\n".join("".join(rnd.choice("ab C|.$é ") for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(0, 20))).encode() for _ in range(150)]
    x, _, _ = crf.line_features(texts)
    model = {"w": np.random.default_rng(0).normal(size=x.shape[1]), "pair": np.eye(2), "start": np.zeros(2), "mean": 0.0, "scale": 1.0, "prior": 0.4}
    together = crf.predict(model, texts)
    assert np.allclose(together, [crf.predict(model, [t])[0] for t in texts], atol=1e-4)


def test_slopes_against_enumeration():
    """Slopes of a document's score are covariances, here summed over every labelling of the lines."""
    rng = np.random.default_rng(3)
    pair, start, score, counts = rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=(2, 4)), np.array([4, 3])
    weight = rng.uniform(1, 3, (2, 4)) * (np.arange(4)[None, :] < counts[:, None])
    weight /= weight.sum(1, keepdims=True)
    q, by_line, by_move = crf.slopes(score, counts, weight, pair, start)
    for r, n in enumerate(counts):
        ys = [np.array(y) for y in itertools.product([0, 1], repeat=int(n))]
        z = np.array([np.exp(start[y[0]] + (score[r, :n] * y).sum() + sum(pair[a, b] for a, b in zip(y, y[1:]))) for y in ys])
        z /= z.sum()
        f = np.array([(weight[r, :n] * y).sum() for y in ys])
        moves = np.array([[[sum((a, b) == (i, j) for a, b in zip(y, y[1:])) for j in (0, 1)] for i in (0, 1)] for y in ys])
        mean = (z * f).sum()
        assert q[r] == pytest.approx(mean)
        assert np.allclose(by_line[r, :n], (z[:, None] * (f - mean)[:, None] * np.array(ys)).sum(0), atol=1e-5)
        assert np.allclose(by_move[r], (z[:, None, None] * (f - mean)[:, None, None] * moves).sum(0), atol=1e-5)


def test_lines_are_latent():
    """Fitted on documents' labels alone, where every document holds lines of both kinds, the lines are told apart."""
    rnd = random.Random(4)
    fine = lambda: " ".join(rnd.choice(["the", "cat", "sat", "on", "a", "warm", "mat"]) for _ in range(9)) + "."
    junk = lambda: " ".join("".join(rnd.choice("#$%&|<>0189") for _ in range(6)) for _ in range(8))
    texts, labels, kinds = [], [], []
    for i in range(400):
        y, n = i % 2, rnd.randint(5, 12)
        block = rnd.randint(1, max(1, n // 4)) if y else n - rnd.randint(1, max(1, n // 4))
        at = rnd.randint(0, n - block)
        kinds.append([0 if at <= k < at + block else 1 for k in range(n)])
        texts.append("\n".join(fine() if k else junk() for k in kinds[-1]).encode())
        labels.append(y)
    x, size, counts = crf.line_features(texts)
    ends = np.cumsum(counts)[:-1]
    model = crf.fit(list(zip(np.split(x, ends)[:300], np.split(size, ends)[:300], labels[:300])))
    p, _ = crf.marginals(model, texts[300:])
    right = np.concatenate([(a > 0.5) == np.array(k, bool) for a, k in zip(p, kinds[300:])])
    assert right.mean() > 0.95
    assert sum((a.min() < 0.5) & (a.max() > 0.5) for a in p) > 90


def test_bad_block_in_a_good_document_is_found(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = crf.train(docs, labels)
    joined = docs.join(labels, "doc_id").where("text is not null").orderBy("doc_id").collect()
    lines = lambda y: [r.text.split("\n") for r in joined if r.quality == y and len(r.text.split("\n")) >= 6]
    bad = [r.text.split("\n")[0] for r in joined if r.quality == 0 and len(r.text) > 100][:6]
    found = 0
    for good in lines(1)[:10]:
        p, size = crf.marginals(model, ["\n".join(good[:3] + bad + good[3:]).encode()])
        whole = crf.marginals(model, ["\n".join(good).encode()])[0][0]
        found += p[0][4:8].mean() < whole.mean() - 0.25
    assert found >= 8


def test_no_document_is_left_out_for_its_length(spark, monkeypatch):
    rows = [(i, ("good words in a line\n" if i % 2 else "#$ %% && ||\n") * (5000 if i == 3 else 4), i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(crf, "fit", lambda found: seen.append([len(x) for x, _, _ in found]))
    crf.train(docs, labels)
    crf.train(docs, labels, lines=20)
    assert max(seen[0]) == 5000 and 0 < len(seen[1]) < len(seen[0])


def test_one_very_long_text_beside_short_ones():
    import tracemalloc

    model = {"w": np.ones(3 * crf.N_OWN + 3) / 50, "pair": np.eye(2), "start": np.zeros(2), "mean": np.zeros(3 * crf.N_OWN + 3), "scale": np.ones(3 * crf.N_OWN + 3), "prior": 0.4}
    texts = [b"a short line\nand one more"] * 63 + [b"x\n" * 120_000]
    tracemalloc.start()
    out = crf.predict(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 64 and peak < 160 << 20
    assert len(crf.groups(np.array([1] * 100 + [10**6, 5]))) == 3
