import zlib

import numpy as np
from pyspark.sql import functions as F

from scorelab.llm import toxicity as t

SF = "/root/testdata/sf0.1"


def planted(n=4000, seed=3):
    """A latent label, noisy given labels, and voters: two telling ones, one that knows nothing, a copy of the first, four more."""
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < 0.2
    y = np.where(rng.random(n) < 0.95, truth, ~truth).astype(float)
    hit = lambda p, q: np.where(truth, rng.random(n) < p, rng.random(n) < q)
    a, b, c = hit(.6, .01), hit(.5, .02), hit(.5, .5)
    more = [hit(.5, .02) for _ in range(4)]
    return truth, y, np.column_stack([a, b, c, a, *more]).astype(float)


def test_label_model_finds_rates():
    truth, y, votes = planted()
    m = t.label_model(votes, y, kinds=1, anchor=0)
    free = np.flatnonzero(m["parent"] == votes.shape[1])
    for c, rows in enumerate((~truth, truth)):
        assert np.allclose(m["rates"][0, c, free], votes[rows][:, free].mean(0), atol=0.05)
    assert np.allclose(m["accuracy"], [truth[v > 0].mean() for v in votes.T], atol=0.1)
    assert abs(m["base"][1] - truth.mean()) < 0.03
    # posteriors come from the votes: they mend most of the given labels that are wrong
    wrong = y != truth
    assert ((m["posterior"] > 0.5) == truth).mean() > 0.95 and ((m["posterior"] > 0.5) == truth)[wrong].mean() > 0.9


def test_label_model_likelihood_rises():
    _, y, votes = planted(1500, 8)
    for trace in t.label_model(votes, y)["objective"]:
        assert len(trace) > 1 and all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))


def test_copied_voter_adds_nothing():
    _, y, votes = planted()
    m = t.label_model(votes, y, kinds=1)
    assert m["parent"][3] == 0 or m["parent"][0] == 3
    alone = t.label_model(np.delete(votes, 3, 1), y, kinds=1)
    assert np.abs(m["posterior"] - alone["posterior"]).mean() < 0.01


def test_kinds_keep_rare_insults_toxic():
    """Two languages whose insults never meet; texts of the rarer one have one or two votes."""
    rng = np.random.default_rng(5)
    kind = rng.choice(3, 5000, p=[.9, .08, .02])
    rates = np.where(kind[:, None] == 1, [.5] * 8 + [0] * 3, np.where(kind[:, None] == 2, [0] * 8 + [.5] * 3, .002))
    votes = (rng.random(rates.shape) < rates).astype(float)
    y = np.where(rng.random(5000) < 0.98, kind > 0, kind == 0).astype(float)
    m = t.label_model(votes, y)
    seen = votes.sum(1) > 0
    for k in (1, 2):
        assert (m["posterior"][(kind == k) & seen] > 0.5).mean() > 0.9
    assert (m["posterior"][kind == 0] > 0.5).mean() < 0.02


def test_given_labels_only_anchor_the_class():
    truth, y, votes = planted()
    rng = np.random.default_rng(1)
    other = np.where(rng.random(len(y)) < 0.9, truth, ~truth).astype(float)
    assert np.allclose(t.label_model(votes, y, kinds=1, anchor=0)["posterior"], t.label_model(votes, other, kinds=1, anchor=0)["posterior"], atol=0.05)
    # with the prior too, documents of equal votes have equal posteriors, whatever their own label
    post, of = t.label_model(votes, y)["posterior"], {}
    for v, p, label in zip(map(bytes, votes.astype(np.uint8)), post, y):
        of.setdefault(v, []).append((p, label))
    assert any(len({label for _, label in rows}) == 2 for rows in of.values())
    assert all(max(rows)[0] - min(rows)[0] < 1e-9 for rows in of.values())
    assert t.label_model(votes[:0], y[:0])["posterior"].shape == (0,)


def test_held_out_and_cases(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = t.train(docs, labels)
    got = t.score(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 500 and np.mean([r.predicted == r.toxic for r in held]) > 0.97
    assert sum(r.predicted for r in held if r.toxic == 0) <= 3
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "fine words", 0.5), (3, "fine " * 300000, 0.5), (4, "You Idiot, you STUPID pathetic moron!", 0.5),
                                 (4, "You Idiot, you STUPID pathetic moron!", 0.5), (5, "x" * 500000, 0.5)], "doc_id long, text string, score double")
    out = t.score(odd, model).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert [r.predicted for r in out if r.doc_id == 4] == [1, 1] and not any(r.predicted for r in out if r.doc_id != 4)
    assert t.score(odd.limit(0), model).count() == 0
    assert {r.predicted for r in t.score(odd, t.train(docs.limit(0), labels)).collect()} == {0}


def test_held_out_labels_do_not_count(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = t.train(docs, labels), t.train(docs, changed)
    assert a["terms"] == b["terms"] and np.allclose(a["weights"], b["weights"]) and a["bias"] == b["bias"]
