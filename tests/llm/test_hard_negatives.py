"""Hard negatives: against brute force, certain intervals, ties, nulls, odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelab.llm import hard_negatives as hn
from scorelab.llm.queries import QUERIES
from tests.conftest import SF001

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string"


def brute(rows, anchor=lambda i: i % 10 == 0, positives=5, negatives=10, least=30, most=90):
    """(anchor, positive, rank, negative, positive score, negative score) in plain Python."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    chosen = {}
    for i, v, label in good:
        if i is not None and anchor(i):
            chosen[i] = min(chosen.get(i, (label, v)), (label, v))
    for i, (label, v) in chosen.items():
        order = lambda r: (-r[0], r[1] is None, r[1] or 0)
        scored = [(sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in good if len(w) == len(v)]
        near = sorted((r for r in scored if r[2] == label and r[1] != i), key=order)[:positives]
        for ps, j, _ in near:
            far = sorted((r for r in scored if r[2] != label and least * ps <= 100 * r[0] <= most * ps), key=order)[:negatives]
            out += [(i, j, n + 1, r[1], ps, r[0]) for n, r in enumerate(far)]
    return sorted(out, key=str)


def mined(df, **options):
    out = hn.hard_negatives(df, F.col("vec_id") % 10 == 0, **options)
    return sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def clustered(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, dim)) + 1
    label = rng.integers(0, labels, n)
    x = centres[label] * rng.uniform(0, 1, (n, 1)) + rng.standard_normal((n, dim)) * 0.6
    return [(i, [float(np.float32(y)) for y in v], int(c)) for i, (v, c) in enumerate(zip(x / 8, label))]


@pytest.mark.parametrize("dim,levels", [(64, 4), (64, 1), (7, 3), (130, 2), (320, 4)])
def test_equals_brute_force(spark, monkeypatch, dim, levels):
    monkeypatch.setattr(hn, "TILES", [16, 32])
    rows = clustered(300, dim, dim)
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA).repartition(5)
    assert mined(df, levels=levels) == brute(rows)


def test_groups_of_anchors_and_slabs(spark, monkeypatch):
    for name, value in (("ANCHORS", 7), ("BLOCK_ROWS", 20), ("SLAB_BYTES", 4000)):
        monkeypatch.setattr(hn, name, value)
    rows = clustered(300, 16, 3)
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    assert mined(df, positives=3, negatives=4, least=0, most=100) == brute(rows, positives=3, negatives=4, least=0, most=100)


def test_nulls_ties_repeats_zero_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [0.5, 0.0], 2),
            (4, [0.5, 0.0], 2), (4, [0.5, 0.0], 2), (None, [0.5, 0.0], 2), (5, [0.9, 0.0], 2), (6, [0.91, 0.0], 2), (7, [0.3, 0.0], 2), (8, [0.29, 0.0], 2),
            (9, None, 1), (11, [1.0, None], 1), (12, [1.0, nan], 2), (13, [inf, 0.0], 2), (14, [1.0, 0.0], None), (15, [], 1), (10, [], 1), (16, [], 2),
            (20, [0.0, 0.0], 1), (21, [0.5], 2), (30, [-1.0, 0.0], 2), (40, [-1.0, 0.0], 2), (50, [1.0, 2.0, 3.0], 5), (50, [1.0, 2.0, 2.0], 4), (51, [1.0, 2.0, 3.0], 4)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    expected = brute(rows)
    assert mined(df) == expected and any(r[1] is None for r in expected) and any(r[3] is None for r in expected)


def test_empty_table_and_no_anchor(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1, None), (2, [1.0], 2, None)], SCHEMA)) == []


def test_scores_that_might_not_fit_fail(spark):
    with pytest.raises(Exception, match="64 bits"):
        mined(spark.createDataFrame([(0, [1e30], 1, None), (1, [1.0], 1, None)], SCHEMA))


@pytest.mark.parametrize("dim,levels", [(64, 1), (64, 4), (100, 3), (512, 2)])
def test_intervals_hold_every_score(dim, levels):
    rng = np.random.default_rng(dim + levels)
    ints = np.floor(rng.standard_normal((400, dim)) * rng.choice([1, 50, 3000], (400, 1))).astype(np.int64)
    ints[3] = 0
    ints[5] = ints[4] * 2
    turn = hn.rotation(dim, 1)
    assert np.allclose(turn @ turn.T, np.eye(dim))
    lo, hi = hn.Anchors(ints[:40], turn).interval(slice(0, 40), *hn.encode(ints, turn, levels))
    score = ints[:40] @ ints.T
    assert (lo <= score).all() and (score <= hi).all()
    if levels == 4:   # tight enough to be of use: a quarter of the range of scores at most
        size = np.linalg.norm(ints[:40], axis=1)[:, None] * np.linalg.norm(ints, axis=1)[None, :]
        assert np.median((hi - lo)[size > 0] / (2 * size[size > 0])) < 0.25


def test_codes_filter_most_pairs():
    """Past the first tile, few pairs are scored exactly."""
    rows = clustered(6000, 64, 9, labels=10)
    ints = hn.scaled([r[1] for r in rows], 256.0)
    turn = hn.rotation(64, 11)
    ids, labels = np.arange(len(rows)), np.array([r[2] for r in rows])
    a = slice(0, 20)
    scored = []
    einsum, np.einsum = np.einsum, lambda *x: (scored.append(len(x[1])), einsum(*x))[1]
    try:
        low, high = np.full((20, 1), hn.LEAST), np.full((20, 1), hn.MOST)
        hn.best(hn.Anchors(ints[a], turn), labels[a], ids[a], low, high, [(ids, np.ones(len(ids), bool), labels, ints, *hn.encode(ints, turn, 4))], 5, True)
    finally:
        np.einsum = einsum
    same = int((labels[a, None] == labels[None]).sum())
    assert sum(scored) < same / 2


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"])
            for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    out = QUERIES["op11_hard_negatives"](spark, SF001)
    got = sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)
    assert got == brute(rows, anchor=lambda i: i % 100 == 0)
