"""Prefix trie of rebuilt conversations: against plain Python, collisions, long and odd conversations."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from scorelab.llm import conv_trie
from scorelab.llm.queries import QUERIES
from tests.conftest import SF001, SF01

SCHEMA = "conv_id bigint, turn bigint, role string, text string, d int, s1 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Rows of the trie of (conv, turn, role, text) rows, from whole rebuilt conversations."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(
        f"{len(x[1].encode())}\n{x[1]}{x[2]}".encode()).digest()))] for c, v in convs.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rest = abs(c) % 100 * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(c - rest, [])[:h] + own[c][h:])
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    below = {n: [m for m in nodes if m[:len(n)] == n] for n in nodes}
    out = []
    for n, members in nodes.items():
        children = lambda m: sum(len(x) == len(m) + 1 for x in below[m])
        ends = ",".join(str(c) for c in sorted(c for c in members if rebuilt[c] == n))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), children(n), sum(children(m) == 0 for m in below[n]),
                    sum((len(nodes[m]) - 1) * (len(m[-1][1]) if m else 0) for m in below[n]), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(df, **options):
    out = conv_trie.prefix_trie(df, lambda c: c - c % 100, lambda c: F.crc32(c.cast("string").cast("binary")) % 6, 5, **options)
    return sorted(map(tuple, out.select(*COLUMNS).collect()), key=str)


def made(n, seed, ids=300):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-ids, 2 * ids), n):
        for turn in range(rnd.randint(1, 9)):
            rows.append((c, turn, rnd.choice(["user", "assistant"]), rnd.choice(["", "a", "bé", "🙂🙂", "long text " * 5])))
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)


def test_equals_brute_force(spark):
    rows = made(120, 1)
    assert trie(frame(spark, rows)) == brute(rows)


def test_collisions_are_found_and_done_again(spark, monkeypatch):
    """With a small modulus fingerprints collide; the result stays right."""
    tries = []
    prefixes = conv_trie.prefixes
    monkeypatch.setattr(conv_trie, "prefixes", lambda *a: tries.append(1) or prefixes(*a))
    rows = made(12, 2, 60)
    assert trie(frame(spark, rows), prime=13) == brute(rows)
    assert len(tries) > 1


def test_unlucky_modulus_fails_and_gives_nothing_wrong(spark):
    with pytest.raises(RuntimeError, match="colliding"):
        trie(frame(spark, [(c, 0, "user", f"text {c}") for c in range(100, 200)]), prime=5)


def test_equal_digests_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(conv_trie.F, "sha2", lambda c, n: F.lit("00"))
    rows = [(c, t, "user", f"{c % 3} {t}") for c in range(100, 112) for t in range(4)]
    assert trie(frame(spark, rows)) == brute(rows)


def test_long_conversations_many_ends_and_small_runs(spark, monkeypatch):
    monkeypatch.setattr(conv_trie, "RUN", 3)
    monkeypatch.setattr(conv_trie, "CHUNK", 4)
    rows = [(c, t, "user", "same") for c in range(200, 240) for t in range(7)] + [(1, t, "user", "same") for t in range(60)]
    assert trie(frame(spark, rows)) == brute(rows)


def test_nulls_ties_repeats_and_missing_bases(spark):
    rows = [(100, None, None, None), (100, 0, "user", "b"), (100, 0, "user", "a"), (100, 0, "user", "a"), (101, 1, "", ""), (102, 3, "user", "x"),
            (7, 0, "user", "only"), (None, 0, "user", "lost"), (-5, 0, "user", "a"), (-105, 2, None, "z"), (-100, 1, "user", "long " * 20000)]
    assert trie(frame(spark, rows)) == brute(rows)


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, 0, "user", "x") for c in range(5000, 5020) if c % 100]
    expected = brute(rows)
    assert trie(frame(spark, rows)) == expected and expected[0][1] == 0
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in expected)


def test_empty_table(spark):
    assert trie(frame(spark, [])) == []


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = QUERIES["op13_conv_trie"](spark, sf)
    assert sorted(map(tuple, out.select(*COLUMNS).collect()), key=str) == brute(rows)
