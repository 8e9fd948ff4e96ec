import random
import re

from pyspark.sql import functions as F

from scorelab.llm import mixing


def docs(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        source = rnd.choice(["a", "a", "a", "b", "c", "é", None])
        rows.append((i, " ".join("w" * rnd.randint(1, 5) for _ in range(rnd.randint(0, 60))), source, i))
    rows += [(None, "x y", "a", 1), (7, None, "b", 2), (7, None, "b", 2), (8, "\x0b\t one\x0c", "tiny", 3), (9, "", "empty", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size int")


def test_targets_and_taken(spark):
    rows, df = docs(spark)
    out = mixing.allocate(df).select("doc_id", "text", "source", "mix_size", "mix_source_size", "mix_target", "mix_copies").collect()
    assert len(out) == len(rows)
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(names, mixing.share_out([size[s] for s in names], [[3, 1, 2][i % 3] for i in range(len(names))], 1.5 * sum(size.values()), 2)))
    assert abs(sum(want.values()) - 1.5 * sum(size.values())) < 1e-6
    taken = dict.fromkeys(names, 0)
    for r in out:
        assert r.mix_size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.mix_source_size == size[r.source] and abs(r.mix_target - want[r.source]) < 1e-6
        assert len(r.mix_copies) <= 2 and all(0 <= c.shard < 64 for c in r.mix_copies)
        taken[r.source] += r.mix_size * len(r.mix_copies)
    for s in names:
        assert abs(taken[s] - want[s]) <= 60, (s, taken[s], want[s])
    again = mixing.allocate(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.allocate(df).collect()))


def test_mix_rows(spark):
    _, df = docs(spark)
    a = mixing.allocate(df).select(F.sum(F.size("mix_copies")).alias("n")).first().n
    m = mixing.mix(df, shards=8)
    assert m.count() == mixing.allocate(df, shards=8).select(F.sum(F.size("mix_copies")).alias("n")).first().n == a
    per = {r["mix_shard"]: r["n"] for r in m.groupBy("mix_shard").agg(F.count("*").alias("n")).collect()}
    assert set(per) == set(range(8)) and max(per.values()) < 2 * min(per.values())
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.allocate(df.limit(0)).count() == 0


def test_share_and_split():
    assert mixing.share_out([10, 10, 10], [3, 1, 2], 45, 2) == [20.0, 25 / 3, 50 / 3]
    tree = mixing.split_quotas([100, 7, 0, 33], 6, 1)
    assert [sum(x) for x in zip(*tree)] == [100, 7, 0, 33]
    assert max(map(sum, tree)) - min(map(sum, tree)) <= 2


def test_repeated_rows_come_within_one_row_of_the_target(spark):
    """A source that is one row many times, and one in which it is a third of all rows."""
    rows = [(1, "two words", "a")] * 100 + [(i, "w " * (i % 9 + 1), "b") for i in range(60)] + [(9, "x y z", "b")] * 40 + [(None, None, "c")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for share in (0.4, 0.75, 1.2, 1.5):
        out = mixing.allocate(df, share=share).collect()
        assert len(out) == len(rows)
        for source, largest in (("a", 2), ("b", 9)):
            mine = [r for r in out if r.source == source]
            assert abs(sum(r.mix_size * len(r.mix_copies) for r in mine) - mine[0].mix_target) <= largest
            assert all(len(r.mix_copies) <= 2 for r in mine)
        assert mixing.mix(df, share=share).count() == sum(len(r.mix_copies) for r in out)


def test_the_mix_follows_the_tree(spark, monkeypatch):
    """Each shard draws its quota from the tree: another tree gives other shards, an empty one an empty mix."""
    _, df = docs(spark)
    tree, held = mixing.split_quotas, []
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n, s: held.append(tree(q, n, s)) or held[-1])
    blocks = {}
    for r in mixing.allocate(df, shards=8).collect():
        for c in r.mix_copies:
            blocks.setdefault(c.shard, set()).add((r.source, c["pass"], r.doc_id))
    assert set(blocks) == {s for s, quota in enumerate(held[0]) if sum(quota)}
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n, s: [list(q)] + [[0] * len(q)] * (n - 1))
    assert {c.shard for r in mixing.allocate(df, shards=8).collect() for c in r.mix_copies} == {0}
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n, s: [[0] * len(q)] * n)
    assert mixing.mix(df, shards=8).count() == 0
