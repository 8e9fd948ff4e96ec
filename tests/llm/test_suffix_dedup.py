import hashlib
import random
from collections import Counter

import pytest

from scorelab.llm import suffix_dedup
from scorelab.llm.suffixes import repeated_windows


def brute(bodies, width):
    count = Counter(b[i:i + width] for b in bodies for i in range(len(b) - width + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_two_stage_sort():
    rnd = random.Random(2)
    for _ in range(200):
        width = rnd.choice([8, 9, 13, 24])
        alphabet = rnd.choice([b"ab", b"a", b"abc\x00", bytes(range(256)), b"\xff\x00"])
        base = bytes(rnd.choice(alphabet) for _ in range(60))
        rows = []
        for _ in range(rnd.randint(1, 8)):
            n = rnd.randint(1, 30)
            size = n + width - 1
            a = rnd.randint(0, 60 - min(60, size))
            rows.append((base[a:a + size] if size <= 60 and rnd.random() < .6 else bytes(rnd.choice(alphabet) for _ in range(size)), n))
        count = Counter(s[i:i + width] for s, n in rows for i in range(n))
        got = repeated_windows([s for s, _ in rows], [n for _, n in rows], width)
        assert [g.tolist() for g in got] == [[count[s[i:i + width]] > 1 for i in range(n)] for s, n in rows]


def fixture():
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdefghij é\n") for _ in range(n))
    passage, line = text(260), text(230)
    rows = [(i, text(rnd.randint(0, 900))) for i in range(60)]
    rows += [(100 + i, text(rnd.randint(0, 90)) + passage + text(rnd.randint(0, 90))) for i in range(40)]
    rows += [(200 + i, line + "\n" + text(100) + line[:210] + text(5) + line[20:]) for i in range(3)]
    same = text(400)
    rows += [(300, same), (301, same), (302, same[:-1]), (302, same[:-1]), (303, "x" * 199), (304, "x" * 199), (305, "y" * 900),
             (306, "ab" * 400), (307, None), (308, ""), (None, text(300)), (None, same), (309, text(60000)), (310, "\x00" * 450), (311, "z" * 200), (312, "z" * 200)]
    return rows


@pytest.mark.parametrize("hot", [500, 5])
def test_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = fixture()
    df = spark.createDataFrame([(i, t, "k", i) for i, t in rows], "doc_id long, text string, key string, id long")
    got = suffix_dedup.remove_repeats(df).collect()
    want = [(i, *b) for (i, _), b in zip(rows, brute([(t or "").encode() for _, t in rows], 200))]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
