import random

from scorelab.llm import ngram_join
from scorelab.llm.shingles import bands_for, shingle_sets


def brute(rows, t=0.8):
    def sh(text):
        w = (text or "").encode().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    sets = [sh(x) for _, x in rows]
    n = len(rows)
    adj = [[] for _ in range(n)]
    for a in range(n):
        for b in range(a):
            u = len(sets[a] | sets[b])
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * u - 1e-9:
                adj[a].append(b)
                adj[b].append(a)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in adj[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        out.append((rows[a][0], min(ids) if ids else None, len(adj[a])))
    return sorted(out, key=str)


def fixture():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(30):
        base = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        for _ in range(rnd.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 2])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((k, " ".join(t)))
            k += 1
    base = [rnd.choice(words) for _ in range(150)]
    for _ in range(60):   # one large group of near copies
        t = list(base)
        t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((k, "\n".join(t)))
        k += 1
    rows += [(k, ""), (k + 1, None), (k + 2, "two words"), (k + 3, "two  words"), (k + 3, "two  words"), (None, "two words"),
             (None, "alone here"), (k + 9, " \t\n"), (k + 10, "é " * 9)]
    return rows


def test_brute_force(spark, monkeypatch):
    rows = fixture()
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, c string, class_id int")
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    got = ngram_join.ngram_classes(df).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)


def test_empty_and_bands(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_classes(df).count() == 0
    b, r = bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**r) ** b >= 0.9999 and b * r <= 128
    assert len(shingle_sets([b"a b c d e a b c d e"])[0]) == 5
