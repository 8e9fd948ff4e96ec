import math
import random

import numpy as np

from scorelab.llm import embed_dedup


def brute(rows, t=0.95):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v) / max(map(abs, v))
        return x / np.sqrt((x * x).sum())
    u = [unit(v) for _, v in rows]
    n = len(rows)
    adj = [[b for b in range(n) if a != b and u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and u[a] @ u[b] >= t] for a in range(n)]
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in adj[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        c = min(ids) if ids else None
        out.append((rows[a][0], len(adj[a]), c, rows[a][0] is None or rows[a][0] == c))
    return sorted(out, key=str)


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    rnd = random.Random(4)
    g = lambda d=16: [rnd.gauss(0, 1) for _ in range(d)]
    rows, k = [], 0
    for n in [1] * 40 + [2] * 10 + [5] * 4 + [40]:
        base = g()
        for _ in range(n):
            rows.append((k, [x + rnd.gauss(0, .1) for x in base]))
            k += 1
    v = g()
    rows += [(k, v), (k + 1, v), (k + 1, v), (k + 2, [-x for x in v]), (k + 3, [3 * x for x in v]), (None, v), (k + 4, None), (k + 5, []),
             (k + 6, [0.0] * 16), (k + 7, [float("nan")] + v[1:]), (k + 8, [float("inf")] + v[1:]), (k + 9, [None] + v[1:]), (k + 10, [1.0, 2.0]),
             (k + 11, [1e200] * 16), (k + 12, [1e-200] * 16)]
    df = spark.createDataFrame([(a, b, 1, True) for a, b in rows], "vec_id long, embedding array<double>, n_links int, kept boolean")
    got = embed_dedup.vector_components(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == brute(rows)
    assert embed_dedup.vector_components(df.limit(0)).count() == 0


def test_plan():
    n = embed_dedup.plan_tables(0.95, 0.999, 1.0, 8)
    p = embed_dedup.hit_chance(math.sqrt(0.1), 1.0) ** 8
    assert 1 - (1 - p) ** n >= 0.999 and n < 200


def test_key_follows_size_and_distances():
    rng = np.random.default_rng(2)
    far, near = rng.normal(1.41, .1, 5000), rng.normal(1.0, .1, 5000)
    plans = [embed_dedup.plan_key(n, far, 0.95, 0.999, 2.0) for n in (10**3, 10**5, 10**7)]
    assert plans == sorted(plans) and plans[0][0] < plans[2][0]
    assert embed_dedup.plan_key(10**5, near, 0.95, 0.999, 2.0)[0] > plans[1][0]
    # strangers that a vector meets grow far more slowly than the table
    met = [n * t * np.mean([embed_dedup.hit_chance(d, 2.0) ** k for d in far]) for n, (k, t) in zip((10**3, 10**5, 10**7), plans)]
    assert met[2] < 10 * max(met[0], 1)
    p = embed_dedup.hit_chance(math.sqrt(0.1), 2.0)
    assert all(1 - (1 - p**k) ** t >= 0.999 for k, t in plans)
    assert embed_dedup.plan_key(0, np.zeros(0), 0.95, 0.999, 2.0)[1] >= 1


def test_long_keys_find_the_same_links(spark):
    rnd = random.Random(9)
    rows = []
    for g in range(60):
        base = [rnd.gauss(0, 1) for _ in range(16)]
        rows += [(10 * g + i, [x + rnd.gauss(0, .1) for x in base]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (None, 20):
        got = embed_dedup.vector_components(df, k=k).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == brute(rows)
