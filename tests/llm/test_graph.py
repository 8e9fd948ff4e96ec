import random

from scorelab.llm.graph import components


def test_chains_hubs_and_random_edges(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 130)]                      # a chain
    edges += [(1000 + rnd.randrange(1, 400), 1000) for _ in range(600)]   # a hub, edges twice and both ways
    edges += [(1000, 1000 + i) for i in range(1, 50)] + [(2000, 2000)]
    edges += [(3000 + rnd.randrange(200), 3000 + rnd.randrange(200)) for _ in range(120)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
