import random

from paperloom.llm.components import components


def plain(edges):
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in list(parent))


def test_paths_stars_and_random_graphs(spark):
    rng = random.Random(3)
    cases = [
        [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(99, i) for i in range(50)], [(3, 3), (None, 4), (5, None)],
        [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] * 2, [],
    ]
    for edges in cases:
        frame = spark.createDataFrame(edges, "a long, b long")
        assert sorted((r["node"], r["component"]) for r in components(frame).collect()) == plain(edges)
