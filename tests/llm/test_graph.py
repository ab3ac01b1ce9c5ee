import random

from ocuspark.llm.graph import components


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    return {frozenset(x for x in up if find(x) == r) for r in {find(x) for x in up}}


def test_components_of_chains_stars_and_chance(spark):
    key = lambda i: i.to_bytes(4, "big")
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(300)]  # in order, the worst case of a smallest neighbour
    edges += [(1000, 1001 + i) for i in range(300)] + [(2300 - i, 2300) for i in range(1, 300)]
    edges += [(3000 + rng.randrange(200), 3000 + rng.randrange(200)) for _ in range(150)] + [(5, 4), (7, 7), (4, 5)]
    df = spark.createDataFrame([(bytearray(key(a)), bytearray(key(b))) for a, b in edges], "a binary, b binary")
    found = {bytes(r.node): bytes(r.component) for r in components(df).collect()}
    groups = {}
    for node, c in found.items():
        groups.setdefault(c, set()).add(node)
    assert all(c in members for c, members in groups.items())
    assert {frozenset(g) for g in groups.values()} == union_find([(key(a), key(b)) for a, b in edges if a != b])
    assert components(df.limit(0)).collect() == []
