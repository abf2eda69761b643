import random

from laminae.operators import selection


def _graph(seed):
    rng = random.Random(seed)
    edges = {}
    for _ in range(60):
        a, b = rng.randrange(25), rng.randrange(25)
        if a != b:
            edges[min(a, b), max(a, b)] = rng.randrange(1, 9)
    return [(a, b, float(w)) for (a, b), w in edges.items()]


def test_accepted_matches_the_walk(spark):
    edges = _graph(1)
    ranks = list(range(25))
    random.Random(2).shuffle(ranks)
    near = {k: {b for a, b, _ in edges if a == k} | {a for a, b, _ in edges if b == k} for k in range(25)}
    want = set()
    for k in sorted(range(25), key=lambda k: ranks[k]):
        if not near[k] & want:
            want.add(k)
    nodes = spark.createDataFrame(list(enumerate(ranks)), "id long, rank long")
    got = selection.accepted(nodes, spark.createDataFrame([e[:2] for e in edges], "a long, b long"))
    assert {r.id for r in got.collect()} == want


def test_forest_and_offsets(spark):
    edges = _graph(3)
    root = list(range(25))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = set()
    for a, b, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b))
    got = selection.spanning_forest(spark.createDataFrame(edges, "a long, b long, weight double"))
    rows = {(r.a, r.b) for r in got.collect()}
    assert rows == want
    place = {k: k * k for k in range(25)}
    steps = spark.createDataFrame([(a, b, place[b] - place[a]) for a, b in want], "a long, b long, step long")
    assert all(r.offset == place[r.id] - place[r.root] for r in selection.tree_offsets(steps).collect())
