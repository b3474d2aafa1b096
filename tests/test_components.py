import random

from tessera.operators.components import connected_components


def plain(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_match_plain_labels(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 300 + i) for i in range(1, 40)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + edges[:3], "u long, v long")).collect()}
    assert got == plain(edges)


def test_components_of_nothing(spark):
    rows = [(None, 1), (2, 2), (3, None)]
    assert connected_components(spark.createDataFrame(rows, "u long, v long")).count() == 0
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0
