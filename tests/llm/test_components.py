"""Components against plain union-find, with and without hubs of their own."""

import random

import pytest

from kelpforge.llm.components import Forest, connected_components


@pytest.mark.parametrize("hub", [3, 20_000])
def test_components(spark, hub):
    rng = random.Random(hub)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]  # sparse
    edges += [(1000, 1001 + i) for i in range(60)] + [(2100 - i, 2100) for i in range(1, 60)]  # a small and a large hub
    edges += [(i, i + 1) for i in range(3000, 3040)] + [(5, 5), (7, 6), (7, 6)]  # a chain, a loop, repeats
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["_node"]: r["_root"] for r in connected_components(spark.createDataFrame(edges, "_a long, _b long"), hub=hub).collect()}
    assert got == {x: forest.root(x) for x in nodes}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "_a long, _b long")).collect() == []
