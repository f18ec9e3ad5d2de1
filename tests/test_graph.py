"""What a change reaches: long chains in few rounds, circles, graphs whose paths multiply, and names of what has changed."""

import random

import pytest

from kelpforge.operators import graph
from kelpforge.session import with_checkpoints


def reached(spark, pairs, changed, **how):
    with_checkpoints(spark)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = graph.reaching(edges, spark.createDataFrame([(c,) for c in changed], "node long"), **how).collect()
    assert len(got) == len({r[0] for r in got})
    return {r[0] for r in got}


def plain(pairs, changed):
    seen, todo = set(changed), list(changed)
    while todo:
        at = todo.pop()
        new = {s for s, t in pairs if t == at} - seen
        seen |= new
        todo += new
    return seen


def test_a_chain_of_10000_nodes_takes_20_rounds(spark):
    assert reached(spark, [(i + 1, i) for i in range(10_000)], [3], rounds=20) == set(range(3, 10_001))


def test_graphs(spark):
    rng = random.Random(4)
    circle = [(i, (i + 1) % 50) for i in range(50)]
    dense = [(rng.randrange(40), rng.randrange(40)) for _ in range(400)]
    sparse = [(rng.randrange(300), rng.randrange(300)) for _ in range(280)] + [(5, 5), (None, 3), (4, None)]
    for pairs in (circle, dense, sparse):
        sound = [(s, t) for s, t in pairs if s is not None and t is not None]
        assert reached(spark, pairs, [7, 9]) == plain(sound, [7, 9])
    assert reached(spark, sparse, [7, 9], growth=0) == plain([p for p in sparse if None not in p], [7, 9])  # hop by hop
    assert reached(spark, [], [1]) == {1}
    with pytest.raises(RuntimeError, match="deeper"):
        reached(spark, [(i + 1, i) for i in range(40)], [0], rounds=3)


def test_impact(spark):
    with_checkpoints(spark)
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("e", "d"), ("x", "y")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcdexy"], "node string")
    packages = spark.createDataFrame([("pkg_b", "b")], "package string, node string")
    for tokens, want in ((["pkg_b"], "bc"), ([" d "], "de"), (["src/e/a/file.py", "zz"], "e"), (["a", "pkg_b", "", "  "], "abc"), ([], ""), ([None, "none"], "")):
        t = spark.createDataFrame([(x,) for x in tokens], "token string")
        assert "".join(sorted(r[0] for r in graph.impact(edges, t, "token", nodes, "node", packages).collect())) == want


def test_depths(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (3, 1)], "src long, dst long").withColumn("from", F.lit(1).cast("long"))
    other = spark.createDataFrame([(9, 8)], "src long, dst long").withColumn("from", F.lit(8).cast("long"))
    a, b = graph.depth_reached(one, F.col("from"), 2), graph.depth_reached(other, F.col("from"), 5)  # two at a time
    assert {tuple(r) for r in a.collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)} and {tuple(r) for r in b.collect()} == {(8, 0), (9, 1)}
