"""The nearest of sparse points, and in boxes that repeat, against brute force."""

import random

import pytest

from kelpforge.operators.neighbours import nearest


def test_far_neighbours_are_found(spark):
    at = [(i, (i % 7) * 0.01, (i % 5) * 0.01, 0.0) for i in range(30)] + [(30, 5.0, 5.0, 5.0), (31, -3.0, 0.0, 40.0)]
    points = spark.createDataFrame([(*p, None) for p in at], "star long, x double, y double, z double, settled_year double")
    queries = spark.createDataFrame([(*p, 0.0, True, [p[0]]) for p in at], "query long, x double, y double, z double, year double, instant boolean, excluded array<long>")
    for k in (1, 3, 40):  # more than there are: all of them
        want = {}
        for q in at:
            d = sorted((sum((a - b) ** 2 for a, b in zip(q[1:], p[1:], strict=True)), p[0]) for p in at if p[0] != q[0])
            want[q[0]] = [s for _, s in d[:k]]
        got = {}
        for r in nearest(queries, points, k, cell=0.02).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r["star"])
        assert got == want


def brute(at, k, side):
    def apart(a, b):
        d = a - b
        return d - round(d / side) * side

    want = {}
    for q in at:
        d = sorted((sum(apart(a, b) ** 2 for a, b in zip(q[1:], p[1:], strict=True)), p[0]) for p in at if p[0] != q[0])
        want[q[0]] = [s for _, s in d[:k]]
    return want


@pytest.mark.parametrize(("k", "cell", "block"), [(1, None, 2000), (3, 0.3, 2000), (3, 0.6, 7), (5, 0.05, 2000), (60, None, 9)])
def test_boxes_that_repeat(spark, k, cell, block):
    """Points at the walls, one cell an axis, two, three and many; points that lie outside are met in their box."""
    rng = random.Random(3)
    at = [(i, *(rng.uniform(-0.5, 1.5) for _ in range(3))) for i in range(40)] + [(40, 0.001, 0.5, 0.5), (41, 0.999, 0.5, 0.5), (42, 1.0, 0.0, 1.0), (43, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame([(*p, None) for p in at], "star long, x double, y double, z double, settled_year double")
    queries = spark.createDataFrame([(*p, 0.0, True, [p[0]]) for p in at], "query long, x double, y double, z double, year double, instant boolean, excluded array<long>")
    got = {}
    for r in nearest(queries, points, k, cell, side=1.0, block=block).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["star"])
    want = brute(at, k, 1.0)
    assert got.keys() == want.keys() and all(set(got[q]) == set(want[q]) for q in want) and got[40][0] == 41 and got[41][0] == 40
