"""Seeded fields of points against plain arithmetic, and folding at walls."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpforge.functions.random import draws32
from kelpforge.operators.neighbours import clustered_field, clustering_index, field, reflected


def u(seed, k):
    return draws32(seed, np.asarray(k, np.int64)) / 2.0**32


def test_uniform_field(spark):
    n, side = 50, (50 / 0.5) ** (1 / 3)
    i = np.arange(n)
    got = field(spark, n, 0.5, 7, speed=3.0, spread=5.0).orderBy("star").collect()
    for j, c in enumerate("xyz"):
        assert [r[c] for r in got] == pytest.approx((u(7, 3 * i + j) * side).tolist())
    assert [r["speed"] for r in got] == pytest.approx(np.maximum(0, 3.0 + (2 * u(7, 3 * n + i) - 1) * 5.0).tolist())


def test_clustered_field(spark):
    n, clumps, sigma, side = 60, 4, 0.2, (60 / 1.0) ** (1 / 3)
    i = np.arange(n)
    v = [u(9, 3 * clumps + 4 * i + j) for j in range(4)]
    r = [np.sqrt(-2 * np.log(np.maximum(v[k], 1e-12))) for k in (0, 2)]
    offsets = (r[0] * np.cos(2 * math.pi * v[1]), r[0] * np.sin(2 * math.pi * v[1]), r[1] * np.cos(2 * math.pi * v[3]))
    got = clustered_field(spark, n, 1.0, 9, clumps, sigma).orderBy("star").collect()
    for j, c in enumerate("xyz"):
        x = u(9, 3 * (i % clumps) + j) * side + offsets[j] * sigma * side
        t = np.mod(x, 2 * side)
        assert [p[c] for p in got] == pytest.approx(np.where(t > side, 2 * side - t, t).tolist())
    assert all(0 <= p[c] <= side for p in got for c in "xyz")


def test_clustered_fields_are_clustered(spark):
    n, side = 400, 400 ** (1 / 3)
    even = clustering_index(field(spark, n, 1.0, 11), side).first()
    clumped = clustering_index(clustered_field(spark, n, 1.0, 11, 8, 0.04), side).first()
    assert even["n"] == clumped["n"] == n and 0.85 < even["index"] < 1.2 and clumped["index"] < 0.7


def test_reflection(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (-0.3, 0.0, 1.0, 1.2, 2.0, 2.5, -3.7)], "x double").select(reflected(F.col("x"), 1.0)).collect()]
    assert got == pytest.approx([0.3, 0.0, 1.0, 0.8, 0.0, 0.5, 0.3])
