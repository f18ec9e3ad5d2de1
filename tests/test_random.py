"""Quantiles of normal inputs against the standard library, and defaults."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from kelpforge.functions.random import Input, directions, halton, normal_quantile, sobol, uniform64
from kelpforge.sources.scenarios import with_defaults


def test_normal_quantile(spark):
    us = [0.0, 1e-300, 1e-15, 1e-9, 0.01, 0.0749, 0.075, 0.3, 0.5, 0.7, 0.925, 0.926, 0.99, 1 - 1e-9, 1.0, *[i / 997 for i in range(1, 997)]]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in us], "u double").select(normal_quantile(F.col("u"))).collect()]
    want = [NormalDist().inv_cdf(min(max(u, 1e-15), 1 - 1e-15)) for u in us]
    assert got == pytest.approx(want, rel=1e-13, abs=1e-13)
    odd = [r[0] for r in spark.createDataFrame([(None,), (float("nan"),)], "u double").select(normal_quantile(F.col("u"))).collect()]
    assert odd[0] is None and math.isnan(odd[1])


def test_normal_and_lognormal_inputs(spark):
    u = spark.range(1, 1000).select((F.col("id") / 1000).alias("u"))
    n, x = Input("normal", 10, 2), Input("lognormal", 3, 1.5)
    for r in u.select("u", n.at(F.col("u")).alias("n"), x.at(F.col("u")).alias("x")).collect():
        z = NormalDist().inv_cdf(r["u"])
        assert r["n"] == pytest.approx(10 + 2 * z) and r["x"] == pytest.approx(3 * 1.5**z)


def test_defaults(spark):
    got = with_defaults(spark.createDataFrame([(1, None), (2, 5.0)], "run int, rate double"), {"rate": 20.0, "mass": 7.0}).orderBy("run").collect()
    assert [tuple(r) for r in got] == [(1, 20.0, 7.0), (2, 5.0, 7.0)]


def splitmix64(seed, k):
    z = (seed + (k + 1) * 0x9E3779B97F4A7C15) % 2**64
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
    return (z ^ (z >> 31)) / 2.0**64


def test_uniform64(spark):
    got = spark.range(200).select("id", uniform64(F.lit(42).cast("long"), F.col("id")).alias("u")).collect()
    assert all(r["u"] == splitmix64(42, r["id"]) for r in got)


def test_points_beyond_their_tables_are_errors(spark):
    with pytest.raises(ValueError):
        halton(F.lit(1), 22)
    with pytest.raises(ValueError):
        directions(21)
    with pytest.raises(Exception, match="index of a point"):
        spark.range(1).select(sobol(F.lit(1 << 30), 0)).collect()
