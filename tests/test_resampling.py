"""Medians of resamples against sorting every one of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpforge.functions.random import draw32, draws32
from kelpforge.operators import resampling as r


def plain(values, resamples, seed):
    v = np.sort(np.array(values, float))
    return [float(np.median(v[draws32(seed, k * len(v) + np.arange(len(v))) % np.int64(len(v))])) for k in range(resamples)]


def test_draws(spark):
    got = [x[0] for x in spark.range(300).select(draw32(F.lit(12345), F.col("id") * 99_991)).collect()]
    assert got == draws32(12345, np.arange(300) * 99_991).tolist()


def groups():
    rng = np.random.default_rng(1)
    return {"a": rng.normal(size=101).tolist(), "b": [7.0] * 40, "c": [1.0], "d": rng.integers(0, 5, 200).astype(float).tolist(), "e": [2.0, 1.0], "f": []}


def frame(spark):
    rows = [(g, v) for g, vs in groups().items() for v in vs] + [("a", None), ("f", None), (None, 1.0)]
    return spark.createDataFrame(rows, "g string, v double").repartition(7)


def test_medians(spark):
    got = {x["g"]: x for x in r.bootstrap_median(frame(spark), ["g"], "v", 50, 3).collect()}
    want = {g: sorted(plain(v, 50, 3)) for g, v in groups().items() if v}
    assert {g: (x["median"], x["lo"], x["hi"]) for g, x in got.items()} == {g: (float(np.median(groups()[g])), m[1], m[48]) for g, m in want.items()}
    assert r.bootstrap_median(frame(spark).limit(0), ["g"], "v", 5, 3).collect() == []


def test_many_draws(spark):
    """More values than are drawn at a time."""
    rows = spark.range(150_001).select(F.lit(1).alias("g"), F.pmod(F.col("id") * 48_271, F.lit(99_991)).cast("double").alias("v"))
    got = sorted(x["_m"] for x in r.resampled_medians(rows, ["g"], "v", 3, F.lit(9)).where("_r >= 0").collect())
    assert got == sorted(plain([x[0] for x in rows.select("v").collect()], 3, 9))


def test_slopes(spark):
    rng = np.random.default_rng(2)
    data = {1.0: rng.normal(3, 1, 30).tolist(), 2.0: rng.normal(5, 1, 41).tolist(), 4.5: rng.normal(9, 2, 20).tolist()}
    rows = spark.createDataFrame([(x, v) for x, vs in data.items() for v in vs] + [(1.0, None), (None, 2.0)], "x double, v double")
    slope = lambda ms: float(np.polyfit(list(data), ms, 1)[0])
    ms = [plain(v, 40, 5 + i) for i, v in enumerate(data.values())]
    want = sorted(slope(m) for m in zip(*ms, strict=True))
    got = r.slope_of_medians(rows, "x", "v", 40, 5).first()
    assert (got["slope"], got["lo"], got["hi"]) == pytest.approx((slope([np.median(v) for v in data.values()]), want[1], want[39]))
    nothing = [(0.0, 0.0, 0.0)]
    assert [tuple(x) for x in r.slope_of_medians(rows.where("x = 1"), "x", "v", 5).collect()] == nothing
    assert [tuple(x) for x in r.slope_of_medians(rows.limit(0), "x", "v", 5).collect()] == nothing
    assert [tuple(x) for x in r.slope_of_medians(rows.unionByName(spark.createDataFrame([(9.0, None)], "x double, v double")), "x", "v", 5).collect()] == nothing
