"""Surrogates of functions whose moments and indices are known, and of rows that cannot be fitted."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpforge.functions.random import Input
from kelpforge.operators.surrogates import Basis, control_variate, fit, indices, moments, multi_indices, of_inputs, relative_residual

POLY = {"a": Input("uniform", -1, 1), "b": Input("normal", 2, 0.5), "c": Input("fixed", 3)}


def poly(x):
    """1 + 2 a + 3 (b - 2) + a (b - 2): mean 1, variance 4/3 + 9/4 + 1/12."""
    return x["c"] - 2 + 2 * x["a"] + 3 * (x["b"] - 2) + x["a"] * (x["b"] - 2)


def test_a_polynomial_is_met_exactly(spark):
    for degree in (2, 4):
        s = of_inputs(spark, POLY, poly, degree, 3000, 1)
        assert s.residual < 1e-9 and s.trustworthy() and s.n == 3000 and len(s.terms) == math.comb(degree + 2, 2)
        m = moments(s.table(spark)).first()
        all_ = 4 / 3 + 9 / 4 + 1 / 12
        assert (m["mean"], m["variance"], m["sd"]) == pytest.approx((1, all_, math.sqrt(all_)), abs=1e-8)
        got = {r["input"]: (r["first"], r["total"]) for r in indices(s.table(spark), list(s.bases)).collect()}
        assert got["a"] == pytest.approx((4 / 3 / all_, (4 / 3 + 1 / 12) / all_), abs=1e-8) and got["b"] == pytest.approx((9 / 4 / all_, (9 / 4 + 1 / 12) / all_), abs=1e-8)
        rows = spark.createDataFrame([(0.3, 1.7, 3.0), (-0.9, 2.4, 3.0), (None, 2.0, 3.0)], "a double, b double, c double")
        for r in s.predicted(rows).collect():
            assert r["predicted"] is None if r["a"] is None else r["predicted"] == pytest.approx(poly(r), abs=1e-9)


def test_ishigami(spark):
    """Known in closed form; the third input acts only together with the first."""
    inputs = {n: Input("uniform", -math.pi, math.pi) for n in ("x1", "x2", "x3")}
    s = of_inputs(spark, inputs, lambda x: F.sin(x["x1"]) + 7 * F.sin(x["x2"]) ** 2 + 0.1 * x["x3"] ** 4 * F.sin(x["x1"]), 10, 8000, 1)
    d = 49 / 8 + 0.1 * math.pi**4 / 5 + 0.01 * math.pi**8 / 18 + 0.5
    v1, v2, v13 = 0.5 * (1 + 0.1 * math.pi**4 / 5) ** 2, 49 / 8, 8 * 0.01 * math.pi**8 / 225
    assert moments(s.table(spark)).first()["variance"] == pytest.approx(d, rel=5e-3)
    got = {r["input"]: (r["first"], r["total"]) for r in indices(s.table(spark), list(inputs)).collect()}
    want = {"x1": (v1 / d, (v1 + v13) / d), "x2": (v2 / d, v2 / d), "x3": (0, v13 / d)}
    assert all(got[n] == pytest.approx(want[n], abs=5e-3) for n in inputs)


def test_a_kink_is_told_and_steadied(spark):
    """Where the surrogate is not to be trusted, the control variate is unbiased all the same."""
    inputs = {"a": Input("uniform", -1, 1)}
    kink = lambda x: F.abs(x["a"] - 0.2)
    s = of_inputs(spark, inputs, kink, 4, 2000, 1)
    assert not s.trustworthy()
    from kelpforge.operators.uncertainty import monte_carlo

    fresh = monte_carlo(spark, inputs, kink, 4000, 2)
    assert relative_residual(fresh, s, "y").first()["residual"] > 0.01
    r = control_variate(fresh, s, "y").first()
    assert r["lo"] - 0.002 < 0.52 < r["hi"] + 0.002 and r["variance_ratio"] > 20 and r["n"] == 4000


def test_as_numpy_has_it(spark):
    """Rows in many partitions, some empty, some with nulls, of a column that no polynomial meets."""
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, (500, 2))
    y = np.exp(x[:, 0] / 5) + rng.normal(size=500)
    rows = spark.createDataFrame([(*map(float, p), float(v), "x") for p, v in zip(x, y, strict=True)] + [(None, 1.0, 1.0, "x"), (1.0, 1.0, None, "x")], "p double, q double, y double, _y string").repartition(40)
    bases = {"p": Basis("uniform", 0, 10), "q": Basis("normal", 5, 3)}
    s = fit(rows, bases, 3, "y")
    tables = [b.table(x[:, i], 3) for i, b in enumerate(bases.values())]
    design = np.stack([tables[0][a] * tables[1][b] for a, b in s.terms], axis=1)
    want, _, rank, _ = np.linalg.lstsq(design, y)
    assert rank == 10 and s.n == 500 and s.coefficients == pytest.approx(want.tolist(), rel=1e-9, abs=1e-9)
    assert s.residual == pytest.approx(np.sqrt(np.mean((design @ want - y) ** 2)) / y.std(), rel=1e-9)
    assert relative_residual(rows, s, "y").first()["residual"] == pytest.approx(s.residual, rel=1e-9)


def test_what_cannot_be_fitted(spark):
    rows = spark.range(50).select((F.col("id") % 2).cast("double").alias("a"), F.lit(1.0).alias("y"))
    with pytest.raises(ValueError, match="full rank"):
        fit(rows, {"a": Basis("uniform", 0, 1)}, 3, "y")
    with pytest.raises(ValueError, match="too few"):
        fit(rows.limit(2), {"a": Basis("uniform", 0, 1)}, 3, "y")
    with pytest.raises(ValueError, match="too few"):
        fit(rows.limit(0), {"a": Basis("uniform", 0, 1)}, 3, "y")
    with pytest.raises(Exception, match="not finite"):
        fit(rows.withColumn("y", F.lit(float("inf"))), {"a": Basis("uniform", 0, 1)}, 1, "y")
    constant = fit(rows, {"a": Basis("uniform", 0, 1)}, 1, "y")
    assert constant.coefficients == pytest.approx((1, 0), abs=1e-12)
    with pytest.raises(ValueError, match="terms"):
        multi_indices(50, 5)
    for family, p1, p2 in (("loguniform", 1, 2), ("uniform", 2, 2), ("normal", 0, 0)):
        with pytest.raises(ValueError):
            Basis(family, p1, p2)
    assert multi_indices(30, 2)[0] == (0,) * 30 and len(multi_indices(30, 2)) == math.comb(32, 2)
