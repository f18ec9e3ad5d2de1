"""What only larger tables show: numbers with exponents, probabilities below the smallest double, crowded places, plans that hold a table in one task."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpforge.functions import random
from kelpforge.operators import growth, paired, resampling, surrogates, uncertainty
from kelpforge.plans import catalogue
from kelpforge.sources.files import scenario_files
from kelpforge.sources.scenarios import parts


def plan(df):
    return df._jdf.queryExecution().toString()


def test_summaries_hold_no_table_in_one_task(spark):
    """quantiles by distinct values and counts, with null groups, null values and no rows."""
    rng = np.random.default_rng(3)
    data = [(g, v) for g in ("a", "b", None) for v in rng.normal(size=101 + len(g or "")).round(1).tolist()] + [("a", None), ("c", None)]
    rows = spark.createDataFrame(data, "g string, v double").repartition(5)
    got = uncertainty.summary(rows, "v", ("g",))
    assert "percentile(" not in plan(got)
    found = {r["g"]: r for r in got.collect()}
    assert found.keys() == {"a", "b", "c", None} and (found["c"]["n"], found["c"]["q50"]) == (0, None)
    for g in ("a", "b", None):
        v = [x for h, x in data if h == g and x is not None]
        assert [found[g][c] for c in ("n", "mean", "sd", "q05", "q50", "q95")] == pytest.approx([len(v), np.mean(v), np.std(v), *np.quantile(v, [0.05, 0.5, 0.95])])
    one = uncertainty.summary(rows.where("g is null"), "v").first()
    assert one["q50"] == found[None]["q50"] and one.asDict().keys() == {"n", "mean", "sd", "q05", "q50", "q95", "stderr"}
    assert uncertainty.summary(rows.limit(0), "v").first()["n"] == 0
    with pytest.raises(Exception, match="not finite"):
        uncertainty.summary(rows.withColumn("v", F.lit(float("nan"))), "v").collect()


def test_numbers_with_exponents(spark, tmp_path):
    """F2: Spark writes doubles from 1e7 on with an exponent without a sign, which YAML 1.1 takes as text."""
    numbers = {"a": "1.107516E7", "b": "1e7", "c": "-2.5e+8", "d": "1.0E-4", "e": ".5e1"}
    (tmp_path / "s.yaml").write_text("name: x\nsubsystems:\n" + "".join(f"  - {{name: {n}, mass_kg: {v}}}\n" for n, v in numbers.items()))
    got = {r["name"]: r["mass_kg"] for r in parts(scenario_files(spark, str(tmp_path / "s.yaml"))).collect()}
    assert got == {n: float(v) for n, v in numbers.items()}
    (tmp_path / "t.yaml").write_text("name: 1E7x\nsubsystems: [{name: '1E7'}]")
    assert [tuple(r) for r in parts(scenario_files(spark, str(tmp_path / "t.yaml"))).select("scenario", "name").collect()] == [("1E7x", "1E7")]


def test_signs_of_many(spark):
    """2^-n is 0 in doubles from n = 1,075 on; the probabilities are not."""
    cases = [(0, 0), (1, 1), (3, 10), (5, 10), (40, 60), (990, 2000), (1000, 2000), (2400, 5000), (4800, 9500), (0, 3000), (49_700, 100_000)]

    def exact(k, n):
        k, term, total = min(k, n - k), 1, 0
        for i in range(k + 1):
            total, term = total + term, term * (n - i) // (i + 1)
        return float(min(Fraction(1), Fraction(2 * total, 2**n)))

    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", paired.sign_p(F.col("k"), F.col("n")).alias("p")).collect()
    assert {(r["k"], r["n"]): r["p"] for r in rows} == {c: pytest.approx(exact(*c), rel=1e-9, abs=1e-300) for c in cases}


def test_surrogates_are_evaluated_in_batches(spark):
    """no expression is evaluated again for every term; nulls stay null."""
    bases = {"a": surrogates.Basis("uniform", -1, 3), "b": surrogates.Basis("normal", 2, 0.5)}
    terms = tuple(surrogates.multi_indices(2, 3))
    fitted = surrogates.Surrogate(bases, 3, terms, tuple(0.5 + i for i in range(len(terms))), 9, 0.0)
    data = [(0.1 * i - 1, 1 + 0.05 * i) for i in range(40)] + [(None, 1.0), (1.0, None)]
    got = fitted.predicted(spark.createDataFrame(data, "a double, b double"))
    assert "lambda" not in plan(got)
    a, b = (bases[c].table(np.array([x[i] for x in data[:40]]), 3) for i, c in enumerate("ab"))
    want = sum(c * a[i] * b[j] for (i, j), c in zip(terms, fitted.coefficients, strict=True))
    rows = got.collect()
    assert [r["predicted"] for r in rows[:40]] == pytest.approx(want.tolist()) and [r["predicted"] for r in rows[40:]] == [None, None]
    assert got.columns == ["a", "b", "predicted"]


def test_points_of_large_indices(spark):
    """digits by whole numbers (doubles lose them beyond 2^53), in batches."""
    index = [0, 1, 2, 7, 1_000_003, 2**53 + 1, 2**60 + 12_345, 2**63 - 1]
    d = spark.createDataFrame([(i,) for i in [*index, None]], "i long").coalesce(1)
    for base in (2, 3, 5, 7):
        got = [r[0] for r in d.select(random.radical_inverse(F.col("i"), base)).collect()]
        want = []
        for i in index:
            x, f = Fraction(0), Fraction(1, base)
            while i:
                i, digit = divmod(i, base)
                x, f = x + digit * f, f / base
            want.append(float(x))
        assert got[:-1] == pytest.approx(want, rel=1e-14, abs=0) and got[-1] is None


def test_draws_are_counted_in_stretches(spark):
    """rows that leave the counting tasks grow with the root of a group's size; stretches and chunks meet."""
    n = 70_001
    groups = spark.createDataFrame([(1, n, 9), (2, 3, 5)], "_g long, _n long, _seed long")
    resampling.with_checkpoints(spark)
    assert resampling._stretches(groups, 4).count() == 8
    want = {}
    for g, size, seed in ((1, n, 9), (2, 3, 5)):
        for r in range(4):
            drawn = np.sort(random.draws32(seed, r * size + np.arange(size)) % np.int64(size))
            want[g, r] = sorted([drawn[(size - 1) // 2], drawn[size // 2]])
    got = {}
    for r in resampling.middle(groups, 4).collect():
        got.setdefault((r["_g"], r["_r"]), []).append(r["_pos"])
    assert {k: sorted(v) for k, v in got.items()} == want
    assert [len(x) for x in resampling._drawn(n, 9, 1, 0)] == [resampling.CHUNK, n - resampling.CHUNK]


def test_grids_stay_with_their_runs(spark, monkeypatch):
    """F8: runs are dealt out before days are added, so many a task; windows over runs move nothing."""
    monkeypatch.setattr(growth, "GRID_ROWS", 500)
    p = catalogue.growth_parameters(spark, "/root/testdata/sf0.001").limit(40)
    grid = growth.grid(p)
    assert grid.rdd.getNumPartitions() == -(-p.count() * 151 // 500)
    spans = growth.spans(grid, ["run"], ["step"], "regime", "day")
    assert spans._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert growth.grid(p.limit(0)).count() == 0
