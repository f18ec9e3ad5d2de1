"""Monte Carlo, quasi-Monte Carlo and variance-based sensitivity over inputs that are columns of seeded draws."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpforge.functions.random import Input, draw32, draws, halton, sobol, uniform
from kelpforge.operators.resampling import quantiles

Finding = Callable[[dict[str, Column]], Column]


def monte_carlo(spark: SparkSession, inputs: dict[str, Input], finding: Finding, n: int, seed: int, rows: DataFrame | None = None) -> DataFrame:
    """n rows: draw, every input, y. With rows (a column draw, which numbers them), each of them has a draw of its own, and the finding may use its columns too."""
    d = spark.range(n).withColumnRenamed("id", "draw") if rows is None else rows
    d = d.withColumns(draws(inputs, F.col("draw"), F.lit(seed)))
    return d.withColumn("y", finding({name: F.col(name) for name in inputs}))


def summary(rows: DataFrame, value: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, population sd, 5 %, 50 % and 95 % quantiles (interpolated), standard error; values that are not finite are an error.

    Quantiles come from distinct values dealt out by ranges, so no task holds all values."""
    v = F.col(value)
    v = F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.raise_error(F.lit("a value is not finite"))).otherwise(v)
    d = rows.select(F.struct(*by).alias("_by") if by else F.lit(0).alias("_by"), v.alias("_v"))  # groups by null keys are groups too
    found = (d.groupBy("_by") if by else d).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("sd"))
    found = found if by else found.withColumn("_by", F.lit(0))  # a row even where there are no values
    q = quantiles(d, ["_by"], "_v", {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    d = found.join(q, "_by", "left")
    return d.select(*[F.col("_by")[c].alias(c) for c in by], "n", "mean", "sd", "q05", "q50", "q95", F.try_divide(F.col("sd"), F.sqrt("n")).alias("stderr"))


def qmc_mean(spark: SparkSession, inputs: dict[str, Input], finding: Finding, n: int, seed: int, replicates: int = 16, sequence: str = "sobol", rows: DataFrame | None = None) -> DataFrame:
    """One row: mean over replicates of a point set that is shifted at random modulo 1, standard error and 90 % interval from their spread. With rows (a column id), each is a point."""
    names = list(inputs)
    d = (spark.range(n) if rows is None else rows).withColumn("_i", F.col("id") + 1)
    points = [sobol(F.col("_i"), j) for j in range(len(names))] if sequence == "sobol" else halton(F.col("_i"), len(names))
    d = d.select(*([] if rows is None else rows.columns), *[p.alias(f"_p{j}") for j, p in enumerate(points)], F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    shift = lambda j: uniform(F.lit(seed), F.col("replicate") * len(names) + j)
    d = d.withColumns({name: inputs[name].at(F.pmod(F.col(f"_p{j}") + shift(j), F.lit(1.0))) for j, name in enumerate(names)})
    means = d.withColumn("y", finding({name: F.col(name) for name in names})).groupBy("replicate").agg(F.avg("y").alias("y"), F.count("y").alias("n"))
    one = means.agg(F.avg("y").alias("mean"), (F.stddev_pop("y") / F.sqrt(F.count("y"))).alias("stderr"), F.sum("n").alias("evaluations"))
    return one.select("mean", "stderr", (F.col("mean") - 1.645 * F.col("stderr")).alias("lo"), (F.col("mean") + 1.645 * F.col("stderr")).alias("hi"), "evaluations")


def design(spark: SparkSession, inputs: dict[str, Input], finding: Finding, n: int, seed: int, sampler: str = "random", second_order: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """The evaluated design: row, a, b, and per input i ab_i (A with column i of B) and, for pairs, ba_i (B with column i of A). All columns of one row, so no join.
    With rows (a column row, which numbers them), each of them is a row of the design, and the finding may use its columns too."""
    names, k = list(inputs), len(inputs)
    d = spark.range(n).withColumnRenamed("id", "row") if rows is None else rows
    if sampler == "random":
        u = [uniform(F.lit(seed), F.col("row") * (2 * k) + j) for j in range(2 * k)]
    else:
        u = [sobol(F.col("row") + 1, j) for j in range(2 * k)]
    a = {name: inputs[name].at(u[j]) for j, name in enumerate(names)}
    b = {name: inputs[name].at(u[k + j]) for j, name in enumerate(names)}
    d = d.select(*d.columns, *[c.alias(f"_a_{n}") for n, c in a.items()], *[c.alias(f"_b_{n}") for n, c in b.items()])
    a, b = {n: F.col(f"_a_{n}") for n in names}, {n: F.col(f"_b_{n}") for n in names}
    out = [finding(a).alias("a"), finding(b).alias("b"), *[finding(a | {n: b[n]}).alias(f"ab_{n}") for n in names]]
    if second_order:
        out += [finding(b | {n: a[n]}).alias(f"ba_{n}") for n in names]
    return d.select("row", *out)


def _moments(rows: DataFrame) -> DataFrame:
    """One row: mean and population variance over a and b together."""
    both = rows.select(F.explode(F.array("a", "b")).alias("_y"))
    return both.agg(F.avg("_y").alias("_mean"), F.var_pop("_y").alias("_var"))


def sobol_indices(rows: DataFrame, names: list[str]) -> DataFrame:
    """input, first, total, and 90 % intervals from the spread of the rows' terms; rank by total. All 0 where the variance is 0."""
    d = rows.join(F.broadcast(_moments(rows)))  # one row
    terms = F.array(*[F.struct(F.lit(n).alias("input"), F.col(f"ab_{n}").alias("ab")) for n in names])
    d = d.select("a", "b", "_mean", "_var", F.inline(terms))
    total = F.try_divide((F.col("a") - F.col("ab")) * (F.col("a") - F.col("ab")), 2 * F.col("_var"))
    first = F.try_divide((F.col("b") - F.col("_mean")) * (F.col("ab") - F.col("a")), F.col("_var"))
    d = d.withColumn("_t", F.coalesce(total, F.lit(0.0))).withColumn("_s", F.coalesce(first, F.lit(0.0)))
    half = lambda c: 1.645 * F.stddev_pop(c) / F.sqrt(F.count(c))
    d = d.groupBy("input").agg(F.avg("_s").alias("first"), half("_s").alias("first_half"), F.avg("_t").alias("total"), half("_t").alias("total_half"))
    d = d.select("input", "first", "total", *[(F.col(v) + s * F.col(f"{v}_half")).alias(f"{v}_{e}") for v in ("first", "total") for e, s in (("lo", -1), ("hi", 1))])
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.col("total").desc(), "input")))  # a row per input


def second_order_indices(rows: DataFrame, names: list[str]) -> DataFrame:
    """input_a, input_b, interaction: what two inputs explain together beyond both alone."""
    d = rows.join(F.broadcast(_moments(rows)))
    first = lambda n: (F.col("b") - F.col("_mean")) * (F.col(f"ab_{n}") - F.col("a"))
    pair = lambda i, j: F.col(f"ba_{i}") * F.col(f"ab_{j}") - F.col("a") * F.col("b") - first(i) - first(j)
    rows = [F.struct(F.lit(i).alias("input_a"), F.lit(j).alias("input_b"), F.coalesce(F.try_divide(pair(i, j), F.col("_var")), F.lit(0.0)).alias("v")) for i, j in combinations(names, 2)]
    return d.select(F.inline(F.array(*rows))).groupBy("input_a", "input_b").agg(F.avg("v").alias("interaction"))


def bootstrap_indices(rows: DataFrame, names: list[str], resamples: int, seed: int, n: int) -> DataFrame:
    """input, total_lo, total_hi: 5 % and 95 % of totals over resampled rows. Which rows a resample takes is a column of seeded draws; rows carry how often they are taken."""
    taken = rows.sparkSession.range(resamples).select(F.col("id").alias("resample"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k"))
    taken = taken.select("resample", F.pmod(draw32(F.lit(seed), F.col("resample") * n + F.col("_k")), F.lit(n)).alias("row")).groupBy("resample", "row").count()
    d = rows.join(taken, "row")
    w = F.col("count")
    moments = d.groupBy("resample").agg(*[F.sum(w * (F.col(f"a") - F.col(f"ab_{i}")) * (F.col("a") - F.col(f"ab_{i}"))).alias(f"_t_{i}") for i in names], F.sum(w).alias("_n"), (F.sum(w * (F.col("a") + F.col("b"))) / (2 * F.sum(w))).alias("_m"), (F.sum(w * (F.col("a") * F.col("a") + F.col("b") * F.col("b"))) / (2 * F.sum(w))).alias("_q"))
    var = F.col("_q") - F.col("_m") * F.col("_m")
    long = moments.select("resample", F.inline(F.array(*[F.struct(F.lit(i).alias("input"), F.coalesce(F.try_divide(F.col(f"_t_{i}"), 2 * F.col("_n") * var), F.lit(0.0)).alias("total")) for i in names])))
    ranked = long.groupBy("input").agg(F.sort_array(F.collect_list("total")).alias("_v"))  # as long as there are resamples
    return ranked.select("input", F.element_at("_v", F.lit(1 + int(0.05 * resamples))).alias("total_lo"), F.element_at("_v", F.lit(min(resamples, 1 + -(-95 * resamples // 100) - 1))).alias("total_hi"))


def in_one_line(name: str, unit: str, summarised: DataFrame, indices: DataFrame) -> DataFrame:
    """One row, sentence: median and interval, and the input that drives the spread; two of them if the second's total is within 0.1."""
    top = indices.where("rank <= 2").groupBy().agg(F.sort_array(F.collect_list(F.struct("rank", "input", "total"))).alias("_t"))
    d = summarised.join(F.broadcast(top))
    one, two = F.col("_t")[0], F.try_element_at("_t", F.lit(2))
    drivers = F.when(two["total"].isNotNull() & (one["total"] - two["total"] < 0.1), F.concat_ws(" and ", one["input"], two["input"])).otherwise(one["input"])
    return d.select(F.format_string(f"{name}: %.3g {unit} (90 %% between %.3g and %.3g), driven by %s", "q50", "q05", "q95", drivers).alias("sentence"))
