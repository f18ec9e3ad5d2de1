"""Statistics of paired experiments: differences, sign tests, slopes, plateaus, sweeps and shards."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpforge.operators.resampling import positioned


def percent_change(treated: Column, base: Column) -> Column:
    """Null where either is null or the base is 0."""
    return 100 * F.try_divide(treated - base, base)


def paired(runs: DataFrame, keys: Sequence[str], mode: str, treated: str, base: str, values: Sequence[str]) -> DataFrame:
    """keys, value_base, value_treated: runs of two modes that share their keys."""
    a = runs.where(F.col(mode) == base).select(*keys, *[F.col(v).alias(f"{v}_base") for v in values])
    b = runs.where(F.col(mode) == treated).select(*keys, *[F.col(v).alias(f"{v}_treated") for v in values])
    return a.join(b, list(keys))


def _ln_factorial(n: Column) -> Column:
    """By Stirling's series at n + 12, whose next term is below 2e-13."""
    z = n + F.lit(12.0)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    below = reduce(lambda a, i: a * (n + float(i)), range(2, 12), n + 1.0)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(below)


def sign_p(positive: Column, nonzero: Column) -> Column:
    """Two-sided binomial p of so many positive ones: C(n, k) / 2^n by logarithms, as 2^-n alone is 0 in doubles from n = 1,075 on, times the sum of what smaller k have relative to it.

    Their ratios are a running product of odds. 8 sqrt(n) + 64 of them are added: after m steps it is below exp(-m^2 / n), so all n that may follow are below n exp(-64) of the sum, less than half a unit
    in its last place for any n below 1e11.
    """
    k, n = F.least(positive, nonzero - positive), nonzero.cast("double")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] * (k - j) / (n - k + j + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    steps = F.least(k, F.ceil(8 * F.sqrt(n)) + 64).cast("int")
    tail = F.aggregate(F.when(steps >= 1, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")), start, step, lambda s: s["sum"])
    first = F.exp(_ln_factorial(n) - _ln_factorial(k.cast("double")) - _ln_factorial(n - k) - n * math.log(2))
    return F.when(nonzero == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * first * tail))


def summarised(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, median, quartiles by index (n / 4 and 3 n / 4, rounded down), mean, signs and p of the values that are not null.

    Distinct values with counts and places are all that is looked at: no group is held.
    """
    v, first, c, n = (F.col(x) for x in ("_v", "_first", "_c", "_n"))
    d = positioned(rows.select(*by, F.col(value).alias("_v")), by, "_v")
    at = lambda i: F.max(F.when((first <= i) & (i < first + c), v))
    d = d.groupBy(*by).agg(
        F.max(n).alias("n"), at(F.expr("(_n - 1) div 2")).alias("_low"), at(F.expr("_n div 2")).alias("_high"), at(F.expr("_n div 4")).alias("q1"), at(F.expr("3 * _n div 4")).alias("q3"), F.sum(v * c).alias("_sum"),
        F.coalesce(F.sum(F.when(v > 0, c)), F.lit(0)).alias("positive"), F.coalesce(F.sum(F.when(v != 0, c)), F.lit(0)).alias("nonzero"),
    )
    return d.select(*by, "n", ((F.col("_low") + F.col("_high")) / 2).alias("median"), "q1", "q3", (F.col("_sum") / F.col("n")).alias("mean"), "positive", "nonzero", sign_p(F.col("positive"), F.col("nonzero")).alias("p"))


def slope(rows: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares slope, 0 where x does not vary; and the slope through the origin, null where all x are 0."""
    x_, y_ = F.col(x), F.col(y)
    return rows.groupBy(*by).agg(F.coalesce(F.regr_slope(y_, x_), F.lit(0.0)).alias("slope"), F.try_divide(F.sum(x_ * y_), F.sum(x_ * x_)).alias("through_origin"))


def plateau(ladder: DataFrame, by: Sequence[str], k: str, value: str, threshold: float) -> DataFrame:
    """The smallest k whose value at 2 k grows by less than the threshold (relative), and null where none does."""
    b = ladder.select(*by, (F.col(k) / 2).alias(k), F.col(value).alias("_next"))
    grows = F.try_divide(F.col("_next") - F.col(value), F.col(value))
    found = ladder.join(b, [*by, k], "left")
    return found.groupBy(*by).agg(F.min(F.when(grows < threshold, F.col(k))).alias("plateau"))


def plateau_report(ladder: DataFrame, by: Sequence[str], k: str, value: str, threshold: float) -> DataFrame:
    """Each rung with its difference from the rung before (null at the first), and the plateau of its ladder (null where there is none)."""
    steps = ladder.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(k)))
    return steps.join(plateau(ladder, by, k, value, threshold), list(by))


def record(rows: DataFrame, by: Sequence[str], order: Sequence[str], at: str, counts: dict[str, Column], shares: Sequence[int] = (25, 50, 75, 90, 99, 100)) -> DataFrame:
    """A row per run: n, how often each condition holds, and t25, t50, ...: where the run has had that share (in percent) of its rows, in their order."""
    d = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    reached = [F.min_by(F.when(F.col("_k") * 100 >= F.col("_n") * p, F.col(at)), F.when(F.col("_k") * 100 >= F.col("_n") * p, F.col("_k"))).alias(f"t{p}") for p in shares]
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in counts.items()], *reached)


def bounce_depth(wasted: Column, n: Column) -> Column:
    """Arrivals in vain for each place; no places are an error."""
    return F.when(n > 0, wasted / n).when(n.isNotNull(), F.raise_error(F.lit("the number of places must be positive")).cast("double"))


def median_bounce_depth(records: DataFrame, by: Sequence[str], wasted: str, n: str) -> DataFrame:
    d = records.select(*by, bounce_depth(F.col(wasted), F.col(n)).alias("_b"))
    return d.groupBy(*by).agg(F.median("_b").alias("bounce_depth"))


def unpivoted(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return rows.unpivot(list(keys), list(metrics), "metric", "value")


def shard_rows(rows: DataFrame, index: str, shards: int, shard: int) -> DataFrame:
    """Rows of one shard: index modulo the number of shards."""
    return rows.where(F.pmod(F.col(index), F.lit(shards)) == shard)


def merged(rows: DataFrame, shard: str, n: int, index: str | None = None) -> DataFrame:
    """All shards as one table (rows, with the number of each row's shard); an error unless each of the n shards, and no other, is there. With an index, shards have been dealt
    out by index modulo n, and it is an error too if a row is in another's shard, or if of the indexes from 0 to the largest one is missing or there twice."""
    checks = [F.sort_array(F.collect_set(shard)).alias("_seen")]  # as many as there are shards
    whole = F.col("_seen") == F.array(*[F.lit(i).cast(rows.schema[shard].dataType) for i in range(n)])
    if index is not None:
        checks += [F.count_if(F.pmod(F.col(index), F.lit(n)) != F.col(shard)).alias("_strays"), F.count(F.lit(1)).alias("_n"), F.count_distinct(index).alias("_distinct"), F.min(index).alias("_lo"), F.max(index).alias("_hi")]
        whole &= (F.col("_strays") == 0) & (F.col("_distinct") == F.col("_n")) & (F.col("_lo") == 0) & (F.col("_hi") == F.col("_n") - 1)
    seen = rows.agg(*checks).select(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("shards are missing or mixed up"))).alias("_whole"))
    return rows.join(F.broadcast(seen)).where("_whole").drop("_whole")  # one row


def tail_sum(bins: Column, start: int) -> Column:
    """Sum of an array from a bin on."""
    return F.aggregate(F.slice(bins, start + 1, F.greatest(F.size(bins) - start, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)


def summed_bins(rows: DataFrame, by: Sequence[str], bins: str) -> DataFrame:
    """Element by element over rows: by, bin, n."""
    return rows.select(*by, F.posexplode(bins).alias("bin", "_n")).groupBy(*by, "bin").agg(F.sum("_n").alias("n"))


def at_coverage(rows: DataFrame, by: Sequence[str], coverage: str, order: str, value: str, bins: Sequence[float]) -> DataFrame:
    """by, bin, value: at the first row (in order) whose coverage reaches each bin, and the largest value of all."""
    d = rows.withColumn("bin", F.explode(F.array(*[F.lit(float(b)) for b in bins]))).where(F.col(coverage) >= F.col("bin"))
    return d.groupBy(*by, "bin").agg(F.min_by(value, order).alias(value))


def power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)
