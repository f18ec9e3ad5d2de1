"""Growth of a factory that makes part of itself: closed form, grid, first crossings, spans of equal regime, reach by bisection.

Parameter columns: seed (kg), alpha (output per kg and day), closure (0..1), energy_cap (kg a day, may be infinite), resupply (kg a day),
target (kg a day), days, dt. The rate is the least of two paths: local production / closure, which energy caps, and
resupply / (1 - closure).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")
# Names of regimes, as results have them.
MATERIAL, ENERGY, RESUPPLY = "material-limited", "energy-limited", "resupply-limited"
#: Rows of a grid in a task.
GRID_ROWS = 1 << 20


def _c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def resupply_path(closure: Column, resupply: Column) -> Column:
    return F.when(closure >= 1, F.lit(INF)).when(resupply <= 0, F.lit(0.0)).otherwise(resupply / (1 - closure))


def rate(mass: Column, alpha: Column, closure: Column, cap: Column, resupply: Column) -> tuple[Column, Column]:
    """(growth rate, regime) at a mass."""
    local = F.when(closure <= 0, F.lit(INF)).otherwise(F.least(alpha * mass, cap) / closure)
    other = resupply_path(closure, resupply)
    regime = F.when(other < local, RESUPPLY).when(alpha * mass <= cap, MATERIAL).otherwise(ENERGY)
    return F.least(local, other), regime


def mass_at(t: Column, seed: Column, alpha: Column, closure: Column, cap: Column, resupply: Column) -> Column:
    """The mass at time t: exponential up to the mass at which energy or resupply binds, then linear."""
    other = resupply_path(closure, resupply)
    most = F.when(closure <= 0, other).otherwise(F.least(F.when(closure > 0, cap / closure), other))
    kink = most * closure / alpha
    at = closure / alpha * F.ln(kink / seed)
    grown = F.when(t <= at, seed * F.exp(alpha * t / closure)).otherwise(kink + most * (t - at))
    return F.when((closure <= 0) | (seed >= kink), seed + most * t).otherwise(grown)


P = ("seed", "alpha", "closure", "energy_cap", "resupply")


def prepared(reports: DataFrame) -> DataFrame:
    """Parameter columns from closure, local, local_energy and seed, rate (kg a day), power_kw, resupply_mass, cadence (days)."""
    energy = F.when(F.col("local") > 0, F.col("local_energy") / F.col("local")).otherwise(F.lit(INF))
    d = reports.withColumn("alpha", F.col("rate") / F.col("seed")).withColumn("resupply", F.col("resupply_mass") / F.col("cadence"))
    d = d.withColumn("energy_cap", F.when(energy > 0, F.col("power_kw") * 24 / energy).otherwise(F.lit(INF)))
    d = d.withColumn("resupply_ceiling", F.when(F.col("closure") >= 1, F.lit(INF)).otherwise(F.col("resupply") / (1 - F.col("closure"))))
    doubling = F.when((F.col("closure") > 0) & (F.col("alpha") > 0), F.lit(math.log(2)) * F.col("closure") / F.col("alpha"))
    return d.withColumn("doubling_days", doubling)


def final(params: DataFrame) -> DataFrame:
    """End of the run, without a grid: final_mass, final_output, reaches (output never falls, so the end decides)."""
    end = F.ceil(F.col("days") / F.col("dt")) * F.col("dt")
    d = params.withColumn("final_mass", mass_at(end, *map(F.col, P)))
    d = d.withColumn("final_output", F.least(F.col("alpha") * F.col("final_mass"), F.col("energy_cap")))
    return d.withColumn("reaches", F.col("final_output") >= F.col("target"))


def grid(params: DataFrame) -> DataFrame:
    """A row per run and day of the reporting grid: day, mass, installed, output, growth, regime.

    Runs are dealt out by their key, so many that a task gets about GRID_ROWS rows: windows over runs then need no exchange, and what they sort in a task does not grow with the input.
    """
    n = F.ceil(F.col("days") / F.col("dt")).cast("int")
    rows = params.agg(F.sum(n.cast("long") + 1)).first()[0] or 0
    d = params.repartition(int(-(-rows // GRID_ROWS)) or 1, "run")
    d = d.withColumn("step", F.explode(F.sequence(F.lit(0), n))).withColumn("day", F.col("step") * F.col("dt"))
    d = d.withColumn("mass", mass_at(F.col("day"), *map(F.col, P))).withColumn("installed", F.col("alpha") * F.col("mass"))
    growth, regime = rate(F.col("mass"), *map(F.col, P[1:]))
    return d.withColumn("output", F.least("installed", "energy_cap")).withColumn("growth", growth).withColumn("regime", regime)


def interpolated(day0: Column, value0: Column, day: Column, value: Column, target: Column) -> Column:
    """Day at which the line between two samples meets the target; the right end if it is flat."""
    return F.when(value == value0, day).otherwise(day0 + F.try_divide(target - value0, value - value0) * (day - day0))


def first_crossing(rows: DataFrame, by: Sequence[str], order: Sequence[str], at: str, value: str, target: Column, name: str) -> DataFrame:
    """by and name: where value first reaches the target, interpolated from the row before; the first row counts as 'at' itself 0; null if never."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = rows.withColumn("_a", F.lag(at).over(w)).withColumn("_v", F.lag(value).over(w)).withColumn("_k", F.row_number().over(w))
    hit = F.when(F.col(value) >= target, F.struct(F.col("_k"), F.when(F.col("_k") == 1, F.lit(0.0)).otherwise(interpolated(F.col("_a"), F.col("_v"), F.col(at), F.col(value), target)).alias("x")))
    return d.groupBy(*by).agg(F.min(hit)["x"].alias(name))


def spans(rows: DataFrame, by: Sequence[str], order: Sequence[str], label: str, start: str) -> DataFrame:
    """Runs of equal labels: by, span (0, 1, ...), label, first, last (of start), n. Nulls are a label of their own."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.row_number().over(w) == 1, 0).when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    d = rows.withColumn("_new", new).withColumn("span", F.sum("_new").over(w))
    return d.groupBy(*by, "span").agg(F.first(label).alias(label), F.min(start).alias("first"), F.max(start).alias("last"), F.count(F.lit(1)).alias("n"))


def bisected(lo: float, hi: float, tolerance: float, good: Callable[[Column], Column]) -> Column:
    """struct(reach, saturated): the farthest point that is good, of a predicate that is good up to some point. Null if not even lo is good; hi if hi is."""
    steps = max(1, math.ceil(math.log2((hi - lo) / tolerance)))
    start = F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))

    def halve(ends: Column, _: Column) -> Column:
        mid = (ends["lo"] + ends["hi"]) * 0.5
        ok = good(mid)
        return F.struct(F.when(ok, mid).otherwise(ends["lo"]).alias("lo"), F.when(ok, ends["hi"]).otherwise(mid).alias("hi"))

    inner = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]
    reach = F.when(~good(F.lit(float(lo))), F.lit(None).cast("double")).when(good(F.lit(float(hi))), F.lit(float(hi))).otherwise(inner)
    return F.struct(reach.alias("reach"), F.coalesce(good(F.lit(float(lo))) & good(F.lit(float(hi))), F.lit(False)).alias("saturated"))


def trace_faults(rows: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Rows of a grid that break what must hold: output = min(installed, cap), installed = alpha * mass, mass never falls or starts below the seed."""
    w = Window.partitionBy(*by).orderBy("step")
    slack = lambda x: 1e-9 * F.greatest(F.lit(1.0), F.abs(x))
    bad = (F.abs(F.col("output") - F.least("installed", "energy_cap")) > slack(F.col("output"))) | (F.abs(F.col("installed") - F.col("alpha") * F.col("mass")) > slack(F.col("installed")))
    bad = bad | (F.col("mass") < F.col("seed") - slack(F.col("seed"))) | (F.coalesce(F.col("mass") < F.col("_before") - slack(F.col("_before")), F.lit(False)))
    return rows.withColumn("_before", F.lag("mass").over(w)).where(bad).drop("_before")
