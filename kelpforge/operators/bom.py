"""Bills of materials: what share a factory makes itself, what it imports, and what changes if parts become local."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories that count as electronics in the usual what-if.
ELECTRONICS = ("compute", "electronics", "semiconductor")

BOM = "factory string, position int, name string, mass double, category string, local boolean, processes array<string>, kwh_per_kg double"


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def closure(bom: DataFrame, by: Sequence[str] = ("factory",), mass: str = "mass", local: str = "local", energy: str | None = None) -> DataFrame:
    """Total, local and imported mass, and their ratio, by group; with energy (per mass), the energy of all parts and of local ones."""
    m = F.col(mass)
    own = F.when(F.col(local), m).otherwise(0.0)
    sums = [F.sum(m).alias("total"), F.sum(own).alias("local")]
    if energy:
        sums += [F.sum(m * F.col(energy)).alias("energy"), F.sum(own * F.col(energy)).alias("local_energy")]
    d = bom.groupBy(*by).agg(*sums)
    return d.withColumn("imported", F.col("total") - F.col("local")).withColumn("closure", ratio(F.col("local"), F.col("total")))


def import_list(bom: DataFrame, by: Sequence[str] = ("factory",), mass: str = "mass", local: str = "local", tie: Sequence[str] = ("position",)) -> DataFrame:
    """Imported rows with their rank by mass in the group, heaviest first and then in the order of tie, and their share of all mass in the group."""
    group = Window.partitionBy(*by)
    d = bom.withColumn("share", ratio(F.col(mass), F.sum(mass).over(group))).where(~F.col(local))
    return d.withColumn("rank", F.row_number().over(group.orderBy(F.col(mass).desc(), *tie)))


def variants(bom: DataFrame, categories: Sequence[str] = ELECTRONICS, category: str = "category", local: str = "local") -> DataFrame:
    """Each row twice: as it is (before) and with the categories made local (after)."""
    d = bom.withColumn("variant", F.explode(F.array(F.lit("before"), F.lit("after"))))
    return d.withColumn(local, F.col(local) | ((F.col("variant") == "after") & F.col(category).isin(*categories)))


def before_after(results: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per group with value_before, value_after and value_delta (before less after; null if either is)."""
    d = results.groupBy(*by).pivot("variant", ["before", "after"]).agg(*[F.first(v).alias(v) for v in values])
    out = [F.col(f"{s}_{v}" if len(values) > 1 else s).alias(f"{v}_{s}") for v in values for s in ("before", "after")]
    d = d.select(*by, *out)
    return d.withColumns({f"{v}_delta": F.col(f"{v}_before") - F.col(f"{v}_after") for v in values})


def available(composition: Column, threshold: Column) -> Column:
    """Names in a map of shares that reach the threshold."""
    return F.map_keys(F.map_filter(composition, lambda _, v: v >= threshold))


def makeable(required: Column, there: Column) -> Column:
    """Whether all that is required is there."""
    return F.size(F.array_except(required, there)) == 0


def closure_ceiling(parts: DataFrame, by: Sequence[str], mass: str = "mass", required: str = "required", there: str = "available") -> DataFrame:
    """Share of mass in parts whose required elements are all available."""
    ok = F.when(makeable(F.col(required), F.col(there)), F.col(mass)).otherwise(0.0)
    return parts.groupBy(*by).agg(F.sum(mass).alias("total"), F.sum(ok).alias("makeable")).withColumn("ceiling", ratio(F.col("makeable"), F.col("total")))
