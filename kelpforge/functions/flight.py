"""Rockets, orbits, low thrust, propellant routes, and what launches cost."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.functions.checks import Number, col, positive, within
from kelpforge.functions.sunlight import inverse_square

# m/s2; the Sun's GM in m3/s2; m; s; semi-major axes in AU; sidereal periods in days.
G0 = 9.80665
GM_SUN = 1.32712440018e20
AU = 149597870700.0
DAY = 86400.0
AXES_AU = {"earth": 1.0, "mars": 1.5237, "ceres": 2.77, "jupiter": 5.2034}
PERIODS_DAYS = {"earth": 365.256, "mars": 686.98}
# Heating value of hydrogen in kWh/kg, its mass share of water; t of xenon a year; USD a year of the platinum market.
HYDROGEN_KWH = 39.4
HYDROGEN_OF_WATER = 2.016 / 18.015
XENON_SUPPLY_T = (40.0, 60.0)
PLATINUM_MARKET_USD = 7.25e9
# Name, specific impulse in s, needs water, is a noble gas.
ROUTES = [
    ("LOX/LH2 (water-derived)", 450.0, True, False),
    ("water electrothermal", 300.0, True, False),
    ("xenon Hall EP", 1800.0, False, True),
    ("xenon ion EP (NEXT-C)", 4190.0, False, True),
]


def exhaust_speed(isp: Number) -> Column:
    return within(positive(isp), "specific impulse must be positive", col(isp) * G0)


def mass_ratio(delta_v: Number, exhaust: Number) -> Column:
    return within((col(delta_v) >= 0) & positive(exhaust), "speeds must be valid", F.exp(col(delta_v) / col(exhaust)))


def propellant_share(delta_v: Number, exhaust: Number) -> Column:
    return 1 - 1 / mass_ratio(delta_v, exhaust)


def propellant_mass(delta_v: Number, isp: Number, dry_mass: Number) -> Column:
    return within(positive(dry_mass), "dry mass must be positive", col(dry_mass) * (mass_ratio(delta_v, exhaust_speed(isp)) - 1))


def price(mass: Number, per_kg: Number) -> Column:
    """Cost of launching a mass; also the launches that local output avoids."""
    return within((col(mass) >= 0) & (col(per_kg) >= 0), "mass and price must not be negative", col(mass) * col(per_kg))


def launch_comparison(target: Number, seed: Number, imported: Number, per_kg: Number) -> Column:
    """struct of masses and money: launching all of the target against launching a seed and what it imports."""
    launched = col(seed) + col(imported)
    direct, grown = col(target) * col(per_kg), launched * col(per_kg)
    parts = F.struct(launched.alias("launched_kg"), direct.alias("direct_usd"), grown.alias("grown_usd"), (col(target) / launched).alias("leverage"), (grown / direct).alias("cost_ratio"), (direct - grown).alias("saved_usd"))
    return within(positive(target, seed, per_kg) & (col(imported) >= 0), "masses and price must be valid", parts)


def imports_of(closure: Number, built: Number) -> Column:
    return within((col(closure) >= 0) & (col(closure) <= 1) & (col(built) >= 0), "closure and mass must be valid", (1 - col(closure)) * col(built))


def years_to_absorb(value: Number, market: Number = PLATINUM_MARKET_USD) -> Column:
    return within((col(value) >= 0) & positive(market), "value and market must be valid", col(value) / col(market))


def value_ceiling(years: Number, market: Number = PLATINUM_MARKET_USD) -> Column:
    return within((col(years) >= 0) & positive(market), "years and market must be valid", col(years) * col(market))


def orbital_speed(radius_au: Number) -> Column:
    return within(positive(radius_au), "radius must be positive", F.sqrt(GM_SUN / (col(radius_au) * AU)))


def two_burn_transfer(from_au: Number, to_au: Number) -> Column:
    """struct(dv1, dv2, dv, days) of the half ellipse between two circular orbits."""
    a, b = col(from_au) * AU, col(to_au) * AU
    one = F.sqrt(GM_SUN / a) * (F.sqrt(2 * b / (a + b)) - 1)
    two = F.sqrt(GM_SUN / b) * (1 - F.sqrt(2 * a / (a + b)))
    days = F.sqrt(F.pow(a + b, F.lit(3.0)) / (8 * GM_SUN)) * math.pi / DAY
    parts = F.struct(one.alias("dv1"), two.alias("dv2"), (F.abs(one) + F.abs(two)).alias("dv"), days.alias("days"))
    return within(positive(from_au, to_au), "radii must be positive", parts)


def synodic_days(one: Number, other: Number) -> Column:
    difference = F.abs(1 / col(one) - 1 / col(other))
    return within(positive(one, other) & (difference != 0), "periods must be positive and differ", 1 / difference)


def spiral_delta_v(from_au: Number, to_au: Number, plane_degrees: Number = 0.0) -> Column:
    a, b = orbital_speed(from_au), orbital_speed(to_au)
    inner = a * a - 2 * a * b * F.cos(col(plane_degrees) / 90 * (math.pi / 2)) + b * b
    return F.sqrt(F.greatest(inner, F.lit(0.0)))


def electric_thrust(watts: Number, isp: Number, efficiency: Number) -> Column:
    ok = (col(watts) >= 0) & positive(efficiency) & (col(efficiency) <= 1)
    return within(ok, "power and efficiency must be valid", 2 * col(efficiency) * col(watts) / exhaust_speed(isp))


def electric_transfer(delta_v: Number, isp: Number, dry_mass: Number, watts_at_one_au: Number, distance_au: Number, efficiency: Number) -> Column:
    """struct(propellant_kg, watts, thrust_n, acceleration, days); no thrust takes 0 days."""
    propellant = propellant_mass(delta_v, isp, dry_mass)
    watts = inverse_square(watts_at_one_au, distance_au)
    thrust = electric_thrust(watts, isp, efficiency)
    a = thrust / (col(dry_mass) + propellant)
    days = F.when(a <= 0, F.lit(0.0)).otherwise(col(delta_v) / a / DAY)
    return F.struct(propellant.alias("propellant_kg"), watts.alias("watts"), thrust.alias("thrust_n"), a.alias("acceleration"), days.alias("days"))


def electrolysis_kwh_per_kg_water() -> float:
    return HYDROGEN_KWH * HYDROGEN_OF_WATER


def route_closure(noble_gas: Column, needs_water: Column, water: Column) -> Column:
    """1 if a body with water gives the propellant, else 0."""
    return F.when(~noble_gas & needs_water & water, 1.0).otherwise(0.0)


def supply_share(tonnes: Number, supply: Number = XENON_SUPPLY_T[1]) -> Column:
    return within((col(tonnes) >= 0) & positive(supply), "mass and supply must be valid", col(tonnes) / col(supply))


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "route string, isp double, needs_water boolean, noble_gas boolean")


def compare_propellants(hops: DataFrame, table: DataFrame) -> DataFrame:
    """Every hop (delta_v, dry_mass, water) with every route of a small fixed table: propellant, closure, imported."""
    d = hops.join(F.broadcast(table))  # a row per route
    closure = route_closure(F.col("noble_gas"), F.col("needs_water"), F.col("water"))
    d = d.withColumn("propellant_kg", propellant_mass(F.col("delta_v"), F.col("isp"), F.col("dry_mass"))).withColumn("closure", closure)
    return d.withColumn("imported_kg", (1 - F.col("closure")) * F.col("propellant_kg"))
