"""Sunlight, solar arrays, splits of power, and the computing that power pays for."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpforge.functions.checks import Number, col, positive, share, within

# W/m2 at 1 AU and its spread; J/K; operations per second of brains and of a driving computer; W of a human brain.
SOLAR_CONSTANT = 1360.8
SOLAR_CONSTANT_SPREAD = 0.5
BOLTZMANN = 1.380649e-23
HUMAN_BRAIN_OPS = 1e18
HUMAN_BRAIN_WATTS = 20.0
DEMAND_OPS = {"low": 1e13, "central": 1.4e14, "high": 1e15}


def irradiance(distance_au: Number, constant: Number = SOLAR_CONSTANT) -> Column:
    d = col(distance_au)
    return within(positive(d), "distance must be positive", col(constant) / (d * d))


def array_watts(area: Number, efficiency: Number, distance_au: Number, constant: Number = SOLAR_CONSTANT) -> Column:
    return irradiance(distance_au, constant) * col(area) * col(efficiency)


def array_reach(area: Number, efficiency: Number, watts: Number, constant: Number = SOLAR_CONSTANT) -> Column:
    """Farthest distance at which an array still gives so many watts."""
    return within(positive(watts), "power must be positive", F.sqrt(col(constant) * col(area) * col(efficiency) / col(watts)))


def inverse_square(at_one_au: Number, distance_au: Number) -> Column:
    """What 1 AU gives, thinned to the distance: specific power, array power, affordable computing."""
    d = col(distance_au)
    return within(positive(d) & (col(at_one_au) >= 0), "distance must be positive and the amount not negative", col(at_one_au) / (d * d))


def reach_of_ratio(at_one_au: Number, needed: Number) -> Column:
    """Distance at which an inverse-square supply falls to what is needed: crossovers of sources and links, the wall of autonomy."""
    return within(positive(at_one_au, needed), "both amounts must be positive", F.sqrt(col(at_one_au) / col(needed)))


def power_split(total: Number, manufacturing: Number = 0.0, compute: Number = 0.0, housekeeping: Number = 0.0) -> Column:
    """struct(manufacturing, compute, housekeeping, unallocated) in the unit of total; shares must lie in 0..1 and not exceed 1 together."""
    shares = [col(manufacturing), col(compute), col(housekeeping)]
    used = shares[0] + shares[1] + shares[2]
    ok = positive(total) & share(shares[0]) & share(shares[1]) & share(shares[2]) & (used <= 1 + 1e-9)
    names = ("manufacturing", "compute", "housekeeping")
    parts = F.struct(*[(col(total) * s).alias(n) for s, n in zip(shares, names, strict=True)], (col(total) * (1 - used)).alias("unallocated"))
    return within(ok, "power shares must be within 0..1 and add up to 1 at most", parts)


def ops_of(watts: Number, ops_per_watt: Number) -> Column:
    return within((col(watts) >= 0) & positive(ops_per_watt), "power and efficiency must be valid", col(watts) * col(ops_per_watt))


def brains(ops: Number, ops_per_brain: Number = HUMAN_BRAIN_OPS) -> Column:
    return within(positive(ops_per_brain), "a brain's operations must be positive", col(ops) / col(ops_per_brain))


def watts_of(ops: Number, ops_per_watt: Number) -> Column:
    return within(positive(ops, ops_per_watt), "operations and efficiency must be positive", col(ops) / col(ops_per_watt))


def compute_share(ops: Number, total_watts: Number, ops_per_watt: Number) -> Column:
    """Share of all power that so many operations take; an error above 1."""
    s = watts_of(ops, ops_per_watt) / col(total_watts)
    return within(positive(total_watts) & (s <= 1), "more than all power is needed", s)


def least_joules_per_bit(kelvin: Number = 300.0) -> Column:
    return within(positive(kelvin), "temperature must be positive", col(kelvin) * (BOLTZMANN * math.log(2)))


def bits_per_joule(kelvin: Number = 300.0) -> Column:
    return 1 / least_joules_per_bit(kelvin)


def compute_headroom(area: Number, efficiency: Number, distance_au: Number, compute: Number, ops_per_watt: Number, constant: Number = SOLAR_CONSTANT) -> Column:
    """struct(delivered_w, compute_w, ops, brains) at the distance."""
    delivered = array_watts(area, efficiency, distance_au, constant)
    for_compute = power_split(delivered, compute=compute)["compute"]
    ops = ops_of(for_compute, ops_per_watt)
    return F.struct(delivered.alias("delivered_w"), for_compute.alias("compute_w"), ops.alias("ops"), brains(ops).alias("brains"))


def compute_reach(area: Number, efficiency: Number, ops: Number, compute: Number, ops_per_watt: Number, constant: Number = SOLAR_CONSTANT) -> Column:
    ok = positive(ops, compute, ops_per_watt) & (col(compute) <= 1)
    return within(ok, "operations, share and efficiency must be valid", array_reach(area, efficiency, col(ops) / col(ops_per_watt) / col(compute), constant))


def array_fraction(years: Number, loss_per_year: Number = 0.003, harshness: Number = 1.0) -> Column:
    """Share of an array's power left after years of compound loss."""
    rate = col(loss_per_year) * col(harshness)
    ok = (col(years) >= 0) & (col(loss_per_year) >= 0) & positive(harshness) & (rate < 1)
    return within(ok, "years and loss must be valid", F.pow(1 - rate, col(years)))
