"""Building, materials, energy of production, links, heat, shielding, wear."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpforge.functions.checks import Number, col, positive, share, within
from kelpforge.functions.sunlight import inverse_square, irradiance

# kg/h of wire and powder deposition; effectiveness of equipment, world class and typical; first-pass yield; a lunar factory's seed in kg and days to copy.
WIRE_KG_PER_H = (1.0, 10.0)
POWDER_KG_PER_H = (0.2, 1.4)
EFFECTIVENESS = (0.85, 0.6)
YIELD = 0.999
LUNAR_SEED_KG = 100000.0
LUNAR_COPY_DAYS = 365.0
# kWh/kg.
OXYGEN_KWH, OXYGEN_KWH_SPREAD, LIQUEFACTION_SHARE = 24.3, 5.8, 0.048
METAL_KWH = {"theoretical": 2.6, "practical": 3.7, "global_scale": 4.0}
# Mbit/s at 1 AU; most Mbit/s of the modem.
LINK_MBPS = 56.0
LINK_MOST_MBPS = 267.0
# W/kg at 1 AU and of fission; W below which a radioisotope source is chosen; kg of Pu-238 a source and a year.
SOLAR_W_PER_KG, FISSION_W_PER_KG, RTG_BELOW_W = 100.0, 6.7, 1000.0
PU238_KG, PU238_KG_PER_YEAR = 8.1, 1.5
# W/m2/K4; emissivity; kg/m2 of a radiator.
STEFAN_BOLTZMANN = 5.670374419e-8
EMISSIVITY = 0.8
RADIATOR_KG_PER_M2 = 3.0
# g/cm2 beyond which more shielding adds cosmic-ray dose; g/cm3 of titanium and regolith; dose factor of a 1 cm titanium vault; mSv a day.
DOSE_MINIMUM = 20.0
TITANIUM, REGOLITH = 4.51, 1.6
VAULT_FACTOR = 800.0
COSMIC_MSV_PER_DAY = 1.8


def build_rate(arms: Number, kg_per_h: Number, duty: Number, first_pass: Number, hours: Number = 24.0) -> Column:
    ok = (col(arms) >= 1) & positive(kg_per_h, duty, first_pass, hours) & (col(duty) <= 1) & (col(first_pass) <= 1)
    return within(ok, "rates and shares must be valid", col(arms) * col(kg_per_h) * col(hours) * col(duty) * col(first_pass))


def build_rate_band() -> dict[str, float]:
    """kg a day: slow powder, one wire arm, and the lunar factory that copies itself in a year."""
    return {"low": POWDER_KG_PER_H[0] * 24 * EFFECTIVENESS[1] * YIELD, "anchor": WIRE_KG_PER_H[0] * 24 * EFFECTIVENESS[0] * YIELD, "high": LUNAR_SEED_KG / LUNAR_COPY_DAYS}


def per_day(mass: Number, days: Number) -> Column:
    return within(positive(mass, days), "mass and days must be positive", col(mass) / col(days))


def copy_days(rate: Number, seed: Number, closure: Number) -> Column:
    return within(positive(rate, seed) & share(closure), "rate, seed and closure must be valid", col(closure) * col(seed) / col(rate))


def mass_penalty(required: Number, strength: Number) -> Column:
    return within(positive(required, strength), "strengths must be positive", F.greatest(F.lit(1.0), col(required) / col(strength)))


def strong_enough(strength: Number, required: Number, hard: Column) -> Column:
    """Only a hard threshold rules a material out."""
    return ~hard | (col(strength) >= col(required))


def penalised_closure(structural: Number, other: Number, imported: Number, k: Number = 1.0) -> Column:
    local = col(k) * col(structural) + col(other)
    ok = (col(structural) >= 0) & (col(other) >= 0) & (col(imported) >= 0) & (col(k) >= 1) & (local + col(imported) > 0)
    return within(ok, "masses must be valid", local / (local + col(imported)))


def oxygen_kwh(liquefied: Column) -> Column:
    """struct(central, low, high) kWh/kg."""
    central = F.when(liquefied, OXYGEN_KWH).otherwise(OXYGEN_KWH * (1 - LIQUEFACTION_SHARE))
    return F.struct(central.alias("central"), (central - OXYGEN_KWH_SPREAD).alias("low"), (central + OXYGEN_KWH_SPREAD).alias("high"))


def metal_kwh(basis: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in METAL_KWH.items() for x in pair])
    got = F.try_element_at(table, basis)
    return F.when(basis.isNotNull() & got.isNull(), F.raise_error(F.lit("unknown basis"))).otherwise(got)


def link_constant(mbps: Number, distance_au: Number) -> Column:
    return within(positive(mbps, distance_au), "rate and distance must be positive", col(mbps) * col(distance_au) * col(distance_au))


def link_mbps(distance_au: Number, at_one_au: Number = LINK_MBPS, most: Number = LINK_MOST_MBPS) -> Column:
    return within(positive(at_one_au, most), "link figures must be positive", F.least(inverse_square(at_one_au, distance_au), col(most)))


def backlog(bits_per_s: Number, distance_au: Number, seconds: Number, at_one_au: Number = LINK_MBPS, most: Number = LINK_MOST_MBPS) -> Column:
    """struct(generated, returned, backlog, link, is_wall) in bits and bits a second."""
    link = link_mbps(distance_au, at_one_au, most) * 1e6
    made, back = col(bits_per_s) * col(seconds), F.least(col(bits_per_s), link) * col(seconds)
    parts = F.struct(made.alias("generated"), back.alias("returned"), (made - back).alias("backlog"), link.alias("link"), (col(bits_per_s) > link).alias("is_wall"))
    return within((col(bits_per_s) >= 0) & (col(seconds) >= 0), "rate and time must not be negative", parts)


def link_total(distances: Column, at_one_au: Number = LINK_MBPS, most: Number = LINK_MOST_MBPS) -> Column:
    """Sum over an array of distances."""
    return F.aggregate(distances, F.lit(0.0), lambda a, d: a + link_mbps(d, at_one_au, most))


def source_mass(watts: Number, w_per_kg: Number) -> Column:
    return within((col(watts) >= 0) & positive(w_per_kg), "power must be valid", col(watts) / col(w_per_kg))


def power_source(distance_au: Number, watts: Number, solar: Number = SOLAR_W_PER_KG, fission: Number = FISSION_W_PER_KG) -> Column:
    pick = F.when(inverse_square(solar, distance_au) >= col(fission), "solar").when(col(watts) < RTG_BELOW_W, "rtg").otherwise("fission")
    return within(positive(watts), "power must be positive", pick)


def plutonium_kg(sources: Number, each: Number = PU238_KG) -> Column:
    return within(col(sources) >= 0, "sources must not be negative", col(sources) * col(each))


def plutonium_years(kg: Number, per_year: Number = PU238_KG_PER_YEAR) -> Column:
    return within((col(kg) >= 0) & positive(per_year), "mass and production must be valid", col(kg) / col(per_year))


def radiated(kelvin: Number, emissivity: Number = EMISSIVITY, sink: Number = 0.0, sides: Number = 2) -> Column:
    ok = positive(kelvin, emissivity) & (col(emissivity) <= 1) & (col(sink) >= 0) & col(sides).isin(1.0, 2.0) & (col(sink) < col(kelvin))
    flux = col(sides) * col(emissivity) * STEFAN_BOLTZMANN * (F.pow(col(kelvin), F.lit(4.0)) - F.pow(col(sink), F.lit(4.0)))
    return within(ok, "radiator figures must be valid", flux)


def radiator_area(watts: Number, kelvin: Number, emissivity: Number = EMISSIVITY, sink: Number = 0.0, sides: Number = 2) -> Column:
    return within(col(watts) >= 0, "heat must not be negative", col(watts) / radiated(kelvin, emissivity, sink, sides))


def radiator_mass(area: Number, kg_per_m2: Number = RADIATOR_KG_PER_M2) -> Column:
    return within((col(area) >= 0) & positive(kg_per_m2), "area must be valid", col(area) * col(kg_per_m2))


def radiator(watts: Number, kelvin: Number, emissivity: Number = EMISSIVITY, sink: Number = 0.0, sides: Number = 2, kg_per_m2: Number = RADIATOR_KG_PER_M2) -> Column:
    """struct(flux, area, mass); unlike radiator_area, negative heat gives area 0."""
    flux = radiated(kelvin, emissivity, sink, sides)
    area = F.greatest(col(watts), F.lit(0.0)) / flux
    return F.struct(flux.alias("flux"), area.alias("area"), radiator_mass(area, kg_per_m2).alias("mass"))


def radiator_kg_per_kw(kelvin: Number, emissivity: Number = EMISSIVITY, sink: Number = 0.0, sides: Number = 2, kg_per_m2: Number = RADIATOR_KG_PER_M2) -> Column:
    return col(kg_per_m2) / (radiated(kelvin, emissivity, sink, sides) / 1000)


def sunlit_radiated(kelvin: Number, distance_au: Number, absorptivity: Number = 0.2, emissivity: Number = EMISSIVITY, sides: Number = 2) -> Column:
    net = col(sides) * col(emissivity) * STEFAN_BOLTZMANN * F.pow(col(kelvin), F.lit(4.0)) - col(absorptivity) * irradiance(distance_au)
    return within(share(absorptivity) & (net > 0), "sunlight outweighs what is radiated", net)


def reactor_radiator(watts: Number, efficiency: Number = 0.3, kelvin: Number = 500.0) -> Column:
    """struct(waste_w, area, mass)."""
    waste = within(positive(watts, efficiency) & (col(efficiency) < 1), "power and efficiency must be valid", col(watts) * (1 - col(efficiency)) / col(efficiency))
    r = radiator(waste, kelvin)
    return F.struct(waste.alias("waste_w"), r["area"].alias("area"), r["mass"].alias("mass"))


def vault_length() -> float:
    """g/cm2 over which a dose falls by e, from 1 cm of titanium and its factor."""
    return TITANIUM / math.log(VAULT_FACTOR)


def areal_density(cm: Number, g_per_cm3: Number) -> Column:
    return within((col(cm) >= 0) & positive(g_per_cm3), "thickness and density must be valid", col(cm) * col(g_per_cm3))


def thickness_cm(g_per_cm2: Number, g_per_cm3: Number = REGOLITH) -> Column:
    return within((col(g_per_cm2) >= 0) & positive(g_per_cm3), "densities must be valid", col(g_per_cm2) / col(g_per_cm3))


def shield_kg(g_per_cm2: Number, m2: Number) -> Column:
    return within((col(g_per_cm2) >= 0) & (col(m2) >= 0), "density and area must not be negative", col(g_per_cm2) * col(m2) * 10)


def _length(length: Number | None) -> Column:
    """Null and 0 stand for the vault's length."""
    given = F.lit(None).cast("double") if length is None else col(length)
    return F.when(given.isNull() | (given == 0), vault_length()).otherwise(given)


def dose_factor(g_per_cm2: Number, length: Number | None = None) -> Column:
    return within((col(g_per_cm2) >= 0) & (_length(length) > 0), "density and length must be valid", F.exp(-col(g_per_cm2) / _length(length)))


def shielding_for(dose: Number, budget: Number, length: Number | None = None) -> Column:
    need = F.when(col(budget) >= col(dose), 0.0).otherwise(_length(length) * F.ln(col(dose) / col(budget)))
    return within(positive(dose, budget), "doses must be positive", need)


def too_thick(g_per_cm2: Number) -> Column:
    return col(g_per_cm2) > DOSE_MINIMUM


def advised_shielding(g_per_cm2: Number) -> Column:
    return within(col(g_per_cm2) >= 0, "density must not be negative", F.least(col(g_per_cm2), F.lit(DOSE_MINIMUM)))


def local_shield_kg(kg: Number, local: Column) -> Column:
    return within(col(kg) >= 0, "mass must not be negative", F.when(local, col(kg)).otherwise(0.0))


def cosmic_dose(days: Number, per_day: Number = COSMIC_MSV_PER_DAY) -> Column:
    return within((col(days) >= 0) & (col(per_day) >= 0), "days and dose must not be negative", col(per_day) * col(days))


def survivors(days: Number, hazard: Number) -> Column:
    return within((col(days) >= 0) & share(hazard), "days and hazard must be valid", F.pow(1 - col(hazard), col(days)))


def settled_share(t_launch: Number, t_settle: Number) -> Column:
    """Equilibrium of settling against loss."""
    return within(positive(t_launch, t_settle), "times must be positive", F.greatest(F.lit(0.0), 1 - col(t_launch) / col(t_settle)))


def settled_rate(x: Number, t_launch: Number, t_settle: Number) -> Column:
    return within(positive(t_launch, t_settle), "times must be positive", col(x) * (1 - col(x)) / col(t_launch) - col(x) / col(t_settle))


def settled_at(x0: Number, t_launch: Number, t_settle: Number, t: Number) -> Column:
    """The share at time t: a logistic curve in closed form, hyperbolic where growth and loss are equal."""
    r = 1 / col(t_launch) - 1 / col(t_settle)
    grown = F.exp(r * col(t))
    logistic = col(x0) * grown / (1 + col(x0) * (grown - 1) / (col(t_launch) * r))
    hyperbolic = col(x0) / (1 + col(x0) * col(t) / col(t_launch))
    return within(positive(t_launch, t_settle) & share(x0) & (col(t) >= 0), "shares and times must be valid", F.when(F.abs(r) < 1e-15, hyperbolic).otherwise(logistic))
