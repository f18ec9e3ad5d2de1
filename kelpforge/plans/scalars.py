"""Queries that apply the scalar functions, a family each, over parts of many sizes and prices, with their SQL.

Every part gives the arguments: its size (1 to 50), its price (about 900 to 1000), whether its key is even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.functions import flight, plant, sunlight, text
from kelpforge.operators import neighbours
from kelpforge.plans.catalogue import query, rounded
from kelpforge.session import table

ARGUMENTS = "p as (select p_partkey, p_size::double as size, p_retailprice::double as price, p_partkey % 2 = 0 as even from part)"


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"), (F.pmod("p_partkey", F.lit(2)) == 0).alias("even"))


def grid(spark: SparkSession, d: str, **columns: Column) -> DataFrame:
    return rounded(parts(spark, d).select("p_partkey", *[c.alias(name) for name, c in columns.items()]))


@query(f"""with {ARGUMENTS}, k as (select *, 300 + 4 * size as kelvin, 1 + size / 50 as au from p), f as (select *, 2 * 0.8e0 * 5.670374419e-8 * pow(kelvin, 4) as flux from k),
    x as (select p_partkey, flux, 0.9e0 * 5.670374419e-8 * (pow(kelvin, 4) - pow(200e0, 4)) as one_side, 10 * price / flux as area, 10 * price / flux * 3 as mass,
    greatest(10 * price - 9500, 0) / flux * 3 as spare_mass, 3 / (flux / 1000) as kg_per_kw, flux - 0.2e0 * (1360.8e0 / (au * au)) as sunlit, price * 0.7e0 / 0.3e0 as waste_w,
    price * 0.7e0 / 0.3e0 / flux as waste_area, price * 0.7e0 / 0.3e0 / flux * 3 as waste_mass from f) select p_partkey, round(columns(* exclude (p_partkey)), 6) from x""")
def radiator_grid(spark: SparkSession, d: str) -> DataFrame:
    """What radiators of many temperatures give off and weigh, in shade, in sunlight and behind a reactor."""
    kelvin, watts = 300 + 4 * F.col("size"), 10 * F.col("price")
    area, waste = plant.radiator_area(watts, kelvin), plant.reactor_radiator(F.col("price"), 0.3, kelvin)
    return grid(
        spark, d, flux=plant.radiated(kelvin), one_side=plant.radiated(kelvin, 0.9, 200.0, 1), area=area, mass=plant.radiator_mass(area), spare_mass=plant.radiator(watts - 9500, kelvin)["mass"],
        kg_per_kw=plant.radiator_kg_per_kw(kelvin), sunlit=plant.sunlit_radiated(kelvin, 1 + F.col("size") / 50), waste_w=waste["waste_w"], waste_area=waste["area"], waste_mass=waste["mass"],
    )


@query(f"""with {ARGUMENTS}, x as (select p_partkey, too_thick, round(columns(* exclude (p_partkey, too_thick)), 6) from (select p_partkey, size > 20 as too_thick, size / 10 * 4.51e0 as density, size / 1.6e0 as regolith_cm, size * (price / 100) * 10 as shield,
    exp(-size / (4.51e0 / ln(800e0))) as factor, exp(-size / 2) as other_factor, case when size * 50 >= price then 0 else 4.51e0 / ln(800e0) * ln(price / (size * 50)) end as needed, least(size, 20) as advised,
    case when even then price else 0 end as local_kg, 1.8e0 * price as dose, pow(1 - 0.01e0, size) as alive, pow(1 - 0.003e0 * 2, size) as array_left from p)) select * from x""")
def shielding_grid(spark: SparkSession, d: str) -> DataFrame:
    """Shielding of many densities: its mass, what dose is left, what is advised; wear over as many days or years."""
    return grid(
        spark, d, too_thick=plant.too_thick(F.col("size")), density=plant.areal_density(F.col("size") / 10, plant.TITANIUM), regolith_cm=plant.thickness_cm(F.col("size")), shield=plant.shield_kg(F.col("size"), F.col("price") / 100), factor=plant.dose_factor(F.col("size")),
        other_factor=plant.dose_factor(F.col("size"), 2.0), needed=plant.shielding_for(F.col("price"), F.col("size") * 50), advised=plant.advised_shielding(F.col("size")), local_kg=plant.local_shield_kg(F.col("price"), F.col("even")), dose=plant.cosmic_dose(F.col("price")),
        alive=plant.survivors(F.col("size"), 0.01), array_left=sunlight.array_fraction(F.col("size"), 0.003, 2.0),
    )


@query(f"""with {ARGUMENTS}, t as (select *, 1000 * (exp(5000 / (3000 * 9.80665e0)) - 1) as propellant, 10 * price / ((1 + size / 10) * (1 + size / 10)) as watts from p), a as (select *, 2 * 0.6e0 * watts / (3000 * 9.80665e0) as thrust from t),
    x as (select p_partkey, 1 / abs(1 / 365.256e0 - 1 / (365.256e0 + price)) as synodic, 2 * 0.6e0 * price / (3000 * 9.80665e0) as thrust_at_home, propellant, watts, thrust, thrust / (1000 + propellant) as acceleration,
    5000 / (thrust / (1000 + propellant)) / 86400 as days, price * size as priced, price * size / 7.25e9 as years_to_absorb, price * (exp(size * 100 / (450 * 9.80665e0)) - 1) as burnt from a) select p_partkey, round(columns(* exclude (p_partkey)), 6) from x""")
def electric_transfer_grid(spark: SparkSession, d: str) -> DataFrame:
    """Transfers on electric thrust at many distances, with what they burn, take and cost."""
    t = flight.electric_transfer(5000.0, 3000.0, 1000.0, 10 * F.col("price"), 1 + F.col("size") / 10, 0.6)
    return grid(
        spark, d, synodic=flight.synodic_days(flight.PERIODS_DAYS["earth"], flight.PERIODS_DAYS["earth"] + F.col("price")), thrust_at_home=flight.electric_thrust(F.col("price"), 3000.0, 0.6), propellant=t["propellant_kg"], watts=t["watts"],
        thrust=t["thrust_n"], acceleration=t["acceleration"], days=t["days"], priced=flight.price(F.col("price"), F.col("size")), years_to_absorb=flight.years_to_absorb(F.col("price") * F.col("size")), burnt=flight.propellant_mass(F.col("size") * 100, 450.0, F.col("price")),
    )


@query(f"""with {ARGUMENTS}, r(route, isp, needs_water, noble_gas) as (values ('LOX/LH2 (water-derived)', 450e0, true, false), ('water electrothermal', 300e0, true, false), ('xenon Hall EP', 1800e0, false, true), ('xenon ion EP (NEXT-C)', 4190e0, false, true)),
    x as (select p_partkey, route, price * (exp(size * 100 / (isp * 9.80665e0)) - 1) as propellant_kg, case when not noble_gas and needs_water and even then 1e0 else 0e0 end as closure from p, r)
    select p_partkey, route, round(closure, 6) as closure, round(propellant_kg, 6) as propellant_kg, round((1 - closure) * propellant_kg, 6) as imported_kg, round(propellant_kg / 1000 / 60, 6) as xenon_share from x""")
def propellant_routes(spark: SparkSession, d: str) -> DataFrame:
    """Every part as a hop with every propellant: how much of it, and how much of that is imported."""
    hops = parts(spark, d).select("p_partkey", (F.col("size") * 100).alias("delta_v"), F.col("price").alias("dry_mass"), F.col("even").alias("water"))
    found = flight.compare_propellants(hops, flight.routes(spark))
    return rounded(found.select("p_partkey", "route", "closure", "propellant_kg", "imported_kg", flight.supply_share(F.col("propellant_kg") / 1000).alias("xenon_share")))


@query(f"""with {ARGUMENTS}, l as (select *, 0.4e0 + size / 10 as au from p), m as (select *, least(56 / (au * au), 267) * 1e6 as link, price * 10000 as made from l),
    x as (select p_partkey, made > link as is_wall, made * 10 as generated, least(made, link) * 10 as returned, made * 10 - least(made, link) * 10 as backlog, link / 1e6 as mbps, least(56 / (au * au), 267) + least(56 / (2 * au * (2 * au)), 267) as total,
    size * au * au as constant, price / 6.7e0 as reactor_kg, size * 8.1e0 as plutonium, size * 8.1e0 / 1.5e0 as plutonium_years, sqrt(100 / size) as crossover from m) select p_partkey, is_wall, round(columns(* exclude (p_partkey, is_wall)), 4) from x""")
def link_grid(spark: SparkSession, d: str) -> DataFrame:
    """Links home from many distances, what piles up behind them, and sources of power."""
    au = 0.4 + F.col("size") / 10
    b = plant.backlog(F.col("price") * 10000, au, 10.0)
    plutonium = plant.plutonium_kg(F.col("size"))
    x = parts(spark, d).select(
        "p_partkey", b["is_wall"].alias("is_wall"), b["generated"].alias("generated"), b["returned"].alias("returned"), b["backlog"].alias("backlog"), plant.link_mbps(au).alias("mbps"), plant.link_total(F.array(au, 2 * au)).alias("total"),
        plant.link_constant(F.col("size"), au).alias("constant"), plant.source_mass(F.col("price"), plant.FISSION_W_PER_KG).alias("reactor_kg"), plutonium.alias("plutonium"), plant.plutonium_years(plutonium).alias("plutonium_years"),
        sunlight.reach_of_ratio(100.0, F.col("size")).alias("crossover"),
    )
    return rounded(x, 4)


@query(f"""with {ARGUMENTS}, m as (select *, size * 2 * 24 * 0.85e0 * 0.999e0 as rate, greatest(1, size * 10 / 200) as k from p),
    x as (select p_partkey, not even or size >= 25 as strong, rate, price * 10 / 365 as per_day, size / 60 * price / rate as copy_days, k as penalty, (k * size + price / 100) / (k * size + price / 100 + 3) as closure,
    case when even then 24.3e0 else 24.3e0 * (1 - 0.048e0) end as oxygen, case when even then 24.3e0 else 24.3e0 * (1 - 0.048e0) end - 5.8e0 as oxygen_low, case when even then 2.6e0 else 4.0e0 end as metal,
    0.2e0 * 24 * 0.6e0 * 0.999e0 as rate_low, 24 * 0.85e0 * 0.999e0 as rate_anchor, 100000 / 365e0 as rate_high from m) select p_partkey, strong, round(columns(* exclude (p_partkey, strong)), 6) from x""")
def build_grid(spark: SparkSession, d: str) -> DataFrame:
    """How fast so many arms build and copy themselves, what weak material costs in closure, what oxygen and metal cost in energy."""
    rate, k, oxygen, rates = plant.build_rate(F.col("size"), 2.0, 0.85, 0.999), plant.mass_penalty(F.col("size") * 10, 200.0), plant.oxygen_kwh(F.col("even")), plant.build_rate_band()
    return grid(
        spark, d, strong=plant.strong_enough(F.col("size"), 25.0, F.col("even")), rate=rate, per_day=plant.per_day(F.col("price") * 10, 365.0), copy_days=plant.copy_days(rate, F.col("price"), F.col("size") / 60), penalty=k,
        closure=plant.penalised_closure(F.col("size"), F.col("price") / 100, 3.0, k), oxygen=oxygen["central"], oxygen_low=oxygen["low"], metal=plant.metal_kwh(F.when(F.col("even"), "theoretical").otherwise("global_scale")),
        rate_low=F.lit(rates["low"]), rate_anchor=F.lit(rates["anchor"]), rate_high=F.lit(rates["high"]),
    )


@query(f"""with {ARGUMENTS}, a as (select *, 1 + size / 10 as au from p), w as (select *, 1360.8e0 / (au * au) * price * 0.3e0 as delivered from a),
    x as (select p_partkey, 1e14 * size / 1e12 as watts, 1e14 * size / 1e12 / 10000 as of_all, 300 * size * (1.380649e-23 * ln(2e0)) * 1e20 as joules, 1 / (300 * size * (1.380649e-23 * ln(2e0))) / 1e18 as bits, delivered, delivered * 0.2e0 as for_compute,
    delivered * 0.2e0 * 1e12 / 1e18 as brains, price / (au * au) as thinned, sqrt(1360.8e0 * price * 0.3e0 / (1e14 * size / 1e12 / 0.2e0)) as reach from w) select p_partkey, round(columns(* exclude (p_partkey)), 6) from x""")
def compute_grid(spark: SparkSession, d: str) -> DataFrame:
    """Computing that power pays for at many distances, and the power that computing takes."""
    ops, au = 1e14 * F.col("size"), 1 + F.col("size") / 10
    there = sunlight.compute_headroom(F.col("price"), 0.3, au, 0.2, 1e12)
    return grid(
        spark, d, watts=sunlight.watts_of(ops, 1e12), of_all=sunlight.compute_share(ops, 10000.0, 1e12), joules=sunlight.least_joules_per_bit(300 * F.col("size")) * 1e20, bits=sunlight.bits_per_joule(300 * F.col("size")) / 1e18,
        delivered=there["delivered_w"], for_compute=there["compute_w"], brains=there["brains"], thinned=sunlight.inverse_square(F.col("price"), au), reach=sunlight.compute_reach(F.col("price"), 0.3, ops, 0.2, 1e12),
    )


@query(f"""with {ARGUMENTS}, t as (select *, 1 / size - 1 / 25e0 as r, exp((1 / size - 1 / 25e0) * 50) as grown from p), c as (select *, 299792458e0 * 31557600 / 3.0856775814913673e16 as c from t),
    x as (select p_partkey, greatest(0, 1 - size / 25) as settled_share, 0.3e0 * 0.7e0 / size - 0.3e0 / 25 as settled_rate,
    case when abs(r) < 1e-15 then 0.3e0 / (1 + 0.3e0 * 50 / size) else 0.3e0 * grown / (1 + 0.3e0 * (grown - 1) / (size * r)) end as settled_at, price / c as one_way, 2 * (price / c) as both_ways,
    (price + 0.1e0 / c * (price + size)) / (1 + 0.1e0 / c) as news, least(size + 16 / (16 / (2 * (size + 3)) + (size + 3)), 40) as passed from c) select p_partkey, round(columns(* exclude (p_partkey)), 6) from x""")
def settlement_grid(spark: SparkSession, d: str) -> DataFrame:
    """Shares that settle in the end, now and after 50 years; light's travel; news that meets a probe; speed after passing a star."""
    one, both = neighbours.light_years(F.col("price"))
    return grid(
        spark, d, settled_share=plant.settled_share(F.col("size"), 25.0), settled_rate=plant.settled_rate(0.3, F.col("size"), 25.0), settled_at=plant.settled_at(0.3, F.col("size"), 25.0, 50.0), one_way=one, both_ways=both,
        news=neighbours.news_meets(F.col("price"), F.col("price") + F.col("size"), F.lit(0.1)), passed=neighbours.slingshot(F.col("size"), F.lit(3.0), F.lit(4.0), F.lit(40.0)),
    )


#: Venues of many kinds, and the rules by which SQL tells their kinds.
VENUE_TEXTS = ("A textbook of it", "NASA report 7", "RFC 9171", "Journal of Things", "Proc. 12 (3)", "a web page", "ISBN 0-1, a review", "Signature notes", "Acta 7")
_VENUES = "['" + "', '".join(VENUE_TEXTS) + "']"
_KIND = r"""case when regexp_matches(lower(venue), 'textbook|isbn') then 'book' when regexp_matches(lower(venue), 'nasa|ntrs|report|technical') then 'techreport' when regexp_matches(lower(venue), '\brfc\b|\biau\b|astm|codata|standard') then 'misc'
    when regexp_matches(lower(venue), 'journal|transactions|trans\.|review|letters|\bnature\b|pnas|geophys|acta|astronom|env\.|environmental|\bj\.\b|doi|\d+\s*\(\d+\)|\d+:\d+') then 'article' else 'misc' end"""


@query(rf"""with n as (select p_partkey, p_name, p_brand, p_type, '\cite[p. 3]{{' || p_type || ', a' || p_size || '}} and \citep*{{b,' || p_type || '}}, \citeauthor{{no}}' as tex, p_size / 7e0 as days, {_VENUES}[1 + p_partkey % {len(VENUE_TEXTS)}] as venue from part), k as (select *, {_KIND} as kind from n)
    select p_partkey, list_sort(list_distinct(['b', 'a' || regexp_extract(tex, ', a(\d+)', 1), p_type])) as cited, replace(p_brand, '#', '\#') as escaped, kind, upper(p_name) = p_name as shouts,
    '@' || kind || '{{k' || p_partkey || ',' || chr(10) || '  title = {{{{' || p_name || '}}}},' || chr(10) || '  author = {{Maker, Jr., A. ' || chr(65 + (p_partkey % 26)::int) || '. and {{' || replace(p_brand, '#', '\#') || '}} and others}},' || chr(10) || '  year = {{' || (1950 + p_partkey % 70) || '}},' || chr(10) ||
    '  ' || case kind when 'article' then 'journal' when 'book' then 'publisher' when 'techreport' then 'institution' else 'howpublished' end || ' = {{' || venue || '}},' || chr(10) ||
    case when p_partkey % 2 = 0 then '  url = {{http://x.example/' || p_partkey || '}},' else '  note = {{Cited by reference; no online link.}},' end || chr(10) || '}}' as entry,
    case when p_partkey % 4 = 0 then 'never' else printf('%.0f d (%.2f y)', days, days / 365.25) end as shown, case when p_partkey % 3 = 0 then 'unbounded' else printf('%.1f', days) end as rate from k""")
def reference_texts(spark: SparkSession, d: str) -> DataFrame:
    """Keys that TeX cites, escaped text, kinds of venues, entries of a bibliography, spans of time as shown."""
    p, key = table(spark, d, "part"), F.col("p_partkey")
    tex = F.concat(F.lit("\\cite[p. 3]{"), "p_type", F.lit(", a"), F.col("p_size").cast("string"), F.lit("} and \\citep*{b,"), "p_type", F.lit("}, \\citeauthor{no}"))
    venue = F.element_at(F.array(*map(F.lit, VENUE_TEXTS)), (F.pmod(key, F.lit(len(VENUE_TEXTS))) + 1).cast("int"))
    shown = F.concat(F.lit("A. "), F.char(65 + F.pmod(key, F.lit(26))), F.lit(". Maker Jr. & "), "p_brand", F.lit(" (ed.) et al."))
    url = F.when(F.pmod(key, F.lit(2)) == 0, F.concat(F.lit("http://x.example/"), key.cast("string")))
    entry, days = text.source_entry(F.concat(F.lit("k"), key.cast("string")), F.col("p_name"), shown, 1950 + F.pmod(key, F.lit(70)), venue, url), F.col("p_size") / 7
    return p.select(
        "p_partkey", text.cited(tex).alias("cited"), text.escaped(F.col("p_brand")).alias("escaped"), text.entry_type(venue).alias("kind"), (F.upper("p_name") == F.col("p_name")).alias("shouts"), entry.alias("entry"),
        text.days_or_never(F.when(F.pmod("p_partkey", F.lit(4)) != 0, days)).alias("shown"), text.rate_or_unbounded(F.when(F.pmod("p_partkey", F.lit(3)) == 0, float("inf")).otherwise(days)).alias("rate"),
    )


@query(r"""with t as (select doc_id, '\emph{' || translate(substr(text, 1, 40), '{}\~$%', '      ') || '}~at 20{,}000 Per Cent,  5\% of $x$ ' || chr(10) || text as tex from documents),
    n as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(tex, '\%', '%'), '$', ''), '~', ' '), '\\(?:emph|textbf|textit|texttt|mbox)\{([^}]*)\}', '\1', 'g'), '(\d)\{,\}(\d)', '\1,\2', 'g'), '\bper\s?cent\b', '%', 'gi'), '\s*%', '%', 'g') as x from t)
    select doc_id, md5(lower(trim(regexp_replace(x, '\s+', ' ', 'g')))) as digest from n""")
def abstract_texts(spark: SparkSession, d: str) -> DataFrame:
    """Digests of documents as one compares abstracts, with TeX put before them."""
    start = F.translate(F.substring("text", 1, 40), "{}\\~$%", "      ")
    tex = F.concat(F.lit("\\emph{"), start, F.lit("}~at 20{,}000 Per Cent,  5\\% of $x$ \n"), "text")
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalised(tex)).alias("digest"))


@query(f"""with {ARGUMENTS} select p_partkey, round(size * 7e9 / 1e9, 6) as ceiling, round(price * size / 7e9 * 1e6, 6) as years, round(size * {flight.electrolysis_kwh_per_kg_water()!r}::double, 6) as kwh from p""")
def market_grid(spark: SparkSession, d: str) -> DataFrame:
    """What a market takes over years, and the energy that splits water."""
    return grid(spark, d, ceiling=flight.value_ceiling(F.col("size"), 7e9) / 1e9, years=flight.years_to_absorb(F.col("price") * F.col("size"), 7e9) * 1e6, kwh=F.col("size") * flight.electrolysis_kwh_per_kg_water())
