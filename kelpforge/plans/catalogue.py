"""The queries over the driver tables that show the operators, and the SQL that gives the same rows in DuckDB.

Sums of doubles depend on the order of adding, so both sides round them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpforge.functions import flight, plant, random, sunlight, text
from kelpforge.operators import bom, graph, growth, neighbours, paired, uncertainty
from kelpforge.session import table, with_checkpoints

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(d: DataFrame, digits: int = 6) -> DataFrame:
    return d.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in d.dtypes])


def parts_of_nations(spark: SparkSession, d: str) -> DataFrame:
    """Line items as parts: the customer's nation builds, what a supplier of the same nation sends is local, the quantity is the mass."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    x = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return x.withColumn("local", F.col("s_nationkey") == F.col("c_nationkey"))


PARTS = """(select * , s_nationkey = c_nationkey as local from lineitem join orders on l_orderkey = o_orderkey
    join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)"""


@query(f"""select c_nationkey, round(sum(l_quantity), 6) as total, round(sum(case when local then l_quantity else 0 end), 6) as local,
    round(sum(l_quantity) - sum(case when local then l_quantity else 0 end), 6) as imported,
    round(sum(case when local then l_quantity else 0 end) / sum(l_quantity), 6) as closure from {PARTS} group by c_nationkey""")
def closure_by_nation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bom.closure(parts_of_nations(spark, d), ["c_nationkey"], "l_quantity").select("c_nationkey", "total", "local", "imported", "closure"))


@query(f"""select l_orderkey, round(sum(l_quantity), 6) as total, round(coalesce(sum(case when local then l_quantity else 0 end) / nullif(sum(l_quantity), 0), 0), 6) as closure,
    round(sum(l_quantity * l_extendedprice), 4) as energy, round(sum(case when local then l_quantity * l_extendedprice else 0 end), 4) as local_energy from {PARTS} group by l_orderkey""")
def closure_by_order(spark: SparkSession, d: str) -> DataFrame:
    c = bom.closure(parts_of_nations(spark, d), ["l_orderkey"], "l_quantity", energy="l_extendedprice")
    return c.select("l_orderkey", F.round("total", 6).alias("total"), F.round("closure", 6).alias("closure"), F.round("energy", 4).alias("energy"), F.round("local_energy", 4).alias("local_energy"))


@query(f"""with p as (select c_nationkey, l_suppkey, local, sum(l_quantity) as mass from {PARTS} group by all),
    s as (select *, mass / sum(mass) over (partition by c_nationkey) as share from p)
    select c_nationkey, l_suppkey, mass, round(share, 6) as share, row_number() over (partition by c_nationkey order by mass desc, l_suppkey) as rank from s where not local""")
def import_list(spark: SparkSession, d: str) -> DataFrame:
    p = parts_of_nations(spark, d).groupBy("c_nationkey", "l_suppkey", "local").agg(F.sum("l_quantity").alias("mass"))
    return bom.import_list(p, ["c_nationkey"], tie=["l_suppkey"]).select("c_nationkey", "l_suppkey", "mass", F.round("share", 6).alias("share"), "rank")


@query(f"""with p as (select c_nationkey, l_quantity as q, local, local or p_type in ('ECONOMY', 'PROMO') as after_local from {PARTS} join part on l_partkey = p_partkey),
    c as (select c_nationkey, sum(case when local then q else 0 end) / sum(q) as b, sum(case when after_local then q else 0 end) / sum(q) as a from p group by 1)
    select c_nationkey, round(b, 6) as closure_before, round(a, 6) as closure_after, round(b - a, 6) as closure_delta from c""")
def wall_whatif(spark: SparkSession, d: str) -> DataFrame:
    """What closure becomes if two kinds of parts are made at home."""
    p = parts_of_nations(spark, d).join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    sides = bom.closure(bom.variants(p, ["ECONOMY", "PROMO"], "p_type"), ["c_nationkey", "variant"], "l_quantity")
    return rounded(bom.before_after(sides, ["c_nationkey"], ["closure"]))


@query("""with b as (select p_brand, count(*) / sum(count(*)) over () as share from part group by p_brand), there as (select list(p_brand) as brands from b where share >= 0.04),
    r as (select l_orderkey, sum(l_quantity) as mass, list(distinct p_brand) as required from lineitem join part on l_partkey = p_partkey group by 1)
    select o_orderpriority, round(sum(mass), 6) as total, round(sum(case when list_has_all(brands, required) then mass else 0 end), 6) as makeable,
    round(sum(case when list_has_all(brands, required) then mass else 0 end) / sum(mass), 6) as ceiling from r join orders on l_orderkey = o_orderkey, there group by 1""")
def containment_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """Share of mass in orders all of whose brands are common ones."""
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    n = part.groupBy("p_brand").count()
    share = n.withColumn("share", F.col("count") / F.sum("count").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    there = share.agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "share"))).alias("composition")).select(bom.available(F.col("composition"), F.lit(0.04)).alias("available"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))
    orders = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("mass"), F.collect_set("p_brand").alias("required"))
    orders = orders.join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).join(F.broadcast(there))  # one row
    return rounded(bom.closure_ceiling(orders, ["o_orderpriority"]))


@query(f"""with c as (select c_nationkey, sum(case when local then l_quantity else 0 end) / sum(l_quantity) as closure from {PARTS} group by 1),
    m as (select *, (1 - closure) * 900000 as imported from c)
    select c_nationkey, round(100000 + imported, 4) as launched_kg, round(1e6 / (100000 + imported), 6) as leverage, round((100000 + imported) / 1e6, 6) as cost_ratio, round((1e6 - 100000 - imported) * 3000, 2) as saved_usd from m""")
def launch_compare(spark: SparkSession, d: str) -> DataFrame:
    c = bom.closure(parts_of_nations(spark, d), ["c_nationkey"], "l_quantity")
    built = F.greatest(F.lit(0.0), F.lit(1e6) - 1e5)
    x = c.select("c_nationkey", flight.launch_comparison(1e6, 1e5, flight.imports_of(F.col("closure"), built), 3000.0).alias("x"))
    return x.select("c_nationkey", F.round("x.launched_kg", 4).alias("launched_kg"), F.round("x.leverage", 6).alias("leverage"), F.round("x.cost_ratio", 6).alias("cost_ratio"), F.round("x.saved_usd", 2).alias("saved_usd"))


DISTANCES = (0.4, 0.7, 1.0, 1.524, 2.77, 5.203, 9.5)


@query("""with v(au) as (values (0.4::double), (0.7::double), (1.0::double), (1.524::double), (2.77::double), (5.203::double), (9.5::double)), p as (select p_partkey, p_size * 100.0::double as area, au, 1360.8::double / (au * au) as irradiance from part, v)
    select p_partkey, au, round(irradiance, 6) as irradiance, round(irradiance * area * 0.3, 4) as watts, round(irradiance * area * 0.3 * 0.7, 4) as manufacturing, round(irradiance * area * 0.3 * 0.2 * 1e11 / 1e18, 9) as brains,
    case when 100 / (au * au) >= 6.7 then 'solar' when area < 1000 then 'rtg' else 'fission' end as source, round(least(56 / (au * au), 267), 6) as mbps, round(1 - exp(-9400 / (311 * 9.80665::double)), 9) as propellant from p""")
def mission_grid(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of many sizes at many distances: power, its split, computing, the better source, the link, the launch."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * F.lit(100.0)).alias("area")).withColumn("au", F.explode(F.array(*map(F.lit, DISTANCES))))
    watts = sunlight.array_watts(F.col("area"), 0.3, F.col("au"))
    p = p.withColumn("watts", watts).withColumn("split", sunlight.power_split(F.col("watts"), 0.7, 0.2, 0.1))
    brains = sunlight.brains(sunlight.ops_of(F.col("split.compute"), 1e11))
    return p.select("p_partkey", "au", F.round(sunlight.irradiance(F.col("au")), 6).alias("irradiance"), F.round("watts", 4).alias("watts"), F.round("split.manufacturing", 4).alias("manufacturing"), F.round(brains, 9).alias("brains"), plant.power_source(F.col("au"), F.col("area")).alias("source"), F.round(plant.link_mbps(F.col("au")), 6).alias("mbps"), F.round(flight.propellant_share(9400.0, flight.exhaust_speed(311.0)), 9).alias("propellant"))


@query("""with recursive p as (select p_partkey, p_size * 100.0::double as area, p_retailprice * 20 as need from part),
    b(p_partkey, area, need, lo, hi, i) as (select p_partkey, area, need, 0.3::double, 40.0::double, 0 from p union all
      select p_partkey, area, need, case when 1360.8::double / ((lo + hi) / 2 * (lo + hi) / 2) * area * 0.3 >= need then (lo + hi) / 2 else lo end,
      case when 1360.8::double / ((lo + hi) / 2 * (lo + hi) / 2) * area * 0.3 >= need then hi else (lo + hi) / 2 end, i + 1 from b where i < 16)
    select p_partkey, round(case when not 1360.8::double / 0.09 * area * 0.3 >= need then null when 1360.8::double / 1600 * area * 0.3 >= need then 40 else lo end, 6) as reach, 1360.8::double / 1600 * area * 0.3 >= need as saturated from b where i = 16""")
def range_bisection(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * F.lit(100.0)).alias("area"), (F.col("p_retailprice") * 20).alias("need"))
    found = growth.bisected(0.3, 40.0, 1e-3, lambda au: sunlight.array_watts(F.col("area"), 0.3, au) >= F.col("need"))
    return p.select("p_partkey", found.alias("f")).select("p_partkey", F.round("f.reach", 6).alias("reach"), "f.saturated")


@query("""with p as (select p_partkey, (0.5 + p_size / 25e0) * 149597870700 as r1, (0.45 + p_partkey % 97 / 10e0) * 149597870700 as r2 from part),
    x as (select *, sqrt(1.32712440018e20 / r1) * (sqrt(2 * r2 / (r1 + r2)) - 1) as dv1, sqrt(1.32712440018e20 / r2) * (1 - sqrt(2 * r1 / (r1 + r2))) as dv2 from p)
    select p_partkey, round(dv1, 4) as dv1, round(dv2, 4) as dv2, round(abs(dv1) + abs(dv2), 4) as dv, round(pi() * sqrt(pow(r1 + r2, 3) / (8 * 1.32712440018e20)) / 86400, 4) as days,
    round(sqrt(1.32712440018e20 / r1 - 2 * sqrt(1.32712440018e20 / r1) * sqrt(1.32712440018e20 / r2) + 1.32712440018e20 / r2), 4) as spiral from x""")
def transfer_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Transfers between orbits that parts' sizes and keys give."""
    r1, r2 = 0.5 + F.col("p_size") / 25, 0.45 + F.pmod("p_partkey", F.lit(97)) / 10
    x = table(spark, d, "part").select("p_partkey", flight.two_burn_transfer(r1, r2).alias("t"), flight.spiral_delta_v(r1, r2).alias("spiral"))
    return x.select("p_partkey", *[F.round(f"t.{c}", 4).alias(c) for c in ("dv1", "dv2", "dv", "days")], F.round("spiral", 4).alias("spiral"))


def growth_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Parts as factories: closure from the size, rate from the price; what else the closed form needs."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("run"),
        F.lit(1000.0).alias("seed"),
        (F.col("p_retailprice") / 1000 / 400).alias("alpha"),
        (0.5 + F.col("p_size") / 102.0).alias("closure"),
        (F.col("p_size") * 2.0).alias("energy_cap"),
        (F.pmod("p_partkey", F.lit(7)) * 1.5).alias("resupply"),
        F.lit(20.0).alias("target"),
        F.lit(1500).alias("days"),
        F.lit(10.0).alias("dt"),
    )


_GROWTH = """p as (select p_partkey as run, 1000.0::double as seed, p_retailprice / 1000 / 400 as alpha, 0.5 + p_size / 102.0::double as closure, p_size * 2.0::double as cap, (p_partkey % 7) * 1.5::double as resupply from part),
    q as (select *, case when closure >= 1 then 'inf'::double when resupply <= 0 then 0 else resupply / (1 - closure) end as other from p), k as (select *, least(cap / closure, other) as most, least(cap / closure, other) * closure / alpha as kink from q)"""
_MASS = """case when seed >= kink then seed + most * {t} when {t} <= closure / alpha * ln(kink / seed) then seed * exp(alpha * {t} / closure) else kink + most * ({t} - closure / alpha * ln(kink / seed)) end"""


@query(f"""with {_GROWTH}, f as (select *, {_MASS.format(t="1500")} as mass from k) select run, round(mass, 4) as final_mass, round(least(alpha * mass, cap), 6) as final_output, least(alpha * mass, cap) >= 20 as reaches from f""")
def growth_final(spark: SparkSession, d: str) -> DataFrame:
    return growth.final(growth_parameters(spark, d)).select("run", F.round("final_mass", 4).alias("final_mass"), F.round("final_output", 6).alias("final_output"), "reaches")


_GRID = f"{_GROWTH}, g as (select *, s * 10.0::double as day, {_MASS.format(t='(s * 10.0::double)')} as mass from k, range(0, 151) r(s)), h as (select *, least(alpha * mass, cap) as output from g)"


@query(f"""with {_GRID}, l as (select *, lag(day) over w as day0, lag(output) over w as out0 from h window w as (partition by run order by s)),
    c as (select run, min(case when output >= 20 then struct_pack(s := s, x := case when s = 0 then 0 when output = out0 then day else day0 + (20 - out0) / (output - out0) * (day - day0) end) end) as m from l group by run)
    select run, round(m.x, 6) as target_day from c""")
def growth_crossings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(growth.first_crossing(growth.grid(growth_parameters(spark, d)), ["run"], ["step"], "day", "output", F.col("target"), "target_day"))


@query(f"""with {_GRID}, r as (select *, case when other < least(alpha * mass, cap) / closure then 'resupply-limited' when alpha * mass <= cap then 'material-limited' else 'energy-limited' end as regime from h),
    n as (select *, case when lag(regime) over w = regime or lag(regime) over w is null then 0 else 1 end as new from r window w as (partition by run order by s)), i as (select *, sum(new) over (partition by run order by s) as span from n)
    select run, span::bigint as span, min(regime) as regime, min(day) as first, max(day) as last, count(*) as n from i group by run, span""")
def growth_spans(spark: SparkSession, d: str) -> DataFrame:
    return growth.spans(growth.grid(growth_parameters(spark, d)), ["run"], ["step"], "regime", "day").withColumn("span", F.col("span").cast("long"))


_FAULTS = """count(*) filter (abs(output - least(installed, cap)) > 1e-9 * greatest(1, abs(output)) or abs(installed - alpha * mass) > 1e-9 * greatest(1, abs(installed)) or mass < seed - 1e-9 * greatest(1, seed)
    or coalesce(mass < before - 1e-9 * greatest(1, before), false))::bigint"""


@query(f"""with {_GRID}, a as (select run, s, seed, alpha, cap, mass, alpha * mass as installed, output from h), bad as (select run, s, seed, alpha, cap, case when run % 50 = 3 and s = 75 then mass / 2 else mass end as mass,
    case when run % 50 = 4 and s = 20 then installed + 1 else installed end as installed, case when run % 50 = 5 and s >= 149 then output * 1.5 else output end as output from a)
    select 'as computed' as side, {_FAULTS} as faults from (select *, lag(mass) over (partition by run order by s) as before from a) union all select 'with faults', {_FAULTS} from (select *, lag(mass) over (partition by run order by s) as before from bad)""")
def invariants(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the growth grid that break what must hold: as computed, and where some masses, capacities and outputs have been changed."""
    g = growth.grid(growth_parameters(spark, d))
    at = lambda k, s: (F.pmod("run", F.lit(50)) == k) & s
    broken = g.withColumns({"mass": F.when(at(3, F.col("step") == 75), F.col("mass") / 2).otherwise(F.col("mass")), "installed": F.when(at(4, F.col("step") == 20), F.col("installed") + 1).otherwise(F.col("installed")), "output": F.when(at(5, F.col("step") >= 149), F.col("output") * 1.5).otherwise(F.col("output"))})
    faults = lambda rows, side: growth.trace_faults(rows).agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("faults"))
    return faults(g, "as computed").unionByName(faults(broken, "with faults"))


@query("""with n as (select *, case when lag(event_type) over w is distinct from event_type and row_number() over w > 1 then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
    i as (select *, sum(new) over (partition by user_id order by ts, event_id) as span from n) select user_id, span::bigint as span, min(event_type) as event_type, min(ts) as first, max(ts) as last, count(*) as n from i group by user_id, span""")
def event_runs(spark: SparkSession, d: str) -> DataFrame:
    return growth.spans(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "ts").withColumn("span", F.col("span").cast("long"))


@query("""with c as (select user_id, event_id, row_number() over w as k, sum(abs(value)) over w as total from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)),
    l as (select *, lag(k) over w as k0, lag(total) over w as t0 from c window w as (partition by user_id order by k)),
    m as (select user_id, min(case when total >= 500 then struct_pack(k := k, x := case when k = 1 then 0 when total = t0 then k else k0 + (500 - t0) / (total - t0) * (k - k0) end) end) as m from l group by 1) select user_id, round(m.x, 4) as crossing from m""")
def cumulative_crossing(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events").select("user_id", "event_id", F.count(F.lit(1)).over(w).cast("double").alias("k"), F.sum(F.abs("value")).over(w).alias("total"))
    return rounded(growth.first_crossing(e, ["user_id"], ["k"], "k", "total", F.lit(500.0), "crossing"), 4)


_MUL = lambda a, b: f"(({a})::hugeint * ({b})::hugeint % 4294967296)::bigint"
_U32 = f"""a as (select *, (seed + {_MUL('(k + 1) % 4294967296', '1831565813')}) % 4294967296 as s0 from d), b as (select *, {_MUL('xor(s0, s0 >> 15)', 's0 | 1')} as s1 from a),
    c as (select *, xor(s1, (s1 + {_MUL('xor(s1, s1 >> 7)', 's1 | 61')}) % 4294967296) as s2 from b), u as (select *, xor(s2, s2 >> 14) as draw from c)"""


@query(f"""with d as (select o_orderkey as k, 12345::bigint as seed from orders), {_U32} select k, draw, draw / 4294967296.0::double as uniform from u""")
def counter_draws(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("k"), random.draw32(F.lit(12345), k).alias("draw"), random.uniform(F.lit(12345), k).alias("uniform"))


INPUTS = {"a": random.Input("uniform", 1, 3), "b": random.Input("loguniform", 0.5, 8), "c": random.Input("fixed", 2)}


def finding(x: dict[str, Column]) -> Column:
    return x["a"] * x["b"] + F.sqrt(x["a"]) * x["c"]


@query(f"""with d as (select i * 3 + j as k, i, j, 42::bigint as seed from (select o_orderkey as i from orders) r, range(0, 2) s(j)), {_U32}, w as (select i, max(case when j = 0 then 1 + 2 * (draw / 4294967296.0::double) end) as a, max(case when j = 1 then 0.5 * exp(draw / 4294967296.0::double * ln(16)) end) as b from u group by i),
    y as (select (a * b + sqrt(a) * 2) * o_totalprice / 1e5 as y from w join orders on o_orderkey = i) select count(*) as n, round(avg(y), 6) as mean, round(stddev_pop(y), 6) as sd, round(quantile_cont(y, 0.05), 6) as q05, round(quantile_cont(y, 0.5), 6) as q50, round(quantile_cont(y, 0.95), 6) as q95, round(stddev_pop(y) / sqrt(count(*)), 6) as stderr from y""")
def mc_summary(spark: SparkSession, d: str) -> DataFrame:
    """What orders come to, each under a draw of its own of what is uncertain."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("draw"), "o_totalprice")
    return rounded(uncertainty.summary(uncertainty.monte_carlo(spark, INPUTS, lambda x: finding(x) * F.col("o_totalprice") / 1e5, 0, 42, orders)))


def _sobol_sql(i: str, dim: int) -> str:
    """The i-th point's coordinate: the direction numbers of the bits that its Gray code has."""
    x = "0::bigint"
    for bit, v in enumerate(random.directions(dim)):
        x = f"xor({x}, (xor({i}, {i} >> 1) >> {bit} & 1) * {v}::bigint)"
    return f"(({x}) / {2.0**random.SOBOL_BITS!r}::double)"


_AT = {"a": "(1 + 2 * {u})", "b": "(0.5 * exp({u} * ln(16)))"}  # INPUTS, c is fixed
_Y = lambda a, b: f"({a} * {b} + sqrt({a}) * 2)"  # noqa: E731  finding


@query(f"""with p as (select p_size, {", ".join(f"{_sobol_sql('(p_partkey + 1)', j)} as p{j}" for j in range(2))} from part), d as (select r * 3 + j as k, r, j, 5::bigint as seed from range(0, 16) a(r), range(0, 2) b(j)), {_U32},
    s as (select r, max(case when j = 0 then draw / 4294967296.0::double end) as s0, max(case when j = 1 then draw / 4294967296.0::double end) as s1 from u group by r),
    m as (select r, avg(p_size * {_Y(_AT["a"].format(u="((p0 + s0) % 1)"), _AT["b"].format(u="((p1 + s1) % 1)"))}) as y from p, s group by r), e as (select avg(y) as mean, stddev_pop(y) / sqrt(count(y)) as stderr from m)
    select round(mean, 6) as mean, round(stderr, 6) as stderr, round(mean - 1.645 * stderr, 6) as lo, round(mean + 1.645 * stderr, 6) as hi, (select 16 * count(*) from part) as evaluations from e""")
def qmc_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean over parts, each of which is a point of the set."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return rounded(uncertainty.qmc_mean(spark, INPUTS, lambda x: F.col("p_size") * finding(x), 0, 5, rows=parts))


@query(f"select i as id, {', '.join(f'{_sobol_sql("i", j)} as x{j}' for j in range(6))} from (select o_orderkey as i from orders)")
def sobol_points(spark: SparkSession, d: str) -> DataFrame:
    """A point for each order."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).select("id", *[random.sobol(F.col("id"), j).alias(f"x{j}") for j in range(6)])


@query("""with recursive r(id, base, n, f, x) as (select i, b, i, 1.0::double, 0.0::double from (select p_partkey as i from part), (values (2), (3), (5)) v(b) union all select id, base, n // base, f / base, x + (n % base) * (f / base) from r where n > 0)
    select id, round(max(case when base = 2 then x end), 12) as x0, round(max(case when base = 3 then x end), 12) as x1, round(max(case when base = 5 then x end), 12) as x2 from r group by id""")
def halton_points(spark: SparkSession, d: str) -> DataFrame:
    """A point for each part."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id")).select("id", *[F.round(x, 12).alias(f"x{j}") for j, x in enumerate(random.halton(F.col("id"), 3))])


_ORDERS, _SUPPLIERS = "select o_orderkey as i from orders", "select s_suppkey as i from supplier"


def _design_sql(rows: str) -> str:
    """The design of _Y over INPUTS with seed 9, for the numbers i that rows has: row, a, b, ab_i and ba_i; m has mean and variance of a and b together."""
    u = ", ".join(f"max(case when j = {j} then draw / 4294967296.0::double end) as u{j}" for j in range(6))
    return f"""d as (select i * 6 + j as k, i, j, 9::bigint as seed from ({rows}) r, range(0, 6) s(j)), {_U32}, w as (select i, {u} from u group by i),
    v as (select i, {_AT["a"].format(u="u0")} as aa, {_AT["b"].format(u="u1")} as ab, {_AT["a"].format(u="u3")} as ba, {_AT["b"].format(u="u4")} as bb from w),
    t as (select i, {_Y("aa", "ab")} as ya, {_Y("ba", "bb")} as yb, {_Y("ba", "ab")} as ab_a, {_Y("aa", "bb")} as ab_b, {_Y("aa", "ab")} as ab_c, {_Y("aa", "bb")} as ba_a, {_Y("ba", "ab")} as ba_b, {_Y("ba", "bb")} as ba_c from v),
    m as (select avg(y) as mean, var_pop(y) as var from (select ya as y from t union all select yb from t))"""


def numbered(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """Keys of a table, which number its rows from 0, as rows of a design."""
    return table(spark, d, name).select(F.col(key).alias("row"))


@query(f"""with {_design_sql(_ORDERS)}, l as (select unnest(['a', 'b', 'c']) as input, unnest([ab_a, ab_b, ab_c]) as x, ya, yb from t), e as (select input, (yb - mean) * (x - ya) / var as s, (ya - x) * (ya - x) / (2 * var) as t from l, m),
    g as (select input, avg(s) as first, 1.645 * stddev_pop(s) / sqrt(count(s)) as sh, avg(t) as total, 1.645 * stddev_pop(t) / sqrt(count(t)) as th from e group by input)
    select input, round(first, 6) as first, round(total, 6) as total, round(first - sh, 6) as first_lo, round(first + sh, 6) as first_hi, round(total - th, 6) as total_lo, round(total + th, 6) as total_hi, row_number() over (order by total desc, input) as rank from g""")
def sobol_first_total(spark: SparkSession, d: str) -> DataFrame:
    return rounded(uncertainty.sobol_indices(uncertainty.design(spark, INPUTS, finding, 0, 9, rows=numbered(spark, d, "orders", "o_orderkey")), list(INPUTS)))


_FIRST = lambda n: f"(yb - mean) * (ab_{n} - ya)"
_PAIRS = (("a", "b"), ("a", "c"), ("b", "c"))


@query(f"""with {_design_sql(_ORDERS)} {" union all ".join(f"select '{i}' as input_a, '{j}' as input_b, round(avg((ba_{i} * ab_{j} - ya * yb - {_FIRST(i)} - {_FIRST(j)}) / var), 6) as interaction from t, m" for i, j in _PAIRS)}""")
def sobol_second(spark: SparkSession, d: str) -> DataFrame:
    return rounded(uncertainty.second_order_indices(uncertainty.design(spark, INPUTS, finding, 0, 9, second_order=True, rows=numbered(spark, d, "orders", "o_orderkey")), list(INPUTS)))


@query(f"""with {_design_sql(_SUPPLIERS)}, q as (with s as (select count(*) as many from supplier), d as (select r * many + k as k, r, many, 3::bigint as seed from s, range(0, 300) a(r), (select s_suppkey as k from supplier) b), {_U32} select r, draw % many as i from u),
    z as (select r, ya, yb, ab_a, ab_b, ab_c from q join t using (i)), g as (select r, count(*) as n, sum(ya + yb) / (2 * count(*)) as mean, sum(ya * ya + yb * yb) / (2 * count(*)) as sq, sum((ya - ab_a) ** 2) as ta, sum((ya - ab_b) ** 2) as tb, sum((ya - ab_c) ** 2) as tc from z group by r),
    l as (select unnest(['a', 'b', 'c']) as input, unnest([ta, tb, tc]) / (2 * n * (sq - mean * mean)) as total from g), o as (select input, list_sort(list(total)) as v from l group by input) select input, round(v[16], 6) as total_lo, round(v[285], 6) as total_hi from o""")
def sobol_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of totals where each supplier is a row of the design."""
    rows = numbered(spark, d, "supplier", "s_suppkey")
    return rounded(uncertainty.bootstrap_indices(uncertainty.design(spark, INPUTS, finding, 0, 9, rows=rows), list(INPUTS), 300, 3, rows.count()))


def two_modes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return paired.paired(e, ["user_id"], "event_type", "click", "view", ["v", "n"])


_MODES = """e as (select user_id, event_type, sum(value) as v, count(*) as n from events group by 1, 2), m as (select b.user_id, b.v as v_base, b.n as n_base, t.v as v_treated, t.n as n_treated from e b join e t on b.user_id = t.user_id and b.event_type = 'view' and t.event_type = 'click')"""


@query(f"with {_MODES} select user_id, n_base, n_treated, round(100 * (v_treated - v_base) / nullif(v_base, 0), 4) as change from m")
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    m = two_modes(spark, d)
    return m.select("user_id", "n_base", "n_treated", F.round(paired.percent_change(F.col("v_treated"), F.col("v_base")), 4).alias("change"))


@query(f"""with {_MODES}, x as (select user_id % 10 as g, n_treated - n_base as diff from m), s as (select g, count(*) as n, median(diff) as median, list_sort(list(diff)) as v, avg(diff) as mean, count(*) filter (diff > 0) as positive, count(*) filter (diff != 0) as nonzero from x group by g)
    select g, n, median::double as median, v[n // 4 + 1] as q1, v[3 * n // 4 + 1] as q3, round(mean, 6) as mean, positive, nonzero,
    round(case when nonzero = 0 then 1 else least(1, 2 * list_sum(list_transform(range(0, least(positive, nonzero - positive) + 1), lambda i: exp(lgamma(nonzero + 1) - lgamma(i + 1) - lgamma(nonzero - i + 1) - nonzero * ln(2))))) end, 6) as p from s""")
def sign_test(spark: SparkSession, d: str) -> DataFrame:
    x = two_modes(spark, d).select(F.pmod("user_id", F.lit(10)).alias("g"), (F.col("n_treated") - F.col("n_base")).alias("diff"))
    return rounded(paired.summarised(x, ["g"], "diff"))


@query("""select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 6) as through_origin from lineitem group by 1""")
def slopes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(paired.slope(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity"))


@query("""with b as (select event_type, pow(2, floor(log2(1 + user_id)))::bigint as k, avg(value) as v from events group by 1, 2), g as (select a.event_type, a.k, (n.v - a.v) / a.v as grows from b a left join b n on n.event_type = a.event_type and n.k = 2 * a.k)
    select event_type, min(case when grows < 0.01 then k end) as plateau from g group by 1""")
def plateau(spark: SparkSession, d: str) -> DataFrame:
    k = F.pow(F.lit(2.0), F.floor(F.log2(1 + F.col("user_id")))).cast("long")
    ladder = table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.avg("value").alias("v"))
    found = paired.plateau(ladder.withColumn("k", F.col("k").cast("double")), ["event_type"], "k", "v", 0.01)
    return found.withColumn("plateau", F.col("plateau").cast("long"))


@query("""select l_linestatus, count(*) as n, round(sum(l_quantity), 4) as quantity from lineitem group by 1""")
def shard_merge(spark: SparkSession, d: str) -> DataFrame:
    """Four shards put together again, with a check that none is missing."""
    lines = table(spark, d, "lineitem").select("l_linestatus", "l_quantity", F.pmod("l_orderkey", F.lit(4)).cast("int").alias("shard"))
    whole = paired.merged(lines, "shard", 4)
    return whole.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


def stars(spark: SparkSession, d: str) -> DataFrame:
    """A projection of the embeddings: their first three components as places."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("star"), *[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyz")], F.when(F.pmod("label", F.lit(3)) == 0, F.col("label") * 10.0).alias("settled_year"))


def lookers(spark: SparkSession, d: str) -> DataFrame:
    return stars(spark, d).select(F.col("star").alias("query"), "x", "y", "z", F.lit(30.0).alias("year"), (F.pmod("star", F.lit(2)) == 0).alias("instant"), F.array("star").alias("excluded"))


@query("""with s as (select vec_id as star, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, case when label % 3 = 0 then label * 10.0 end as settled from embeddings),
    p as (select q.star as query, s.star, (q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y) + (q.z - s.z) * (q.z - s.z) as d2, q.star % 2 = 0 as instant, s.settled from s q, s where q.star != s.star),
    v as (select * from p where d2 <= 0.09 * 0.09 and not (settled is not null and settled <= 30 and (instant or settled + sqrt(d2) / (299792458.0 * 31557600 / 3.0856775814913673e16) <= 30))),
    r as (select *, row_number() over (partition by query order by d2, star) as rank from v) select query, star, round(d2, 9) as d2, rank from r where rank <= 3""")
def knn_visible_near(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest within a cell's size that one does not believe settled, by an equi-join on cells."""
    found = neighbours.nearest_within(lookers(spark, d), stars(spark, d), 3, 0.09)
    return found.select("query", "star", F.round("d2", 9).alias("d2"), F.col("rank").cast("long").alias("rank"))


@query("""with s as (select vec_id as star, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, case when label % 3 = 0 then label * 10.0 end as settled from embeddings),
    p as (select q.star as query, s.star, (q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y) + (q.z - s.z) * (q.z - s.z) as d2, q.star % 2 = 0 as instant, s.settled from s q, s where q.star != s.star),
    v as (select * from p where not (settled is not null and settled <= 30 and (instant or settled + sqrt(d2) / (299792458.0 * 31557600 / 3.0856775814913673e16) <= 30))),
    r as (select *, row_number() over (partition by query order by d2, star) as rank from v) select query, star, round(d2, 9) as d2, rank from r where rank <= 3""")
def knn_visible(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest that one does not believe settled, however far, by equi-joins on growing cells."""
    found = neighbours.nearest(lookers(spark, d), stars(spark, d), 3)
    return found.select("query", "star", F.round("d2", 9).alias("d2"), F.col("rank").cast("long").alias("rank"))


@query("""select len(list_filter([1000.0, 5000.0, 10000.0, 20000.0, 40000.0, 80000.0], lambda e: e <= l_extendedprice)) as bin, count(*) as n from lineitem group by 1""")
def fixed_bins(spark: SparkSession, d: str) -> DataFrame:
    edges = [1000.0, 5000.0, 10000.0, 20000.0, 40000.0, 80000.0]
    return table(spark, d, "lineitem").groupBy(neighbours.edge_bin(F.col("l_extendedprice"), edges).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""with c as (select user_id, event_id, value, row_number() over w * 1.0 / count(*) over (partition by user_id) as coverage, row_number() over w as k from events window w as (partition by user_id order by ts, event_id)),
    x as (select user_id, bin, value, k from c, (values (0.25), (0.5), (0.75), (0.9)) v(bin) where coverage >= bin) select user_id, bin::double as bin, arg_min(value, k) as value from x group by 1, 2""")
def coverage_asof(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("k", F.row_number().over(w))
    e = e.withColumn("coverage", F.col("k") / F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    return paired.at_coverage(e, ["user_id"], "coverage", "k", "value", [0.25, 0.5, 0.75, 0.9])


@query("""select case when value <= 1 then 'room' when value <= 10 then 'planet' when value <= 50 then 'system' else 'beyond' end as rung, count(*) as n from events group by 1""")
def band_lookup(spark: SparkSession, d: str) -> DataFrame:
    rung = neighbours.band(F.col("value"), [(1, "room"), (10, "planet"), (50, "system")], "beyond")
    return table(spark, d, "events").groupBy(rung.alias("rung")).agg(F.count(F.lit(1)).alias("n"))


@query("""with recursive e as (select distinct s_nationkey % 25 as src, (s_suppkey * 7 + 3) % 25 as dst from supplier where s_nationkey % 25 != (s_suppkey * 7 + 3) % 25), r(node) as (select 3::bigint union select e.src from r join e on e.dst = r.node) select node from r""")
def reach(spark: SparkSession, d: str) -> DataFrame:
    """Nations that reach nation 3 along edges made of suppliers."""
    s = table(spark, d, "supplier").select(F.pmod(F.col("s_nationkey").cast("long"), F.lit(25)).alias("src"), F.pmod(F.col("s_suppkey") * 7 + 3, F.lit(25)).alias("dst"))
    with_checkpoints(spark)
    return graph.reaching(s, spark.createDataFrame([(3,)], "node long"))


@query("""select doc_id, 'left' as side from (select distinct doc_id from documents where doc_id not in (select doc_id from labels)) union all select doc_id, 'right' from (select distinct doc_id from labels where doc_id not in (select doc_id from documents))""")
def two_way_except(spark: SparkSession, d: str) -> DataFrame:
    return graph.two_way_difference(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("""select page_id, url, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') as slug, list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) as links from pages""")
def extract_ids(spark: SparkSession, d: str) -> DataFrame:
    links = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))))
    return table(spark, d, "pages").select("page_id", "url", text.slug(F.col("url")).alias("slug"), links.alias("links"))


@query(r"""select md5(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g'))) as digest, count(*) as n, min(doc_id) as doc_id from documents group by 1""")
def normalised_equal(spark: SparkSession, d: str) -> DataFrame:
    digest = F.md5(F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r]+", " ")))
    return table(spark, d, "documents").groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))


@query("""select source, min(doc_id) as first_seen, row_number() over (order by min(doc_id)) as position from documents group by source""")
def first_seen_distinct(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("first_seen"))  # a row per source
    return s.withColumn("position", F.row_number().over(Window.orderBy("first_seen")).cast("long"))


@query("""select event_type, count(json_extract(props, '$.k')) as n, sum(json_extract(props, '$.k')::bigint)::bigint as total from events group by 1""")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"))


@query("""with n as (select string_split_regex(trim(regexp_replace(regexp_replace(c_name, '#', ' ', 'g'), '[ ]+', ' ', 'g')), ' ') as w, c_custkey from customer) select c_custkey, '{' || array_to_string(w, ' ') || '} and ' || case c_custkey % 3 when 0 then 'Freitas, Jr., R. A.' when 1 then 'Nicholson, A.' else 'Freitas, R. A. and {International Astronomical Union}' end || case when c_custkey % 2 = 0 then ' and others' else '' end as authors from n""")
def bibliography_names(spark: SparkSession, d: str) -> DataFrame:
    """Display strings of authors, made from customers' names and fixed ones, as a bibliography has them."""
    some = F.element_at(F.array(F.lit("R. A. Freitas Jr."), F.lit("A. Nicholson (eds.)"), F.lit("R. A. Freitas and International Astronomical Union")), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"))
    shown = F.concat(F.trim(F.regexp_replace(F.regexp_replace("c_name", "#", " "), " +", " ")), F.lit(" & "), some, F.when(F.pmod("c_custkey", F.lit(2)) == 0, " et al.").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", text.bibliography_names(shown).alias("authors"))
