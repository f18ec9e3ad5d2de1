"""Queries of studies over the given tables: surrogates of prices, resampled statistics, sweeps, changes and what they reach, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpforge.functions import documents, flight, random
from kelpforge.operators import bom, graph, growth, neighbours, paired, resampling, surrogates, uncertainty
from kelpforge.plans.catalogue import _U32, PARTS, lookers, parts_of_nations, query, rounded, stars
from kelpforge.session import fresh_folder, table, with_checkpoints
from kelpforge.sources.files import scenario_files
from kelpforge.sources.scenarios import blocks, parts, read_block, write_block, write_companion

#: What the price of a line item is fitted on.
BASES = {"l_quantity": surrogates.Basis("uniform", 1, 50), "l_discount": surrogates.Basis("uniform", 0, 0.1), "p_size": surrogates.Basis("uniform", 1, 50)}
DEGREE = 2


def priced_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with the sizes of their parts; paid: the price without the discount; u: a seeded draw for each."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"))
    x = lines.join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return x.withColumn("u", random.uniform(F.lit(77), F.col("l_orderkey") * 8 + F.col("l_linenumber")))


def _terms_sql() -> str:
    """A list of the terms of a row, in the order of their degrees."""
    psi = lambda z, k: ("1e0", f"sqrt(3e0) * {z}", f"sqrt(5e0) * (3 * {z} * {z} - 1) / 2")[k]
    return ", ".join(" * ".join(f"({psi(f'z{i}', k)})" for i, k in enumerate(a)) for a in surrogates.multi_indices(3, DEGREE))


def _fit_sql(where: str) -> str:
    """Lines as rows of terms, and coef (i, c): coefficients by elimination over the sums of products of terms."""
    n = len(surrogates.multi_indices(3, DEGREE))
    steps = "".join(
        f""", e{k} as materialized (select r.i, r.j, case when r.i = {k} then r.v / p.v else r.v - f.v * q.v / p.v end as v from e{k - 1} r, (select v from e{k - 1} where i = {k} and j = {k}) p
        join e{k - 1} f on f.i = r.i and f.j = {k} join e{k - 1} q on q.i = {k} and q.j = r.j)"""
        for k in range(1, n + 1)
    )
    return f"""d as (select l_orderkey * 8 + l_linenumber as k, l_quantity, l_discount, p_size, l_extendedprice * (1 - l_discount) as paid, 77::bigint as seed from lineitem join part on l_partkey = p_partkey), {_U32},
    z as (select *, draw / 4294967296.0::double as uu, (l_quantity - 25.5e0) / 24.5e0 as z0, (l_discount - 0.05e0) / 0.05e0 as z1, (p_size - 25.5e0) / 24.5e0 as z2 from u),
    t as materialized (select k, uu, p_size, paid, [{_terms_sql()}] as t from z), w as (select list_append(t, paid) as t from t where {where}),
    e0 as materialized (select i, j, sum(t[i] * t[j]) as v from w, range(1, {n + 1}) a(i), range(1, {n + 2}) b(j) group by i, j){steps},
    coef as materialized (select i, v as c from e{n} where j = {n + 1}), g as materialized (select *, list_dot_product(t, (select list(c order by i) from coef)) as predicted from t)"""


_NAMED = f"""named as (select * from (values {", ".join(f"({i}, {x[0]}, {x[1]}, {x[2]})" for i, x in enumerate(surrogates.multi_indices(3, DEGREE), 1))}) v(i, k0, k1, k2))"""


@query(f"""with {_fit_sql("true")}, {_NAMED}, r as (select count(*) as n, sqrt(avg((predicted - paid) * (predicted - paid))) / stddev_pop(paid) as residual from g)
    select k0 as quantity, k1 as discount, k2 as size, round(c, 4) as coefficient, n, round(residual, 8) as residual from coef join named using (i), r""")
def surrogate_terms(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of what is paid, by degrees of quantity, discount and size, and how much of it they leave."""
    s = surrogates.fit(priced_lines(spark, d), BASES, DEGREE, "paid")
    k = F.col("degrees")
    return s.table(spark).select(k[0].alias("quantity"), k[1].alias("discount"), k[2].alias("size"), F.round("coefficient", 4).alias("coefficient"), F.lit(s.n).cast("long").alias("n"), F.lit(round(s.residual, 8)).alias("residual"))


@query(f"""with {_fit_sql("true")}, {_NAMED}, l as (select [k0, k1, k2] as k, c * c as e, case when i = 1 then c end as mean from coef join named using (i)),
    s as (select max(mean) as mean, sum(case when mean is null then e end) as variance from l), i as (select unnest(['l_quantity', 'l_discount', 'p_size']) as input, unnest([1, 2, 3]) as n),
    h as (select input, sum(case when k[n] > 0 and k[n] = list_sum(k) then e end) as first, sum(case when k[n] > 0 then e end) as total from l, i group by input)
    select input, round(coalesce(first, 0) / variance, 8) as first, round(coalesce(total, 0) / variance, 8) as total, round(mean, 4) as mean, round(sqrt(variance), 4) as sd from h, s""")
def surrogate_indices(spark: SparkSession, d: str) -> DataFrame:
    """How much of the spread of what is paid comes from each input, alone and with others."""
    terms = surrogates.fit(priced_lines(spark, d), BASES, DEGREE, "paid").table(spark)
    m = surrogates.moments(terms).select(F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))
    return surrogates.indices(terms, list(BASES)).select("input", F.round("first", 8).alias("first"), F.round("total", 8).alias("total")).join(F.broadcast(m))  # one row


@query(f"""with {_fit_sql("uu < 0.25")} select p_size, count(*) as n, round(avg(predicted), 4) as predicted, round(avg(paid), 4) as paid, round(sqrt(avg((predicted - paid) * (predicted - paid))) / stddev_pop(paid), 8) as residual from g where uu >= 0.25 group by p_size""")
def surrogate_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on a quarter of the lines; what it says of the others, by size."""
    lines = priced_lines(spark, d)
    s = surrogates.fit(lines.where("u < 0.25"), BASES, DEGREE, "paid")
    apart = F.col("predicted") - F.col("paid")
    g = s.predicted(lines.where("u >= 0.25")).groupBy("p_size")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("predicted"), 4).alias("predicted"), F.round(F.avg("paid"), 4).alias("paid"), F.round(F.sqrt(F.avg(apart * apart)) / F.stddev_pop("paid"), 8).alias("residual"))


@query(f"""with {_fit_sql("uu < 0.1")}, r as (select count(*) as n, avg(paid - predicted) + (select c from coef where i = 1) as mean, var_pop(paid - predicted) as va, var_pop(paid) as vb from g where uu >= 0.1)
    select n, round(mean, 4) as mean, round(sqrt(va / n), 6) as stderr, round(mean - 1.6448536269514722 * sqrt(va / n), 4) as lo, round(mean + 1.6448536269514722 * sqrt(va / n), 4) as hi, round(vb / va, 6) as variance_ratio from r""")
def price_control_variate(spark: SparkSession, d: str) -> DataFrame:
    """The mean of what is paid if quantity, discount and size were spread evenly, steadied by a surrogate fitted on a tenth of the lines."""
    lines = priced_lines(spark, d)
    found = surrogates.control_variate(lines.where("u >= 0.1"), surrogates.fit(lines.where("u < 0.1"), BASES, DEGREE, "paid"), "paid")
    return rounded(found).withColumns({c: F.round(c, 4) for c in ("mean", "lo", "hi")})


RESAMPLES = 2000


@query(f"""with g as (select o_orderpriority, list_sort(list(o_totalprice)) as v, count(*) as n from (select o_orderpriority, avg(o_totalprice) as o_totalprice from orders group by o_orderpriority, o_custkey) where o_totalprice is not null group by 1),
    d as (select o_orderpriority, v, n, r, r * n + i as k, 7::bigint as seed from g, range(0, {RESAMPLES}) a(r), lateral (select unnest(range(0, n)) as i)), {_U32}, m as (select o_orderpriority, r, median(v[draw % n + 1]) as m from u group by 1, 2), e as (select o_orderpriority, list_sort(list(m)) as ms from m group by 1)
    select o_orderpriority, round(list_aggregate(v, 'median'), 4) as median, round(ms[{int(0.025 * RESAMPLES) + 1}], 4) as lo, round(ms[{int(0.975 * RESAMPLES) + 1}], 4) as hi from e join g using (o_orderpriority)""")
def bootstrap_median(spark: SparkSession, d: str) -> DataFrame:
    """Medians of customers' average orders, by priority."""
    o = table(spark, d, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.avg("o_totalprice").alias("v"))
    return rounded(resampling.bootstrap_median(o, ["o_orderpriority"], "v", RESAMPLES, 7), 4)


@query(f"""with g as (select floor(log2(p_size)) * log10(2e0) as x, list_sort(list(p_retailprice * (1 + p_size / 1e3))) as v, count(*) as n, row_number() over (order by x) - 1 as g from part group by 1),
    d as (select x, v, n, r, r * n + i as k, 11 + g as seed from g, range(0, {RESAMPLES}) a(r), lateral (select unnest(range(0, n)) as i)), {_U32}, m as (select x, r, median(v[draw % n + 1]) as m from u group by 1, 2),
    s as (select list_sort(list(s)) as s from (select regr_slope(m, x) as s from m group by r)), o as (select regr_slope(list_aggregate(v, 'median'), x) as slope from g) select round(slope, 6) as slope, round(s[{int(0.025 * RESAMPLES) + 1}], 6) as lo, round(s[{int(0.975 * RESAMPLES) + 1}], 6) as hi from s, o""")
def loglog_slope(spark: SparkSession, d: str) -> DataFrame:
    """How median prices grow with the order of magnitude of a part's size, with an interval from resampled prices of each."""
    p = table(spark, d, "part").select((F.floor(F.log2("p_size")) * F.log10(F.lit(2.0))).alias("x"), (F.col("p_retailprice") * (1 + F.col("p_size") / 1e3)).alias("v"))
    return rounded(resampling.slope_of_medians(p, "x", "v", RESAMPLES, 11))


@query(f"""select 'nation ' || c_nationkey as scenario, round(sum(l_quantity), 4) as total, round(sum(case when local then l_quantity else 0 end) / sum(l_quantity), 6) as closure, count(distinct l_returnflag || local) as parts from {PARTS} group by c_nationkey""")
def scenario_closure(spark: SparkSession, d: str) -> DataFrame:
    """Nations written as scenario files in YAML, a file each, and read again through the data source."""
    p = parts_of_nations(spark, d).groupBy("c_nationkey", "l_returnflag", "local").agg(F.sum("l_quantity").alias("mass"))
    mass = F.regexp_replace(F.col("mass").cast("string"), "E([0-9])", "E+$1")  # from 1e7 on; without a sign, YAML 1.1 takes it as text
    line = F.format_string("  - {name: '%s', mass_kg: %s, producible_locally: %s, processes: [a, b]}", "l_returnflag", mass, F.col("local").cast("string"))
    text = F.concat(F.format_string("# made from orders\nname: nation %s\nsubsystems:\n", F.col("c_nationkey").cast("string")), F.array_join(F.array_sort(F.collect_list(line)), "\n"))  # a line per flag and side
    path = fresh_folder(spark, "scenarios")
    p.groupBy("c_nationkey").agg(text.alias("value")).write.partitionBy("c_nationkey").text(path)
    found = parts(scenario_files(spark, path, **{"as": "yaml"})).withColumnRenamed("producible_locally", "local")
    n = found.groupBy("scenario").agg(F.count(F.lit(1)).alias("parts"))
    return bom.closure(found, ["scenario"], "mass_kg").join(n, "scenario").select("scenario", F.round("total", 4).alias("total"), F.round("closure", 6).alias("closure"), "parts")


@query("""select 'main' as block, o_orderpriority, count(*) as n from orders group by all union all select 'recent', o_orderpriority, count(*) from orders where o_orderkey % 3 = 0 group by all""")
def result_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A document of results with a companion block, which is written twice: the second time replaces the first and nothing else."""
    o, path = table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), fresh_folder(spark, "results")
    counted = lambda rows: rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    write_block(counted(o), path, "main", "result_blocks", {"of": "all"})
    for k in (2, 3):
        write_companion(counted(o.where(F.pmod("o_orderkey", F.lit(k)) == 0)), path, "recent", "result_blocks", {"every": k})
    found = [read_block(spark, path, b, "o_orderpriority:string, n:long").select(F.lit(b).alias("block"), "o_orderpriority", "n") for b in blocks(spark, path)]
    return found[0].unionByName(found[1])


_PLACES = "s as (select vec_id as star, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, case when label % 3 = 0 then label * 10.0 end as settled from embeddings)"
_ROUND = " + ".join(f"(q.{c} - s.{c} - round_even((q.{c} - s.{c}) / 0.5, 0) * 0.5) * (q.{c} - s.{c} - round_even((q.{c} - s.{c}) / 0.5, 0) * 0.5)" for c in "xyz")


@query(f"""with {_PLACES}, p as (select q.star as query, s.star, {_ROUND} as d2, q.star % 2 = 0 as instant, s.settled from s q, s where q.star != s.star),
    v as (select * from p where not (settled is not null and settled <= 30 and (instant or settled + sqrt(d2) / (299792458.0 * 31557600 / 3.0856775814913673e16) <= 30))),
    r as (select *, row_number() over (partition by query order by d2, star) as rank from v) select query, star, round(d2, 9) as d2, rank from r where rank <= 3""")
def knn_periodic(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest that one does not believe settled, the shortest way round a box of half a unit that repeats."""
    found = neighbours.nearest(lookers(spark, d), stars(spark, d), 3, side=0.5)
    return found.select("query", "star", F.round("d2", 9).alias("d2"), F.col("rank").cast("long").alias("rank"))


@query(f"""with {_PLACES}, p as (select q.star, min((q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y) + (q.z - s.z) * (q.z - s.z)) as d2 from s q, s where q.star != s.star group by 1)
    select count(*) as n, round(avg(sqrt(d2)) / (0.55396 * pow(count(*) / 1e0, -1 / 3e0)), 9) as index from p""")
def clustering_index(spark: SparkSession, d: str) -> DataFrame:
    """How clustered the places are, as if spread over a unit box."""
    return neighbours.clustering_index(stars(spark, d), 1.0).select("n", F.round("index", 9).alias("index"))


@query(f"""with {_PLACES}, g as (select least({", ".join(f"pmod_{c}, 0.5 - pmod_{c}" for c in "xyz")}) / 0.05 as gap from (select {", ".join(f"({c} - floor({c} / 0.5) * 0.5) as pmod_{c}" for c in "xyz")} from s))
    select len(list_filter([0.0, 0.5, 1.0, 2.0], lambda e: e <= gap)) as bin, count(*) as n from g group by 1""")
def wall_bins(spark: SparkSession, d: str) -> DataFrame:
    """Places by how far they lie from the walls of their box, in mean spacings."""
    p = [F.pmod(F.col(c), F.lit(0.5)) for c in "xyz"]
    return stars(spark, d).groupBy(neighbours.wall_bin(p, 0.5, 0.05, [0.0, 0.5, 1.0, 2.0]).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_MARKED = "case when value > 60 then '\"__inf__\"' when value < 0.5 then '\"__-inf__\"' when event_id % 17 = 0 then '\"__nan__\"' when event_id % 11 = 0 then 'null' when event_id % 13 = 0 then '\"late\"' else value::varchar end"


@query(f"""with j as (select event_type, '{{"run": {{"props": ' || props || ', "steps": [0, {{"v": ' || {_MARKED} || '}}]}}}}' as doc from events), x as (select event_type, json_extract_string(doc, '$.run.steps[1].v') as v, json_extract(doc, '$.run.props.k')::bigint as k from j)
    select event_type, count(*) filter (v = '__inf__') as inf, count(*) filter (v = '__-inf__') as minus_inf, count(*) filter (v = '__nan__') as nan, count(try_cast(v as double)) as finite, round(sum(try_cast(v as double)), 4) as total, count(*) filter (v = 'late') as late, sum(k)::bigint as k from x group by 1""")
def marked_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Events as nested documents with marks for what is not finite, read as VARIANT."""
    value, i = F.col("value"), F.col("event_id")
    v = F.when(value > 60, float("inf")).when(value < 0.5, float("-inf")).when(F.pmod(i, F.lit(17)) == 0, float("nan")).when(F.pmod(i, F.lit(11)) != 0, value)
    late = (value <= 60) & (value >= 0.5) & (F.pmod(i, F.lit(17)) != 0) & (F.pmod(i, F.lit(11)) != 0) & (F.pmod(i, F.lit(13)) == 0)
    text = F.concat(F.lit('{"run": {"props": '), "props", F.lit(', "steps": [0, {"v": '), F.when(late, '"late"').otherwise(documents.marked(v)), F.lit("}]}}"))
    x = table(spark, d, "events").select("event_type", F.parse_json(text).alias("doc"))
    x = x.select("event_type", documents.number_at(F.col("doc"), "$.run.steps[1].v").alias("v"), documents.text_at(F.col("doc"), "$.run.steps[1].v").alias("t"), documents.number_at(F.col("doc"), "$.run.props.k").cast("long").alias("k"))
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf"))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return x.groupBy("event_type").agg(n(F.col("v") == float("inf")).alias("inf"), n(F.col("v") == float("-inf")).alias("minus_inf"), n(F.isnan("v")).alias("nan"), n(finite).alias("finite"), F.round(F.sum(F.when(finite, F.col("v"))), 4).alias("total"), n(F.col("t") == "late").alias("late"), F.sum("k").alias("k"))


@query("""with recursive o as (select 'd' || doc_id as node, source, doc_id, lag('d' || doc_id) over (partition by source order by doc_id) as prev from documents), e as (select node as src, prev as dst from o where prev is not null),
    t as (select unnest(['d5', ' d17 ', 'x/y/d40/z', 'nothing', '', 'x/none', (select source from documents where doc_id = 60)]) as t), first as (select source, arg_min(node, doc_id) as node from o group by source),
    s as (select distinct coalesce(o.node, f.node, (select p.node from o p where p.node in (select unnest(string_split(trim(t), '/'))) limit 1)) as node from t left join o on o.node = trim(t) left join first f on f.source = trim(t)),
    r(node) as (select node from s where node is not null union select e.src from r join e on e.dst = r.node) select node from r""")
def change_impact(spark: SparkSession, d: str) -> DataFrame:
    """Documents that build upon changed ones, each upon the one before it of its source. Changes are named by document, by source (its first document) or by path."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node"), "source", "doc_id")
    before = Window.partitionBy("source").orderBy("doc_id")
    edges = docs.select(F.col("node").alias("src"), F.lag("node").over(before).alias("dst"))
    packages = docs.where("source is not null").groupBy(F.col("source").alias("package")).agg(F.min_by("node", "doc_id").alias("node"))
    tokens = spark.createDataFrame([(t,) for t in ("d5", " d17 ", "x/y/d40/z", "nothing", "", "x/none")], "token string").unionByName(docs.where("doc_id = 60").select(F.col("source").alias("token")))
    with_checkpoints(spark)
    return graph.impact(edges, tokens, "token", docs, "node", packages)


@query("""select p_brand as src, list_sort(list(distinct c_mktsegment)) as targets from part join lineitem on l_partkey = p_partkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey where p_size > 48 group by 1""")
def shared_edges(spark: SparkSession, d: str) -> DataFrame:
    """Brands and the segments of customers that have a part of theirs in common."""
    p = table(spark, d, "part").where("p_size > 48").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("key"))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("key")).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    c = lines.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("name")), "o_custkey").select("name", "key").distinct()
    return graph.neighbours_of(graph.linked_through(p, c, "key"))


_RUNS = "k as (select user_id, ts, value, event_type, row_number() over (partition by user_id order by ts, event_id) as k, count(*) over (partition by user_id) as n from events)"
_SHARES = (25, 50, 75, 90, 99, 100)


@query(f"""with {_RUNS} select user_id, count(*) as n, count(*) filter (event_type = 'click') as launched, count(*) filter (event_type = 'view') as arrived, count(*) filter (event_type = 'error') as wasted,
    {", ".join(f"arg_min(ts, k) filter (k * 100 >= n * {p}) as t{p}" for p in _SHARES)} from k group by user_id""")
def run_records(spark: SparkSession, d: str) -> DataFrame:
    """Users as runs: how many events of each kind, and when each share of them has passed."""
    return paired.record(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "ts", _kinds(), _SHARES)


def _kinds() -> dict:
    return {name: F.col("event_type") == kind for name, kind in (("launched", "click"), ("arrived", "view"), ("wasted", "error"))}


@query(f"""with r as (select user_id, count(*) as n, count(*) filter (event_type = 'error') as wasted from events group by 1), l as (select pow(2, floor(log2(1 + user_id)))::bigint as cap, median(wasted / n) as b from r group by 1),
    p as (select min(case when (m.b - l.b) / l.b < 0.05 then l.cap end) as plateau from l left join l m on m.cap = 2 * l.cap) select cap, round(b, 9) as bounce_depth, round(b - lag(b) over (order by cap), 9) as delta, plateau from l, p""")
def bounce_ladder(spark: SparkSession, d: str) -> DataFrame:
    """How many of a run's events are in vain (the median over runs), by the order of magnitude of the user; differences from rung to rung, and where it stops to grow."""
    r = paired.record(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "ts", _kinds(), ()).withColumn("cap", F.pow(F.lit(2.0), F.floor(F.log2(1 + F.col("user_id")))))
    ladder = paired.median_bounce_depth(r, ["cap"], "wasted", "n").withColumn("all", F.lit("all"))
    found = paired.plateau_report(ladder, ["all"], "cap", "bounce_depth", 0.05)
    return found.select(F.col("cap").cast("long").alias("cap"), F.round("bounce_depth", 9).alias("bounce_depth"), F.round("delta", 9).alias("delta"), F.col("plateau").cast("long").alias("plateau"))


@query("""with e as (select user_id, ts, event_id, value / 100 as x, sqrt(value) as y, event_id % 7 / 1e0 as z from events), f as (select *, count(*) over w as settled, max(sqrt((x - 0.5) * (x - 0.5) + (y - 1) * (y - 1) + (z - 2) * (z - 2))) over w as front from e window w as (partition by user_id order by ts, event_id rows unbounded preceding))
    select event_id, settled, round(front, 9) as front from f""")
def front_radius(spark: SparkSession, d: str) -> DataFrame:
    """Events as places that a run settles one after the other: how many so far, and the farthest from where it began."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("ts").alias("year"), F.col("event_id").alias("star"), (F.col("value") / 100).alias("x"), F.sqrt("value").alias("y"), (F.pmod("event_id", F.lit(7)) / 1).alias("z"))
    return neighbours.settled_front(e, (0.5, 1.0, 2.0)).select(F.col("star").alias("event_id"), "settled", F.round("front", 9).alias("front"))


@query(f"""with {_PLACES}, p as (select q.star as query, s.star, (q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y) + (q.z - s.z) * (q.z - s.z) as d2 from s q, s where q.star != s.star),
    r as (select *, row_number() over (partition by query order by d2, star) as rank from p qualify rank <= 4), v as (select query, r.star, rank, s.star % 5 as speed from r join s on s.star = r.star) select query, star from v qualify row_number() over (partition by query order by speed desc, rank) = 1""")
def fastest_target(spark: SparkSession, d: str) -> DataFrame:
    """Of the four nearest places, the one that moves fastest."""
    queries = lookers(spark, d).withColumn("year", F.lit(-1.0))
    speeds = stars(spark, d).select("star", F.pmod("star", F.lit(5)).cast("double").alias("speed"))
    return neighbours.fastest_of(neighbours.nearest(queries, stars(spark, d), 4), speeds)


@query("""with h as (select user_id, list_transform(range(0, 8), lambda b: len(list_filter(v, lambda x: least(7, x // 10) = b))) as bins from (select user_id, list(value::bigint) as v from events group by 1)),
    b as (select user_id % 4 as side, unnest(range(0, 8)) as bin, unnest(bins) as n from h), t as (select user_id % 4 as side, sum(list_sum(bins[4:])) as tail, count(*) filter (len(bins) > 0 and list_sum(bins) in (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)) as even from h group by 1)
    select side, bin, sum(n)::bigint as n, min(tail)::bigint as tail, min(even)::bigint as even from b join t using (side) group by side, bin""")
def binned_tails(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of users' values, added up by side bin by bin; what lies from the fourth bin on, and how many users' counts are powers of two."""
    v = F.least(F.lit(7).cast("long"), F.floor(F.round("value").cast("long") / 10))
    e = table(spark, d, "events").groupBy("user_id").agg(F.array(*[F.count_if(v == b) for b in range(8)]).alias("bins")).withColumn("side", F.pmod("user_id", F.lit(4)))
    n = F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + x)
    tails = e.groupBy("side").agg(F.sum(paired.tail_sum(F.col("bins"), 3)).alias("tail"), F.count_if(paired.power_of_two(n)).alias("even"))
    return paired.summed_bins(e, ["side"], "bins").join(tails, "side").select("side", F.col("bin").cast("long").alias("bin"), "n", "tail", "even")


@query("""select o_orderpriority, metric, round(value, 4) as value from (select o_orderpriority, count(*)::double as n, avg(o_totalprice) as mean, max(o_totalprice) as most from orders group by 1) unpivot (value for metric in (n, mean, most))""")
def long_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of orders by priority, a row for each."""
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("most"))
    return rounded(paired.unpivoted(o, ["o_orderpriority"], ["n", "mean", "most"]), 4)


@query(f"""with c as (select c_nationkey, sum(case when local then l_quantity else 0 end) / sum(l_quantity) as closure, sum(case when local then l_quantity else 0 end) as loc, sum(case when local then l_quantity * l_extendedprice / 1e4 else 0 end) as energy from {PARTS} group by 1),
    p as (select *, 20e0 / 1000 as alpha, 50e0 / 30 as resupply, case when loc > 0 then energy / loc else 'inf'::double end as kwh from c)
    select c_nationkey, round(alpha, 6) as alpha, round(resupply, 6) as resupply, round(case when kwh > 0 then 400e0 * 24 / kwh else 'inf'::double end, 6) as energy_cap, round(case when closure >= 1 then 'inf'::double else resupply / (1 - closure) end, 6) as resupply_ceiling,
    round(case when closure > 0 and alpha > 0 then ln(2) * closure / alpha end, 6) as doubling_days from p""")
def prepared_runs(spark: SparkSession, d: str) -> DataFrame:
    """Nations' closures as parameters of growth."""
    lines = parts_of_nations(spark, d).withColumn("kwh", F.col("l_extendedprice") / 1e4)
    c = bom.closure(lines, ["c_nationkey"], "l_quantity", energy="kwh")
    c = c.select("c_nationkey", "closure", "local", "local_energy", *[F.lit(v).alias(k) for k, v in {"seed": 1000.0, "rate": 20.0, "power_kw": 400.0, "resupply_mass": 50.0, "cadence": 30.0}.items()])
    return rounded(growth.prepared(c).select("c_nationkey", "alpha", "resupply", "energy_cap", "resupply_ceiling", "doubling_days"))


@query(f"""with {_fit_sql("true")}, {_NAMED}, q as (select quantile_cont(paid, 0.5) as q50, quantile_cont(paid, 0.05) as q05, quantile_cont(paid, 0.95) as q95 from t),
    i as (select unnest(['l_quantity', 'l_discount', 'p_size']) as input, unnest([1, 2, 3]) as n), h as (select input, sum(case when [k0, k1, k2][n] > 0 then c * c end) / (select sum(c * c) from coef where i > 1) as total from coef join named using (i), i group by input),
    r as (select list(input order by total desc, input) as names, list(total order by total desc, input) as totals from h)
    select printf('paid: %.3g USD (90 %% between %.3g and %.3g), driven by %s', q50, q05, q95, case when totals[1] - totals[2] < 0.1 then names[1] || ' and ' || names[2] else names[1] end) as sentence from q, r""")
def paid_in_one_line(spark: SparkSession, d: str) -> DataFrame:
    """What is paid, and the input that drives its spread, as a sentence."""
    lines = priced_lines(spark, d)
    found = surrogates.indices(surrogates.fit(lines, BASES, DEGREE, "paid").table(spark), list(BASES))
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.col("total").desc(), "input")))  # a row per input
    return uncertainty.in_one_line("paid", "USD", uncertainty.summary(lines, "paid"), ranked)
