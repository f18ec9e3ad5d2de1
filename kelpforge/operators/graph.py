"""Graphs as edge tables: what a change reaches, what is declared and what is used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) without loops and nulls."""
    return edges.where("src is not null and dst is not null and src != dst").select("src", "dst").distinct()


def reaching(edges: DataFrame, changed: DataFrame, rounds: int = 1000, growth: int = 4) -> DataFrame:
    """node: the changed nodes (column node) and all that reach them along edges src -> dst.

    By doubling: each round adds what reaches the nodes found so far over the paths at hand, and then joins these paths with themselves, so that they are twice as long and the
    rounds are as many as the logarithm of the longest distance. Where joining them would give more than growth times as many as there are edges (which is counted beforehand),
    paths stay as long as they are. A round that finds nothing ends it. Tables are checkpointed, so that plans do not grow with the rounds.
    """
    paths = clean_edges(edges).checkpoint()
    most = growth * paths.count()
    seen = changed.select("node").where("node is not null").distinct().checkpoint()
    n = seen.count()
    for _ in range(rounds):
        found = paths.join(seen, paths["dst"] == seen["node"], "left_semi").select(F.col("src").alias("node"))
        seen = seen.unionByName(found).distinct().checkpoint()
        if (now := seen.count()) == n:
            return seen
        n = now
        into, out = paths.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_i")), paths.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_o"))
        if (into.join(out, "node").agg(F.sum(F.col("_i") * F.col("_o"))).first()[0] or 0) <= most:
            second = paths.select(F.col("src").alias("_mid"), F.col("dst").alias("_end"))
            paths = paths.join(second, F.col("dst") == F.col("_mid")).select("src", F.col("_end").alias("dst")).distinct().checkpoint()
    raise RuntimeError("the graph is deeper than the rounds allow")


def first_part(tokens: DataFrame, token: str, nodes: DataFrame, node: str, separator: str = "/") -> DataFrame:
    """token, resolved: of each token that is a path, the first part that is a node."""
    parts = tokens.select(F.col(token), F.posexplode(F.split(F.col(token), separator)).alias("_at", "_part"))
    known = parts.join(nodes.select(F.col(node).alias("_part")).distinct(), "_part", "left_semi")
    return known.groupBy(token).agg(F.min_by("_part", "_at").alias("resolved"))


def impact(edges: DataFrame, tokens: DataFrame, token: str, nodes: DataFrame, node: str, packages: DataFrame) -> DataFrame:
    """node: what a change touches, and all that reach it. Tokens are names of nodes, of packages (columns package, node), or paths with a node's name among their parts; blanks around
    them are cut off, and those that name nothing are left out."""
    named = tokens.select(F.trim(F.col(token)).alias("_token")).where("_token != ''").distinct()
    own = nodes.select(F.col(node).alias("_key"), F.col(node).alias("_value")).distinct()
    paths = first_part(named, "_token", nodes, node)
    found = resolved(named, "_token", [(own, "_key", "_value"), (packages, "package", "node"), (paths, "_token", "resolved")])
    return reaching(edges, found.where("resolved is not null").select(F.col("resolved").alias("node")))


def resolved(tokens: DataFrame, token: str, rules: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Each token with the value that the first rule (table, key, value) knows it by; null if none does."""
    d, found = tokens, []
    for i, (table, key, value) in enumerate(rules):
        d = d.join(table.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")), F.col(token) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    return d.select(*tokens.columns, F.coalesce(*found).alias("resolved"))


def linked_through(left: DataFrame, right: DataFrame, shared: str) -> DataFrame:
    """Distinct pairs (left.name, right.name) that have something in common."""
    l, r = left.select(F.col("name").alias("src"), shared), right.select(F.col("name").alias("dst"), shared)
    return l.join(r, shared).select("src", "dst").distinct()


def two_way_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: what only a has (left) and what only b has (right), each once."""
    one, other = a.select(key).distinct(), b.select(key).distinct()
    return one.join(other, key, "left_anti").withColumn("side", F.lit("left")).unionByName(other.join(one, key, "left_anti").withColumn("side", F.lit("right")))


def neighbours_of(edges: DataFrame) -> DataFrame:
    """src with the sorted set of its targets."""
    return clean_edges(edges).groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("targets"))


def depth_reached(edges: DataFrame, start: Column, depth: int) -> DataFrame:
    """node, depth by a recursive query with a bound on its depth; nodes found on several ways have their least depth."""
    return edges.sparkSession.sql(
        f"""with recursive r(node, depth) as (
            select node, 0 from {{start}}
            union all
            select e.src, r.depth + 1 from r join {{edges}} e on e.dst = r.node where r.depth < {int(depth)}
        ) select node, min(depth) as depth from r group by node""",
        edges=clean_edges(edges),
        start=edges.select(start.alias("node")).distinct(),
    )
