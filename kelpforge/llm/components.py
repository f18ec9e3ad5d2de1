"""Connected components by alternating large-star and small-star steps, each one a few joins over the edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpforge.llm.common import lean, written


#: Neighbours up to which a node is joined like any other.
HUB = 20_000


class Forest:
    """Union-find over the links that one task sees: keeps only those that join something new."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p] if p in up else p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def forest_edges(edges: DataFrame, limit: int = 500_000) -> DataFrame:
    """Edges (_a, _b) without those that close a circle within a partition; the memory of a task is bounded by starting anew after so many nodes."""

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            if len(forest.up) > limit:
                forest = Forest()
            keep = [forest.join(a, b) for a, b in zip(batch["_a"].to_pylist(), batch["_b"].to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return edges.select("_a", "_b").mapInArrow(lean(thinned), "_a long, _b long")


def _with_lowest(edges: DataFrame, lowest: DataFrame, n: int, most: int, hub: int) -> DataFrame:
    """edges with _m of their _a. lowest: _a, _m, _n (neighbours); n: neighbours of all nodes together, most: of one node.

    Nodes of more than hub neighbours and more than a 10,000th of all are 10,000 at most: where there are any, they are broadcast, and their edges stay where they are.
    """
    limit = max(hub, n // 10_000)
    if most <= limit:
        return edges.join(lowest, "_a").select("_a", "_b", "_m")
    hubs = F.broadcast(lowest.where(F.col("_n") > limit).select("_a", F.col("_m").alias("_hub")))
    found = edges.join(hubs, "_a", "left")
    return found.where("_hub is not null").select("_a", "_b", F.col("_hub").alias("_m")).unionByName(found.where("_hub is null").join(lowest.where(F.col("_n") <= limit), "_a").select("_a", "_b", "_m"))


def _state(e: DataFrame) -> tuple:
    """Edges, a sum of their hashes, and the most neighbours of a node."""
    both = e.select("_a", F.xxhash64("_a", "_b").cast("decimal(38,0)").alias("_h")).unionByName(e.select(F.col("_b").alias("_a"), F.lit(0).cast("decimal(38,0)").alias("_h")))
    found = both.groupBy("_a").agg(F.count(F.lit(1)).alias("_n"), F.sum("_h").alias("_h")).agg(F.sum("_n"), F.sum("_h"), F.max("_n")).first()
    return (found[0] or 0) // 2, found[1], found[2] or 0


def connected_components(edges: DataFrame, rounds: int = 40, hub: int = HUB) -> DataFrame:
    """_node and _root (the smallest node that it reaches) of every node of edges (_a, _b, both long). Edges in either direction, repeated ones and loops are allowed.

    large-star: every neighbour larger than a node is linked to the node's smallest neighbour. small-star: the node and
    its smaller neighbours are linked to the smallest of them. When a round changes nothing, all edges lead to roots. The
    number of rounds grows with the logarithm of the longest path; the edges never become more.
    """
    e = edges.where("_a != _b").select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct()
    e = written(e, "edges")
    state = _state(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        lowest = both.groupBy("_a").agg(F.least(F.min("_b"), F.first("_a")).alias("_m"), F.count(F.lit(1)).alias("_n"))
        large = _with_lowest(both.where("_b > _a"), lowest, 2 * state[0], state[2], hub).select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).where("_a != _b")
        lowest = large.groupBy("_a").agg(F.min("_b").alias("_m"), F.count(F.lit(1)).alias("_n"))
        small = _with_lowest(large, lowest, state[0], state[2], hub)
        small = small.select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).where("_a != _b").unionByName(lowest.select("_a", F.col("_m").alias("_b"))).distinct()
        e = written(small, "edges")
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return e.select(F.col("_a").alias("_node"), F.col("_b").alias("_root")).unionByName(e.select(F.col("_b").alias("_node"), F.col("_b").alias("_root")).distinct())
