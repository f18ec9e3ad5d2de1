"""Nearest neighbours under a visibility rule, seeded fields of points, clustering, and bins with fixed edges."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpforge.functions.random import normal_pair, uniform
from kelpforge.session import with_checkpoints

# From definitions: m/s of light, s of a Julian year, m of a parsec.
LIGHT_PC_PER_YEAR = 299792458 * 31557600 / 3.0856775814913673e16
KM_S_IN_PC_PER_YEAR = 1000 * 31557600 / 3.0856775814913673e16


def kept_apart(df: DataFrame, by: str, columns: dict[str, Column]) -> DataFrame:
    """by and the columns, as rows that later filters do not write the columns' long expressions into again."""
    return df.select(by, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def field(spark: SparkSession, n: int, density: float, seed: int, speed: float = 0.0, spread: float = 0.0) -> DataFrame:
    """star, x, y, z, speed: n points at random in a cube of the density; draws 3 i, 3 i + 1, 3 i + 2 place star i, draw 3 n + i sets its speed."""
    side = (n / density) ** (1 / 3)
    u = lambda k: uniform(F.lit(seed), k)
    i = F.col("id")
    d = kept_apart(spark.range(n), "id", {c: u(3 * i + j) for j, c in enumerate("xyz")} | {"v": u(3 * n + i)})
    v = F.greatest(F.lit(0.0), F.lit(speed) + (2 * F.col("v") - 1) * spread)
    return d.select(i.alias("star"), *[(F.col(c) * side).alias(c) for c in "xyz"], v.alias("speed"))


def reflected(x: Column, side: float) -> Column:
    """x folded back into 0..side, as often as needed."""
    t = F.pmod(x, F.lit(2 * side))
    return F.when(t > side, 2 * side - t).otherwise(t)


def clustered_field(spark: SparkSession, n: int, density: float, seed: int, clumps: int, sigma: float) -> DataFrame:
    """As field, but around random centres (star i around centre i modulo clumps) with normal offsets of sigma times the side, reflected at the walls."""
    side = (n / density) ** (1 / 3)
    u = lambda k: uniform(F.lit(seed), k)
    i = F.col("id")
    centre = F.pmod(i, F.lit(clumps))
    d = kept_apart(spark.range(n), "id", {f"u{j}": u(3 * clumps + 4 * i + j) for j in range(4)} | {f"c{j}": u(3 * centre + j) for j in range(3)})
    one, two = normal_pair(F.col("u0"), F.col("u1")), normal_pair(F.col("u2"), F.col("u3"))
    off = (one[0], one[1], two[0])
    d = kept_apart(d, "id", {c: reflected(F.col(f"c{j}") * side + o * (sigma * side), side) for j, (c, o) in enumerate(zip("xyz", off, strict=True))})
    return d.withColumnRenamed("id", "star")


def squared_distance(a: Sequence[Column], b: Sequence[Column], side: float | None = None) -> Column:
    """Of two points; with a side, the shortest way round in a periodic box (rounding half to even)."""
    total = None
    for p, q in zip(a, b, strict=True):
        d = p - q
        d = d if side is None else d - F.rint(d / side) * side
        total = d * d if total is None else total + d * d
    return total


def news_has_come(settled_year: Column, distance: Column, year: Column, instant: Column) -> Column:
    """Whether someone at the distance knows that a place is settled; null years are unsettled."""
    return settled_year.isNotNull() & (settled_year <= year) & (instant | (settled_year + distance / LIGHT_PC_PER_YEAR <= year))


def nearest_within(queries: DataFrame, points: DataFrame, k: int, radius: float, side: float | None = None) -> DataFrame:
    """As nearest, but only of points within the radius. Where many lie within it, k are found in smaller cells, so that the work does not grow with their number."""
    return nearest(queries, points, k, side=side, radius=radius)


def _in_cells(queries: DataFrame, points: DataFrame, k: int, radius: float, side: float | None = None) -> DataFrame:
    """The k nearest within the radius, by an equi-join on cells of its size. With a side, the box of that side repeats in all directions: cells are numbered modulo the box, and one
    that is reached on both ways round is met once."""
    if side is None:
        size, cells, around = radius, None, [-1, 0, 1]
    else:
        cells = max(1, int(side / radius))
        size, around = side / cells, [-1, 0, 1][: cells] if cells < 3 else [-1, 0, 1]
    inside = lambda c: F.col(c) if side is None else F.pmod(F.col(c), F.lit(side))
    grid = lambda c: F.floor(inside(c) / size) if cells is None else F.least(F.floor(inside(c) / size), F.lit(cells - 1))
    wrapped = lambda c: c if cells is None else F.pmod(c, F.lit(cells))
    steps = F.array(*map(F.lit, around))
    q = queries.withColumn("_x", F.explode(steps)).withColumn("_y", F.explode(steps)).withColumn("_z", F.explode(steps))
    q = q.withColumns({f"_c{c}": wrapped(grid(c) + F.col(f"_{c}")) for c in "xyz"}).drop("_x", "_y", "_z")
    p = _placed(points)
    d = q.join(p.withColumns({f"_c{c}": grid(f"p{c}") for c in "xyz"}), ["_cx", "_cy", "_cz"])
    return _ranked(d, k, radius, side)


def _placed(points: DataFrame) -> DataFrame:
    return points.select("star", *[F.col(c).alias(f"p{c}") for c in "xyz"], "settled_year")


def _ranked(d: DataFrame, k: int, radius: float | None, side: float | None = None) -> DataFrame:
    d = d.withColumn("d2", squared_distance([F.col(c) for c in "xyz"], [F.col(f"p{c}") for c in "xyz"], side))
    if radius is not None:
        d = d.where(F.col("d2") <= radius * radius)
    d = d.where(~news_has_come(F.col("settled_year"), F.sqrt("d2"), F.col("year"), F.col("instant")) & ~F.array_contains("excluded", F.col("star")))
    if k == 1:
        best = d.groupBy("query").agg(F.min(F.struct("d2", "star")).alias("_b"))
        return best.select("query", F.col("_b.star").alias("star"), F.col("_b.d2").alias("d2"), F.lit(1).alias("rank"))
    w = Window.partitionBy("query").orderBy("d2", "star")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "star", "d2", "rank")


def _everywhere(queries: DataFrame, points: DataFrame, k: int, side: float | None, block: int) -> DataFrame:
    """Every point is tried for every query. Queries are broadcast in blocks of about that many; each task keeps its own k best before they meet."""
    blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        found = _ranked(_placed(points).join(F.broadcast(some)), k, None, side)
        out = found if out is None else out.unionByName(found)
    return out


def spacing(n: int, spans: Sequence[float], k: int) -> float:
    """Size of a cell of which 27 hold about 2 k of n points that are spread over the spans."""
    wide = [v for v in spans if v > 0]
    return math.prod(wide) ** (1 / len(wide)) * (2 * k / (27 * max(1, n))) ** (1 / len(wide)) if wide else 1.0


def _that_may_count(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Of points at one place that were settled in one year, which are as far and as visible, the k lowest and as many more as a query excludes at most: no other can be among k."""
    most = queries.agg(F.max(F.size("excluded"))).first()[0] or 0
    w = Window.partitionBy("x", "y", "z", "settled_year").orderBy("star")
    return points.withColumn("_of_place", F.row_number().over(w)).where(F.col("_of_place") <= k + max(0, most)).drop("_of_place")


def nearest(queries: DataFrame, points: DataFrame, k: int = 1, cell: float | None = None, side: float | None = None, block: int = 2000, radius: float | None = None) -> DataFrame:
    """query, star, d2, rank: the k nearest points (ties: the lower star) that a query, in its year, does not believe settled and does not exclude.

    queries: query (one row each), x, y, z, year, instant, excluded (array). points: star, x, y, z, settled_year. With a side, distances go the shortest way round a box that repeats.
    All queries are searched for within a cell's size (by default, of a size that k and the points' density give); those that found fewer than k go on with twice the size, a job
    each round. Queries that have not found k when a cell spans the field are tried against every point, in blocks. With a radius, only points within it count, and the last round
    has cells of its size. Of copies at one place, as many are met as can matter.
    """
    with_checkpoints(queries.sparkSession)
    points = _that_may_count(queries, points, k).checkpoint()
    both = queries.select("x", "y", "z").unionByName(points.select("x", "y", "z"))
    if side is None:
        span = both.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z"))).agg(*[F.least(F.max(c) - F.min(c), 4 * F.stddev_pop(c)).alias(c) for c in "xyz"], *[(F.max(c) - F.min(c)).alias(f"{c}_all") for c in "xyz"]).first()
        bulk, spans = [v or 0.0 for v in span[:3]], [v or 0.0 for v in span[3:]]  # far ones do not make cells large for the bulk
    else:
        bulk = spans = [side] * 3
    cell = spacing(points.count(), bulk, k) if cell is None else cell
    across = 1.001 * math.sqrt(sum(v**2 for v in spans)) if side is None else side / 3
    out, open_ = None, queries
    while cell < (across if radius is None else radius):
        found = _in_cells(open_, points, k, cell, side).checkpoint()
        full = found.where(F.col("rank") == k).select("query")
        done = found.join(full, "query", "left_semi")  # the others are searched for again
        out = done if out is None else out.unionByName(done)
        open_ = open_.join(full, "query", "left_anti").checkpoint()
        if open_.isEmpty():
            return out
        cell *= 2
    rest = _everywhere(open_, points, k, side, block) if radius is None else _in_cells(open_, points, k, radius, side)
    return rest if out is None else out.unionByName(rest)


def fastest_of(found: DataFrame, speeds: DataFrame) -> DataFrame:
    """Of each query's neighbours the fastest, the nearer one if they tie."""
    return found.join(speeds.select("star", "speed"), "star").groupBy("query").agg(F.max_by("star", F.struct("speed", (-F.col("rank")).alias("r"))).alias("star"))


def slingshot(speed: Column, star_speed: Column, escape: Column, cap: Column) -> Column:
    """Speed after passing a moving star, at most the cap."""
    u = speed + star_speed
    return F.least(speed + escape * escape / (escape * escape / (2 * u) + u), cap)


def news_meets(settled_year: Column, arrival: Column, speed: Column) -> Column:
    """Year in which a probe bound for a place meets the news that it is settled."""
    b = speed / LIGHT_PC_PER_YEAR
    return (settled_year + b * arrival) / (1 + b)


def clustering_index(points: DataFrame, side: float, cell: float | None = None, periodic: bool = False) -> DataFrame:
    """n, index: mean distance to the nearest other point over what a random field in a box of the side would have; below 1 is clustered. Fields of fewer than two points have none."""
    q = points.select(F.col("star").alias("query"), "x", "y", "z", F.lit(0.0).alias("year"), F.lit(True).alias("instant"), F.array("star").alias("excluded"))
    p = points.withColumn("settled_year", F.lit(None).cast("double"))
    d = nearest(q, p, 1, cell, side if periodic else None).select("query", "d2")
    expected = 0.55396 * F.pow(F.count("d2") / (side**3), F.lit(-1 / 3))
    return d.agg(F.count("d2").alias("n"), (F.avg(F.sqrt("d2")) / expected).alias("index"))


def edge_bin(value: Column, edges: Sequence[float]) -> Column:
    """How many edges lie at or below the value: 0 is below all, len(edges) at or above the last."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value))


def wall_bin(point: Sequence[Column], side: float, spacing: float, edges: Sequence[float]) -> Column:
    """Bin of the distance to the nearest wall, in units of the spacing."""
    gaps = [g for c in point for g in (c, side - c)]
    return edge_bin(F.least(*gaps) / spacing, edges)


def settled_front(events: DataFrame, origin: tuple[float, float, float]) -> DataFrame:
    """events (run, year, star, x, y, z) with settled so far and the farthest distance from the origin so far."""
    w = Window.partitionBy("run").orderBy("year", "star").rowsBetween(Window.unboundedPreceding, 0)
    d = F.sqrt(squared_distance([F.col(c) for c in "xyz"], [F.lit(o) for o in origin]))
    return events.withColumn("settled", F.count(F.lit(1)).over(w)).withColumn("front", F.max(d).over(w))


def band(value: Column, bounds: Sequence[tuple[float, str]], last: str) -> Column:
    """The first band whose upper bound reaches the value, else the last, which has none."""
    out = F.when(F.lit(False), F.lit(last))
    for upper, name in bounds:
        out = out.when(value <= upper, F.lit(name))
    return out.otherwise(F.when(value.isNotNull(), F.lit(last)))


def light_years(distance_pc: Column) -> tuple[Column, Column]:
    """Years that light takes one way and both ways."""
    one = distance_pc / LIGHT_PC_PER_YEAR
    return one, 2 * one
