"""Medians of resamples, by counts of where draws fall: no group is held anywhere, and no value is joined with a draw.

A resample draws as many positions as its group has sorted values. Its median is the value at the median of these positions, which is found by counting them in buckets,
and then within the one or two buckets where the middle lies. Only the positions found are looked up among the values, which are kept as distinct ones with counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpforge.functions.random import draws32
from kelpforge.session import with_checkpoints

#: Draws made at a time, and draws of a resample that are counted together: what leaves a task grows with the root of a group's size, not with its draws.
CHUNK = 1 << 16
STRETCH = 1 << 23


def _ranges(rows: DataFrame, by: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """by, value, _c, _part: distinct values and the range that each is in. And by, _part, _t, _start, _n: how many values a range has, how many the ranges before it, and how many all."""
    keys = [F.col(c) for c in by]
    counts = rows.where(F.col(value).isNotNull()).dropna(subset=list(by)).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    with_checkpoints(rows.sparkSession)
    placed = counts.repartitionByRange(*keys, F.col(value)).withColumn("_part", F.spark_partition_id()).checkpoint()
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "_part").agg(F.sum("_c").alias("_t"))  # a row for each range that a group has a part in
    return placed, totals.select(*by, "_part", "_t", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_start"), F.sum("_t").over(Window.partitionBy(*by)).alias("_n"))


def positioned(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, value, _c, _first, _n: each distinct value of a group, how often it occurs, how many smaller ones there are, and how many values. Nulls are left out.

    Distinct values are dealt out by ranges and summed up within and over these, so that a group of any size takes many tasks.
    """
    placed, starts = _ranges(rows, by, value)
    own = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    d = placed.withColumn("_first", F.coalesce(F.sum("_c").over(own), F.lit(0))).join(starts.drop("_t"), [*by, "_part"])
    return d.select(*by, value, "_c", (F.col("_first") + F.col("_start")).alias("_first"), "_n")


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and a column for each name: the values at these shares of n - 1, interpolated. Null values and groups are left out.

    Distinct values are dealt out by ranges, of which only those where these places lie are put in order: no task holds all of a group's values.
    """
    placed, starts = _ranges(rows.select(*by, F.col(value).cast("double").alias("_v")), by, "_v")
    places = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in shares.items()}
    ends = {f"_{end}_{name}": f(place) for name, place in places.items() for end, f in (("low", F.floor), ("high", F.ceil))}
    wanted = starts.where(reduce(or_, [_held(i, F.col("_start"), F.col("_t")) for i in ends.values()])).drop("_t").checkpoint()
    own = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    d = placed.join(F.broadcast(wanted) if wanted.count() <= 10_000 else wanted, [*by, "_part"])
    d = d.withColumn("_first", F.col("_start") + F.coalesce(F.sum("_c").over(own), F.lit(0)))
    d = d.groupBy(*by).agg(F.max("_n").alias("_n"), *[F.max(F.when(_held(i, F.col("_first"), F.col("_c")), F.col("_v"))).alias(name) for name, i in ends.items()])

    def between(name: str) -> Column:
        place, low, high = places[name], F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return d.select(*by, *[between(name).alias(name) for name in shares])


def _stretches(groups: DataFrame, resamples: int) -> DataFrame:
    """_g, _n, _seed, _r, _k: a row for each stretch of draws."""
    d = groups.withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    return d.withColumn("_k", F.explode(F.expr(f"sequence(0L, _n - 1, {STRETCH}L)"))).repartition("_g", "_r", "_k")


def _drawn(n: int, seed: int, r: int, k: int) -> Iterator[np.ndarray]:
    """Positions that draws k, k + 1, ... (of a stretch) of resample r fall on, a chunk at a time."""
    end = min(n, k + STRETCH)
    for at in range(k, end, CHUNK):
        d = draws32(seed, r * n + np.arange(at, min(end, at + CHUNK)))
        # draws are below 2**32. numpy divides by one number much faster than it takes remainders
        yield d if n >> 32 else d - d // np.uint32(n) * np.uint32(n)


class _Rows:
    """Gathers rows of whole numbers into batches of a good size."""

    def __init__(self, *names: str):
        self.names, self.held, self.n = names, [], 0

    def add(self, *columns: int | np.ndarray) -> Iterator[pa.RecordBatch]:
        """Arrays of one length, and numbers that stand in each of their rows."""
        self.held.append([np.asarray(c, np.int64) for c in np.broadcast_arrays(*columns)])
        self.n += len(self.held[-1][0])
        if self.n >= CHUNK:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*self.held, strict=True)], names=list(self.names))
        self.held, self.n = [], 0


def _width(n: int) -> int:
    return int(np.ceil(np.sqrt(n)))


def _held(at: Column, before: Column, count: Column) -> Column:
    return (before <= at) & (at < before + count)


def middle(groups: DataFrame, resamples: int) -> DataFrame:
    """_g, _r, _pos: two rows for each resample, the positions of its lower and its upper middle. groups: _g, _n (positions 0 to n - 1, and so many draws), _seed."""

    def in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _Rows("_g", "_n", "_r", "_bucket", "_c")
            for g, n, seed, r, k in zip(*(batch[c].to_pylist() for c in ("_g", "_n", "_seed", "_r", "_k")), strict=True):
                c = np.zeros(-(-n // _width(n)), np.int64)
                for drawn in _drawn(n, seed, r, k):
                    c += np.bincount(drawn // np.uint32(_width(n)), minlength=len(c))
                at = np.flatnonzero(c)
                yield from found.add(g, n, r, at, c[at])
            yield from found.rest()

    def in_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _Rows("_g", "_n", "_r", "_before", "_pos", "_c")
            for g, n, seed, r, k, wanted in zip(*(batch[c].to_pylist() for c in ("_g", "_n", "_seed", "_r", "_k", "_wanted")), strict=True):
                width = _width(n)
                c = np.zeros((len(wanted), width), np.int64)
                for drawn in _drawn(n, seed, r, k):
                    for i, w in enumerate(wanted):
                        first = w["_bucket"] * width
                        here = drawn[(drawn >= first) & (drawn < first + width)]
                        if len(here):
                            c[i] += np.bincount(here.astype(np.int64) - first, minlength=width)
                for w, some in zip(wanted, c, strict=True):
                    at = np.flatnonzero(some)
                    yield from found.add(g, n, r, w["_before"], w["_bucket"] * width + at, some[at])
            yield from found.rest()

    low, high = F.expr("(_n - 1) div 2"), F.expr("_n div 2")
    stretches = _stretches(groups, resamples)
    d = stretches.mapInArrow(in_buckets, "_g long, _n long, _r long, _bucket long, _c long").groupBy("_g", "_n", "_r", "_bucket").agg(F.sum("_c").alias("_c"))
    order = Window.partitionBy("_g", "_r").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_before", F.coalesce(F.sum("_c").over(order), F.lit(0)))
    d = d.where(_held(low, F.col("_before"), F.col("_c")) | _held(high, F.col("_before"), F.col("_c")))
    wanted = d.groupBy("_g", "_r").agg(F.collect_list(F.struct("_bucket", "_before")).alias("_wanted")).checkpoint()  # one or two buckets
    d = stretches.join(wanted, ["_g", "_r"]).mapInArrow(in_wanted, "_g long, _n long, _r long, _before long, _pos long, _c long")
    d = d.groupBy("_g", "_n", "_r", "_before", "_pos").agg(F.sum("_c").alias("_c"))
    order = Window.partitionBy("_g", "_r", "_before").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_c").over(order), F.lit(0)))
    both = F.array(*[F.when(_held(at, F.col("_start"), F.col("_c")), F.col("_pos")) for at in (low, high)])
    return d.select("_g", "_r", F.explode(F.array_compact(both)).alias("_pos"))


def _looked_up(positions: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """positions (_g, _pos) with the value there. values: _g, value, _first, _c, _n. An equi-join on stretches of positions."""
    stretch = "greatest(1L, _n div 4096)"
    v = values.withColumn("_stretch", F.explode(F.expr(f"sequence(_first div {stretch}, (_first + _c - 1) div {stretch})")))
    p = positions.join(values.select("_g", "_n").distinct(), "_g").withColumn("_stretch", F.expr(f"_pos div {stretch}")).drop("_n")
    d = p.join(v.drop("_n"), ["_g", "_stretch"]).where((F.col("_first") <= F.col("_pos")) & (F.col("_pos") < F.col("_first") + F.col("_c")))
    return d.select(*positions.columns, value)


def resampled_medians(rows: DataFrame, by: Sequence[str], value: str, resamples: int, seed: Column) -> DataFrame:
    """by, _r, _m: the median of every resample (0, 1, ...), and the values' own median under resample -1. Draw r n + k of a group's seed (a column over by) is the k-th of resample r.

    Null values and groups are left out; groups without values have no rows. The work is the number of draws; what is shuffled is about twice the root of a group's size for each resample.
    """
    d = positioned(rows.select(*by, F.col(value).cast("double").alias("_v")), by, "_v").checkpoint()
    groups = d.select(*by, "_n").distinct().withColumn("_seed", seed.cast("long")).withColumn("_g", F.monotonically_increasing_id()).checkpoint()
    values = d.join(groups.drop("_n", "_seed"), list(by)).select("_g", "_v", "_first", "_c", "_n")
    own = groups.select("_g", F.lit(-1).cast("long").alias("_r"), F.explode(F.expr("array((_n - 1) div 2, _n div 2)")).alias("_pos"))
    found = _looked_up(middle(groups.select("_g", "_n", "_seed"), resamples).unionByName(own), values, "_v")
    return found.groupBy("_g", "_r").agg(F.avg("_v").alias("_m")).join(groups.select("_g", *by), "_g").select(*by, "_r", "_m")


def interval(sorted_values: Column, resamples: int) -> list[Column]:
    """2.5 % and 97.5 % of a sorted array, by index, rounded down."""
    return [F.try_element_at(sorted_values, F.lit(i + 1)) for i in (int(0.025 * resamples), min(resamples - 1, int(0.975 * resamples)))]


def bootstrap_median(rows: DataFrame, by: Sequence[str], value: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """by, median, lo, hi: the median of each group, and 2.5 % and 97.5 % of the medians of its resamples."""
    m = resampled_medians(rows, by, value, resamples, F.lit(seed))
    d = m.groupBy(*by).agg(F.max(F.when(F.col("_r") < 0, F.col("_m"))).alias("median"), F.sort_array(F.collect_list(F.when(F.col("_r") >= 0, F.col("_m")))).alias("_ms"))  # a number for each resample
    lo, hi = interval(F.col("_ms"), resamples)
    return d.select(*by, "median", lo.alias("lo"), hi.alias("hi"))


def slope_of_medians(rows: DataFrame, x: str, value: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """slope, lo, hi: of the medians of groups over their x, and 2.5 % and 97.5 % of it where each group is resampled. One row; all 0 where fewer than two x have values, or one has none.

    For a trend over orders of magnitude, x is a logarithm. A group's draws come from seed + its rank among the x, from 0.
    """
    rank = rows.select(x).where(F.col(x).isNotNull()).distinct().withColumn("_place", F.row_number().over(Window.orderBy(x)) - 1)  # a row for each x
    d = rows.select(x, value).join(F.broadcast(rank), x) if rank.count() <= 10_000 else rows.select(x, value).join(rank, x)
    m = resampled_medians(d, [x, "_place"], value, resamples, F.lit(seed) + F.col("_place"))
    slopes = m.groupBy("_r").agg(F.coalesce(F.regr_slope(F.col("_m"), F.col(x)), F.lit(0.0)).alias("_s"), F.count(F.lit(1)).alias("_k"))
    d = slopes.agg(F.max(F.when(F.col("_r") < 0, F.col("_s"))).alias("_slope"), F.max("_k").alias("_k"), F.sort_array(F.collect_list(F.when(F.col("_r") >= 0, F.col("_s")))).alias("_ss"))
    whole = F.coalesce((F.col("_k") >= 2) & (F.col("_k") == F.col("_groups")), F.lit(False))
    d = d.join(F.broadcast(rank.agg(F.count(F.lit(1)).alias("_groups"))))  # one row each
    found = dict(zip(("slope", "lo", "hi"), (F.col("_slope"), *interval(F.col("_ss"), resamples)), strict=True))
    return d.select(*[F.when(whole, c).otherwise(0.0).alias(name) for name, c in found.items()])
