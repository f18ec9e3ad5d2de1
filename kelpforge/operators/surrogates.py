"""Polynomial surrogates of a column: least squares over orthonormal polynomials of other columns, what they say about mean and spread, and estimates that they steady.

The fit is a tall, narrow least-squares problem. Every task reduces its rows to a triangle (as wide as there are terms), triangles are stacked and reduced in a tree,
and the last one is solved. No Gram matrix is formed, which would lose half of the digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kelpforge.functions.random import Input
from kelpforge.operators.uncertainty import Finding, monte_carlo
from kelpforge.session import with_checkpoints

#: Terms that a fit may have; a triangle of so many takes 32 MB.
MOST_TERMS = 2000
#: Triangles stacked at a time, and rows of a block.
FAN_IN = 16
BLOCK = 4096
#: Two-sided 90 % of a normal distribution.
NINETY = 1.6448536269514722


@dataclass(frozen=True)
class Basis:
    """Orthonormal polynomials of a column that is spread as the family says: uniform between p1 and p2, or normal with mean p1 and standard deviation p2."""

    family: str
    p1: float
    p2: float

    def __post_init__(self) -> None:
        if self.family not in ("uniform", "normal"):
            raise ValueError(f"no polynomials for {self.family}")
        if not (self.p1 < self.p2 if self.family == "uniform" else self.p2 > 0):
            raise ValueError("parameters out of range")

    def place(self) -> tuple[float, float]:
        """What is taken off a value and what it is then divided by, so that it lies in the family's own range."""
        return ((self.p1 + self.p2) / 2, (self.p2 - self.p1) / 2) if self.family == "uniform" else (self.p1, self.p2)

    def roots(self, degree: int) -> list[float]:
        """Square roots of the recurrence's coefficients b(0) to b(degree): root(n + 1) psi(n + 1) = z psi(n) - root(n) psi(n - 1). Both families are symmetric, so no other term stands in it."""
        b = [0.0] + [n * n / (4.0 * n * n - 1) if self.family == "uniform" else float(n) for n in range(1, degree + 1)]
        return [math.sqrt(v) for v in b]

    def values(self, x: Column, degree: int) -> Column:
        """psi(0) to psi(degree) as an array, by a fold."""
        off, by = self.place()
        z, r = (x - off) / by, self.roots(degree)
        steps = F.array(*[F.struct(F.lit(r[n]).alias("down"), F.lit(1 / r[n + 1]).alias("up")) for n in range(degree)])
        start = F.struct(F.array(F.lit(1.0)).alias("all"), F.lit(0.0).alias("before"), F.lit(1.0).alias("last"))

        def step(s: Column, k: Column) -> Column:
            new = (z * s["last"] - k["down"] * s["before"]) * k["up"]
            return F.struct(F.concat(s["all"], F.array(new)).alias("all"), s["last"].alias("before"), new.alias("last"))

        return F.aggregate(steps, start, step, lambda s: s["all"])

    def table(self, x: np.ndarray, degree: int) -> np.ndarray:
        """The same for an array: a row per degree."""
        off, by = self.place()
        z, r = (x - off) / by, self.roots(degree)
        out = [np.ones_like(z), z / r[1]]
        for n in range(1, degree):
            out.append((z * out[n] - r[n] * out[n - 1]) / r[n + 1])
        return np.stack(out[: degree + 1])


def multi_indices(inputs: int, degree: int) -> list[tuple[int, ...]]:
    """All ways to give each input a degree so that the sum is at most the degree; the constant comes first."""
    if degree < 1 or inputs < 1:
        raise ValueError("a surrogate needs an input and a degree of at least 1")
    n = math.comb(degree + inputs, inputs)
    if n > MOST_TERMS:
        raise ValueError(f"{n} terms; at most {MOST_TERMS} are fitted")
    ways = product(range(degree + 1), repeat=inputs) if (degree + 1) ** inputs <= 1 << 20 else _ways(inputs, degree)
    return sorted((a for a in ways if sum(a) <= degree), key=lambda a: (sum(a), a))


def _ways(inputs: int, degree: int) -> Iterator[tuple[int, ...]]:
    if inputs == 0:
        yield ()
        return
    for k in range(degree + 1):
        for rest in _ways(inputs - 1, degree - k):
            yield (k, *rest)


@dataclass(frozen=True)
class Surrogate:
    """coefficients: one for each of terms (a degree per input). n: rows fitted. residual: root mean square of what is left, relative to the spread of the column."""

    bases: dict[str, Basis]
    degree: int
    terms: tuple[tuple[int, ...], ...]
    coefficients: tuple[float, ...]
    n: int
    residual: float

    def trustworthy(self, most: float = 0.01) -> bool:
        """False where the column is no smooth function of the inputs; what the coefficients say of it is then not to be quoted."""
        return self.residual < most

    def table(self, spark: SparkSession) -> DataFrame:
        """degrees (array, in the order of the inputs) and coefficient: a row per term."""
        return spark.createDataFrame([(list(a), c) for a, c in zip(self.terms, self.coefficients, strict=True)], "degrees array<int>, coefficient double")

    def predicted(self, rows: DataFrame, name: str = "predicted") -> DataFrame:
        """rows with the surrogate's value; null where an input is."""
        terms, coefficients, degree, bases = self.terms, self.coefficients, self.degree, list(self.bases.values())

        @F.arrow_udf(DoubleType())
        def value(*x: pa.Array) -> pa.Array:
            psi = [b.table(c.to_numpy(zero_copy_only=False), degree) for b, c in zip(bases, x, strict=True)]
            total = np.zeros(len(x[0]))
            for a, c in zip(terms, coefficients, strict=True):
                total += reduce(lambda v, p: v * p[0][p[1]], zip(psi, a, strict=True), c)
            return pa.array(total, mask=np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in x]))

        return rows.withColumn(name, value(*[F.col(c).cast("double") for c in self.bases]))


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The upper triangle of a QR factorisation, with at least as many rows as columns."""
    if len(rows) < rows.shape[1]:
        rows = np.vstack([rows, np.zeros((rows.shape[1] - len(rows), rows.shape[1]))])
    return np.linalg.qr(rows, mode="r")


def _one_row(at: int, n: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([np.ascontiguousarray(r, "<f8").tobytes()], pa.binary())], names=["_at", "_n", "_r"])


def triangle(rows: DataFrame, bases: dict[str, Basis], degree: int, y: str) -> tuple[int, np.ndarray]:
    """Rows with no null among inputs and y: how many, and the triangle of all their terms and, as last column, y."""
    terms, columns = multi_indices(len(bases), degree), list(bases.values())
    width = len(terms) + 1

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = np.zeros((0, width)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = [c.to_numpy(zero_copy_only=False) for c in batch.slice(at, BLOCK).columns]
                if not np.isfinite(x[-1]).all():
                    raise ValueError(f"{y} is not finite in some rows")
                psi = [b.table(v, degree) for b, v in zip(columns, x, strict=False)]
                block = np.stack([*(np.prod([psi[i][k] for i, k in enumerate(a)], axis=0) for a in terms), x[-1]], axis=1)
                r, n = _triangle(np.vstack([r, block])), n + len(block)
        if n:
            yield _one_row(TaskContext.get().partitionId(), n, r)

    def stack(table: pa.Table) -> pa.Table:
        r = np.vstack([np.frombuffer(b, "<f8").reshape(width, width) for b in table["_r"].to_pylist()])
        return pa.Table.from_batches([_one_row(0, sum(table["_n"].to_pylist()), _triangle(r))])

    numbers = rows.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(bases)], F.col(y).cast("double").alias("_y")).dropna()
    with_checkpoints(rows.sparkSession)
    found = numbers.mapInArrow(reduce_rows, "_at long, _n long, _r binary").checkpoint()
    many = found.count()
    while many > 1:
        groups = -(-many // FAN_IN)
        numbered = found.withColumn("_at", F.pmod(F.xxhash64("_at", "_r"), F.lit(groups)))
        found = numbered.groupBy("_at").applyInArrow(stack, "_at long, _n long, _r binary").withColumn("_at", F.monotonically_increasing_id()).checkpoint()
        many = found.count()
    last = found.first()
    return (last["_n"], np.frombuffer(bytes(last["_r"]), "<f8").reshape(width, width)) if last else (0, np.zeros((width, width)))


def fit(rows: DataFrame, bases: dict[str, Basis], degree: int, y: str) -> Surrogate:
    """Least squares of y over all products of polynomials with degrees of at most `degree` together.

    Rows with a null among the inputs and y are left out. Values of y that are not finite, fewer rows than terms, and terms that do not differ on these rows are errors.
    """
    terms = multi_indices(len(bases), degree)
    n, r = triangle(rows, bases, degree, y)
    p = len(terms)
    if n <= p:
        raise ValueError(f"{n} rows are too few for {p} terms")
    size = np.abs(np.diag(r)[:p])
    if size.min() <= size.max() * np.finfo(float).eps * max(n, p):
        raise ValueError("terms do not differ on these rows: the fit has no full rank")
    coefficients = np.linalg.solve(r[:p, :p], r[:p, p])
    left, spread = abs(r[p, p]), math.sqrt(float((r[1:, p] ** 2).sum()))  # the first term is constant, so the rest of y's column is its spread
    return Surrogate(dict(bases), degree, tuple(terms), tuple(coefficients.tolist()), n, left / spread if spread > 0 else 0.0 if left == 0 else math.inf)


def relative_residual(rows: DataFrame, fitted: Surrogate, y: str) -> DataFrame:
    """n, residual: the same measure as of the fit, over rows that it has not seen; 0 where y does not vary and is met, infinity where it is not met."""
    d = fitted.predicted(rows, "_g").where(F.col("_g").isNotNull() & F.col(y).isNotNull())
    rms, spread = F.sqrt(F.avg((F.col("_g") - F.col(y)) * (F.col("_g") - F.col(y)))), F.stddev_pop(y)
    return d.agg(F.count(F.lit(1)).alias("n"), rms.alias("_rms"), spread.alias("_sd")).select("n", F.when(F.col("_sd") > 0, F.col("_rms") / F.col("_sd")).when(F.col("_rms") == 0, 0.0).when(F.col("_rms").isNotNull(), float("inf")).alias("residual"))


def of_inputs(spark: SparkSession, inputs: dict[str, Input], finding: Finding, degree: int, n: int, seed: int) -> Surrogate:
    """A surrogate of a finding over its uncertain inputs (uniform or normal ones; fixed ones are constants), fitted on n seeded draws."""
    bases = {c: Basis(i.family, i.p1, i.p2) for c, i in inputs.items() if i.family != "fixed"}
    return fit(monte_carlo(spark, inputs, finding, n, seed), bases, degree, "y")


def moments(terms: DataFrame) -> DataFrame:
    """mean, variance, sd: of a column that is the surrogate, its inputs being independent and spread as their bases say. The basis is orthonormal, so energies of terms add up."""
    constant = ~F.exists("degrees", lambda k: k > 0)
    d = terms.agg(F.coalesce(F.sum(F.when(constant, F.col("coefficient"))), F.lit(0.0)).alias("mean"), F.coalesce(F.sum(F.when(~constant, F.col("coefficient") * F.col("coefficient"))), F.lit(0.0)).alias("variance"))
    return d.withColumn("sd", F.sqrt("variance"))


def indices(terms: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """input, first, total: shares of the variance that an input explains alone, and with others. All 0 where nothing varies."""
    energy = F.col("coefficient") * F.col("coefficient")
    active = F.size(F.filter("degrees", lambda k: k > 0))
    d = terms.where(active > 0).select(energy.alias("_e"), active.alias("_n"), F.posexplode("degrees").alias("_i", "_k"))
    d = d.groupBy("_i").agg(F.sum(F.when((F.col("_k") > 0) & (F.col("_n") == 1), F.col("_e"))).alias("_first"), F.sum(F.when(F.col("_k") > 0, F.col("_e"))).alias("_total"), F.sum("_e").alias("_all"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("_all")), F.lit(0.0))
    names = F.array(*map(F.lit, inputs))
    return d.select(F.element_at(names, F.col("_i") + 1).alias("input"), share("_first").alias("first"), share("_total").alias("total"))


def control_variate(rows: DataFrame, fitted: Surrogate, y: str) -> DataFrame:
    """n, mean, stderr, lo, hi (90 %), variance_ratio: the mean of y, as the surrogate's own mean and the mean of what it leaves of y on rows that it was not fitted on.

    One pass over the rows. The ratio is the variance of y over that of what is left: infinity where nothing is left, 1 where y does not vary either. Rows with nulls are left out.
    """
    left = F.col(y) - F.col("_g")
    d = fitted.predicted(rows, "_g").where(F.col("_g").isNotNull() & F.col(y).isNotNull())
    d = d.agg(F.count(F.lit(1)).alias("n"), F.avg(left).alias("_mean"), F.var_pop(left).alias("_left"), F.var_pop(y).alias("_raw"))
    d = d.select("n", (F.col("_mean") + fitted.coefficients[0]).alias("mean"), F.sqrt(F.try_divide(F.col("_left"), F.col("n"))).alias("stderr"), "_left", "_raw")
    ratio = F.when(F.col("_left") > 0, F.col("_raw") / F.col("_left")).when(F.col("_raw") > 0, float("inf")).when(F.col("n") > 0, 1.0)
    return d.select("n", "mean", "stderr", (F.col("mean") - NINETY * F.col("stderr")).alias("lo"), (F.col("mean") + NINETY * F.col("stderr")).alias("hi"), ratio.alias("variance_ratio"))
