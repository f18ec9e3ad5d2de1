"""Seeded random numbers as columns: the k-th draw of a seed, whatever the partitioning. Low-discrepancy points, distributions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kelpforge.functions.checks import Number, col

MASK = 0xFFFFFFFF


def _product32(a: Column, b: int | Column) -> Column:
    """a * b modulo 2**32 without overflow of 64 bits."""
    b = F.lit(b) if isinstance(b, int) else b
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(a, 16)
    return (low * b + (high * b.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(0xFFFF)) * 65536).bitwiseAND(F.lit(MASK))


def draw32(seed: Column, k: Column) -> Column:
    """The k-th (from 0) 32-bit number of the generator mulberry32."""

    def step(x: Column, f: Callable[[Column], Column]) -> Column:  # f uses its argument several times; bound to a name, its expression stands in the plan once
        return F.transform(F.array(x), f)[0]

    n = step((k.cast("long") + 1).bitwiseAND(F.lit(MASK)), lambda n: _product32(n, 0x6D2B79F5))
    a = (seed.cast("long").bitwiseAND(F.lit(MASK)) + n).bitwiseAND(F.lit(MASK))
    t = step(a, lambda a: _product32(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1))))
    t = step(t, lambda t: t.bitwiseXOR((t + _product32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK))))
    return step(t, lambda t: t.bitwiseXOR(F.shiftrightunsigned(t, 14)))


def draws32(seed: int, k: np.ndarray) -> np.ndarray:
    """The same for an array of k, as unsigned 32-bit numbers."""
    with np.errstate(over="ignore"):
        a = np.uint32(seed & MASK) + (k.astype(np.uint32) + np.uint32(1)) * np.uint32(0x6D2B79F5)
        t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
        t = t ^ (t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61)))
        return t ^ (t >> np.uint32(14))


def uniform(seed: Column, k: Column) -> Column:
    """In [0, 1)."""
    return draw32(seed, k) / 4294967296.0


@F.arrow_udf(DoubleType())
def uniform64(seed: pa.Array, k: pa.Array) -> pa.Array:
    """The k-th number of splitmix64 as a double; SQL has no unsigned 64-bit products."""
    with np.errstate(over="ignore"):
        z = seed.cast(pa.int64()).to_numpy().view(np.uint64) + (k.cast(pa.int64()).to_numpy().view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return pa.array(z.astype(np.float64) / 2.0**64)


def normal_pair(u1: Column, u2: Column) -> tuple[Column, Column]:
    """Box-Muller."""
    r = F.sqrt(-2 * F.ln(F.greatest(u1, F.lit(1e-12))))
    return r * F.cos(u2 * (2 * np.pi)), r * F.sin(u2 * (2 * np.pi))


PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73)


def radical_inverse(i: Column, base: int) -> Column:
    """Digits of i in the base, mirrored at the point. As long as any index of a batch has digits left; at most as many as 63 bits have."""
    most = int(np.ceil(63 * np.log(2) / np.log(base)))

    @F.arrow_udf(DoubleType())
    def mirrored(i: pa.Array) -> pa.Array:
        n, f, x = i.fill_null(0).to_numpy(zero_copy_only=False), 1.0, np.zeros(len(i))
        for _ in range(most):
            if not n.any():
                break
            f /= base
            n, digit = np.divmod(n, base)
            x += digit * f
        return pa.array(x, mask=i.is_null().to_numpy(zero_copy_only=False))

    return mirrored(i.cast("long"))


def halton(i: Column, dims: int) -> list[Column]:
    if dims > len(PRIMES):
        raise ValueError(f"points of at most {len(PRIMES)} dimensions")
    return [radical_inverse(i, p) for p in PRIMES[:dims]]


# Degree, coefficients and first direction numbers of dimensions 2 to 21, as published by Joe and Kuo (2008).
JOE_KUO = (
    (1, 0, 1),
    (2, 1, 1, 3),
    (3, 1, 1, 3, 1),
    (3, 2, 1, 1, 1),
    (4, 1, 1, 1, 3, 3),
    (4, 4, 1, 3, 5, 13),
    (5, 2, 1, 1, 5, 5, 17),
    (5, 4, 1, 1, 5, 5, 5),
    (5, 7, 1, 1, 7, 11, 19),
    (5, 11, 1, 1, 5, 1, 1),
    (5, 13, 1, 1, 1, 3, 11),
    (5, 14, 1, 3, 5, 5, 31),
    (6, 1, 1, 3, 3, 9, 7, 49),
    (6, 13, 1, 1, 1, 15, 21, 21),
    (6, 16, 1, 3, 1, 13, 27, 49),
    (6, 19, 1, 1, 1, 15, 7, 5),
    (6, 22, 1, 3, 1, 15, 13, 25),
    (6, 25, 1, 1, 5, 5, 19, 61),
    (7, 1, 1, 3, 7, 11, 23, 15, 103),
    (7, 4, 1, 3, 7, 13, 13, 15, 69),
)
SOBOL_BITS = 30


@lru_cache(None)
def directions(dim: int) -> tuple[int, ...]:
    """Direction numbers of a dimension (from 0), scaled to 30 bits."""
    if dim == 0:
        return tuple(1 << (SOBOL_BITS - 1 - b) for b in range(SOBOL_BITS))
    if dim > len(JOE_KUO):
        raise ValueError(f"points of at most {len(JOE_KUO) + 1} dimensions")
    s, a, *m = JOE_KUO[dim - 1]
    for k in range(s, SOBOL_BITS):
        new = m[k - s] ^ (m[k - s] << s)
        for j in range(1, s):
            new ^= (a >> (s - 1 - j) & 1) * (m[k - j] << j)
        m.append(new)
    return tuple(v << (SOBOL_BITS - 1 - k) for k, v in enumerate(m[:SOBOL_BITS]))


def sobol(i: Column, dim: int) -> Column:
    """Coordinate of the i-th Sobol point in Gray-code order, found without the points before it."""
    i = i.cast("long")
    i = F.when((i < 0) | (i >= 1 << SOBOL_BITS), F.raise_error(F.lit(f"the index of a point must lie in [0, 2 ** {SOBOL_BITS})"))).otherwise(i)
    gray = i.bitwiseXOR(F.shiftrightunsigned(i, 1))
    x = F.lit(0).cast("long")
    for b, v in enumerate(directions(dim)):
        x = x.bitwiseXOR(F.shiftrightunsigned(gray, b).bitwiseAND(F.lit(1)) * v)
    return x / float(1 << SOBOL_BITS)


# The coefficients of Wichura's algorithm AS 241, numerators and denominators by rising power, for the middle, the shoulders and the tails.
QUANTILE_MIDDLE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
QUANTILE_SHOULDERS = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
QUANTILE_TAILS = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(coefficients: tuple, x: Column) -> Column:
    above, below = (reduce(lambda total, c: total * x + c, reversed(some[:-1]), F.lit(some[-1])) for some in coefficients)
    return above / below


def normal_quantile(u: Column) -> Column:
    """Of the standard normal distribution, as a column; u is kept 1e-15 away from 0 and 1."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), u))
    q = p - 0.5
    r = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    outer = F.signum(q) * F.when(r <= 5, _ratio(QUANTILE_SHOULDERS, r - 1.6)).otherwise(_ratio(QUANTILE_TAILS, r - 5))
    return F.when(u.isNull() | F.isnan(u), u).otherwise(F.when(F.abs(q) <= 0.425, q * _ratio(QUANTILE_MIDDLE, 0.180625 - q * q)).otherwise(outer))


class Input:
    """One uncertain input: a family and two parameters. fixed(p1), uniform(p1, p2), loguniform(p1, p2), normal(mean, sd), lognormal(geometric mean, geometric sd)."""

    FAMILIES = ("fixed", "uniform", "loguniform", "normal", "lognormal")

    def __init__(self, family: str, p1: float, p2: float = 0.0):
        if family not in self.FAMILIES:
            raise ValueError(f"no family {family}")
        if family != "fixed" and family not in ("normal", "lognormal") and not p1 < p2:
            raise ValueError("the upper end must lie above the lower one")
        if family == "loguniform" and p1 <= 0 or family == "lognormal" and (p1 <= 0 or p2 <= 1) or family == "normal" and p2 <= 0:
            raise ValueError("parameters out of range")
        self.family, self.p1, self.p2 = family, float(p1), float(p2)

    def at(self, u: Column) -> Column:
        """The quantile at u."""
        if self.family == "fixed":
            return F.lit(self.p1)
        if self.family == "uniform":
            return u * (self.p2 - self.p1) + self.p1
        if self.family == "loguniform":
            return F.exp(u * float(np.log(self.p2 / self.p1))) * self.p1
        z = normal_quantile(u)
        return z * self.p2 + self.p1 if self.family == "normal" else F.exp(z * float(np.log(self.p2))) * self.p1

    def mean(self) -> float:
        if self.family == "uniform":
            return (self.p1 + self.p2) / 2
        if self.family == "loguniform":
            return (self.p2 - self.p1) / float(np.log(self.p2 / self.p1))
        return self.p1 * float(np.exp(np.log(self.p2) ** 2 / 2)) if self.family == "lognormal" else self.p1


def draws(inputs: dict[str, Input], row: Column, seed: Number) -> dict[str, Column]:
    """Quantiles at independent uniform draws, row by row in the order of the inputs."""
    active: Sequence[str] = list(inputs)
    return {name: inputs[name].at(uniform(col(seed), row * len(active) + j)) for j, name in enumerate(active)}
