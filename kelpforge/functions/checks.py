"""Values that hold only inside a domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def col(x: Number) -> Column:
    """A Column of a Column or a number."""
    return x if isinstance(x, Column) else F.lit(float(x))


def within(condition: Column, message: str, value: Column) -> Column:
    """value where the condition holds; an error where it does not; null where it is null."""
    return F.when(condition, value).when(~condition, F.raise_error(F.lit(message)))


def positive(*xs: Number) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & (col(x) > 0)
    return out


def share(x: Number) -> Column:
    return (col(x) >= 0) & (col(x) <= 1)
