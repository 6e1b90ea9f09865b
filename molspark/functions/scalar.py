"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_hot(x: Column, permitted: Sequence[str]) -> Column:
    """0/1 for each permitted value; whatever isn't one of them, null too, counts as the last."""
    own = F.when(x.isin(*permitted), x).otherwise(F.lit(permitted[-1]))
    return F.array(*((own == F.lit(p)).cast("int") for p in permitted))


def affine(x: Column, shift: float, scale: float) -> Column:
    return (x.cast("double") - F.lit(shift)) / F.lit(scale)


def lookup(x: Column, codes: Mapping[str, int]) -> Column:
    """The code, or null for a value without one."""
    return F.try_element_at(F.create_map(*(F.lit(v) for pair in codes.items() for v in pair)), x)


def round_half_even(x: Column, digits: int = 2) -> Column:
    return F.rint(x * F.lit(float(10**digits))) / F.lit(float(10**digits))


def relu(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
