"""Probabilities as whole billionths ("nanos"): sums are exact, in any order, in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE = 1_000_000_000


def whole_div(wide: Column, total: Column) -> Column:
    """wide div total for decimals beyond BIGINT."""
    return F.call_function("div", wide.cast("decimal(38,0)"), total.cast("decimal(38,0)")).cast("bigint")


def to_nano(p: Column) -> Column:
    """A probability as nanos, ties to even."""
    return F.bround(p * ONE, 0).cast("bigint")


def validate(units: DataFrame, n: int | None = None) -> None:
    """Raises ValueError unless every pi_nano lies in [0, 1] and their sum is whole (and n, if given)."""
    low, high, total = units.agg(F.min("pi_nano"), F.max("pi_nano"), F.sum("pi_nano")).first()
    if low is None:
        raise ValueError("no units")
    if low < 0 or high > ONE:
        raise ValueError("inclusion probabilities lie between 0 and 1")
    if total % ONE or n is not None and total != n * ONE:
        raise ValueError(f"inclusion probabilities sum to {total / ONE}, not to {'a whole number' if n is None else n}")
