"""Weights by position and decays of scores, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_decay(position: Column) -> Column:
    """1 - 0.1 p below 100, else 0. Negative between 10 and 100, on purpose."""
    return F.when(position < 100, 1 - 0.1 * position).otherwise(0.0)


def match_decay_tenths(position: Column) -> Column:
    """Ten times the same, in integers."""
    return F.when(position < 100, 10 - position).otherwise(0).cast("bigint")


#: Decay of a neighbour's items with the distance i of the first match from the latest click.
SCORE_DECAYS: dict[str, Callable[[Column], Column]] = {
    "linear": lambda i: F.when(i <= 100, 1 - 0.1 * i).otherwise(0.0),
    "same": lambda i: F.lit(1.0),
    "div": lambda i: 1.0 / i,
    "log": lambda i: 1.0 / F.log10(i + 1.7),
    "quadratic": lambda i: 1.0 / (i * i),
}

#: Weight of the i-th of n clicks of a session.
POSITION_WEIGHTS: dict[str, Callable[[Column, Column], Column]] = {
    "linear": lambda i, n: F.when(i <= 10, 1 - 0.1 * (n - i)).otherwise(0.0),
    "same": lambda i, n: F.lit(1.0),
    "div": lambda i, n: i.cast("double") / n,
    "log": lambda i, n: 1.0 / F.log10((n - i) + 1.7),
    "quadratic": lambda i, n: (i.cast("double") / n) * (i.cast("double") / n),
}


def day_decay(days: Column) -> Column:
    """7/8 for each day."""
    return F.pow(F.lit(7.0 / 8.0), days)
