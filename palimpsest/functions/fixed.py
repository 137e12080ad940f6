"""Values at fixed point, so that the order in which floats were summed decides no ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """A whole number of units of the last digit. The cut isn't at half a unit, where short decimals lie."""
    return F.floor(value * float(10**digits) + 0.3)
