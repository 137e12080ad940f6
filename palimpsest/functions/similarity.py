"""Similarities of two sets from the sizes of both and of what they share, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMILARITIES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "jaccard": lambda both, a, b: both.cast("double") / (a + b - both),
    "cosine": lambda both, a, b: both / (F.sqrt(a.cast("double")) * F.sqrt(b.cast("double"))),
    "tanimoto": lambda both, a, b: both.cast("double") / (a + b - both),
    "binary": lambda both, a, b: (2 * both).cast("double") / (2 * both + a + b),
}


def softmax(value: Column, window) -> Column:
    """Softmax over a window, shifted by its largest value."""
    e = F.exp(value - F.max(value).over(window))
    return e / F.sum(e).over(window)
