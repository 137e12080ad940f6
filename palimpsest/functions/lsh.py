"""MinHash and banding in column expressions, and the choice of bands."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2**31 - 1


@lru_cache
def best_bands(threshold: float, permutations: int, step: float = 0.001) -> tuple[int, int]:
    """Bands and rows, of at most so many permutations, with the least even mix of false positives and false negatives.

    The chance that sets of similarity s meet in a band is 1 - (1 - s^r)^b; its integral below the threshold is what is
    found in vain, that of its complement above what is missed. All pairs of bands and rows are tried.
    """
    grid = step * (np.arange(round(1 / step)) + 0.5)
    above = grid >= threshold
    best, choice = float("inf"), (1, permutations)
    for rows in range(1, permutations + 1):
        apart = 1 - grid**rows
        missed = np.ones_like(grid)
        for bands in range(1, permutations // rows + 1):
            missed = missed * apart
            error = step * np.where(above, missed, 1 - missed).sum() / 2
            if error < best - 1e-12:
                best, choice = error, (bands, rows)
    return choice


@dataclass(frozen=True)
class Family:
    """Hash functions (a x + b) mod 2^31 - 1, from a seed."""

    permutations: int
    seed: int = 42

    def coefficients(self) -> list[tuple[int, int]]:
        state, out = self.seed, []
        for _ in range(self.permutations):
            pair = []
            for _ in range(2):
                state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
                pair.append((state >> 33) % (PRIME - 1) + 1)
            out.append((pair[0], pair[1]))
        return out

    def signature(self, items: Column) -> Column:
        """The least hash of a set of items under each function."""
        table = F.array(*(F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in self.coefficients()))
        return F.transform(table, lambda h: F.array_min(F.transform(items, lambda x: F.pmod(h["a"] * F.pmod(x, F.lit(PRIME)) + h["b"], F.lit(PRIME)))))


def bands(signature: Column, n: int, rows: int) -> Column:
    """An array of ``band, rows``: the pieces of a signature."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("band"), F.slice(signature, i * rows + 1, rows).alias("rows")))
