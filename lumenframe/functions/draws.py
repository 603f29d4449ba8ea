"""Random draws as columns: fresh for every run, or fixed by a key.

Keyed draws are hashes of a row's key, a seed and a number. They are the same in every run, on every partitioning and in
every repeated task, so a column that is read twice or computed again after a lost executor does not change.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


class Fresh:
    """Draws of Spark's generators from a seed; they depend on the partitioning."""

    def __init__(self, seed: int):
        self.seed = seed

    def uniform(self, i: int = 0) -> Column:
        return F.rand(self.seed + i)

    def normal(self) -> Column:
        return F.randn(self.seed)


class Keyed:
    """Draws by the md5 sum of the key columns, a seed and the number of the draw."""

    def __init__(self, key: Sequence[str | Column], seed: int):
        self.key, self.seed = [F.col(k) if isinstance(k, str) else k for k in key], seed

    def uniform(self, i: int = 0) -> Column:
        """Evenly from (0, 1), of 52 bits."""
        text = F.concat_ws("|", *(k.cast("string") for k in self.key), F.lit(str(self.seed)), F.lit(str(i)))
        return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

    def normal(self) -> Column:
        """From the standard normal law, by two even draws."""
        return F.sqrt(-2 * F.ln(self.uniform(0))) * F.cos(2 * math.pi * self.uniform(1))


Draws = Fresh | Keyed


def draws(seed: int, key: Sequence[str | Column] | None = None) -> Draws:
    return Fresh(seed) if key is None else Keyed(key, seed)
