"""Draws that depend on a seed and a row's key only: the same on any cluster and in any order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustframe.functions.nulls import col


def uniform(seed: int, salt: int, *key: Column | str) -> Column:
    """Between 0 and 1, without either."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *[col(k) for k in key]), F.lit(2**52)) + 0.5) / float(2**52)


def normal(seed: int, *key: Column | str) -> Column:
    """From the standard normal distribution, by Box and Muller."""
    return F.sqrt(-2 * F.ln(uniform(seed, 1, *key))) * F.cos(2 * math.pi * uniform(seed, 2, *key))
