"""Transforms of a dense marginal as Column expressions (numpy's convention: the inverse carries 1 / d)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dft(marginal: DataFrame, axes: dict[str, int], value: str = "n") -> DataFrame:
    """marginal(columns of axes, value) -> (j_<axis>..., re, im); frequencies come from the fixed axis sizes.

    Each row is expanded to the frequencies, so this is for one or two axes; larger marginals use numpy's FFT.
    """
    angle: Column = F.lit(0.0)
    out = marginal
    for a, d in axes.items():
        out = out.withColumn(f"j_{a}", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
        angle = angle + F.lit(2 * math.pi / d) * F.pmod(F.col(a) * F.col(f"j_{a}"), F.lit(d))
    keys = [f"j_{a}" for a in axes]
    return out.groupBy(*keys).agg(F.sum(F.col(value) * F.cos(angle)).alias("re"), (-F.sum(F.col(value) * F.sin(angle))).alias("im"))


def conjugate(j: Column, d: int) -> Column:
    return F.pmod(F.lit(d) - j, F.lit(d))


def multiplier(freq: Column, conj: Column) -> Column:
    """1 for a frequency that is its own conjugate, else 4 (arrays)."""
    return F.when(freq == conj, 1).otherwise(4)
