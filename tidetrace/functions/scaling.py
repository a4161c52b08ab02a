"""Scaling by declared bounds. Values outside the bounds leave [0, 1]; nothing is clipped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _span(lo: Column, hi: Column) -> Column:
    return F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)


def minmax_scale(x: Column, lo: Column, hi: Column) -> Column:
    return (x - lo) / _span(lo, hi)


def minmax_inverse(z: Column, lo: Column, hi: Column) -> Column:
    return z * _span(lo, hi) + lo


def scale_steepness(steepness: Column, lo: Column, hi: Column, mode: str = "affine") -> Column:
    """A rate in output units per tick, scaled like the outputs.

    ``affine`` treats the rate as a value and subtracts the lower bound too, which is how the published models were trained;
    ``linear`` only divides by the span.
    """
    if mode == "affine":
        return minmax_scale(steepness, lo, hi)
    if mode == "linear":
        return steepness / _span(lo, hi)
    raise ValueError(f"mode must be 'affine' or 'linear', not {mode!r}")
