"""The two-state rule as columns: a signal is either flat or moves at a known rate per tick."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def band_deviation(value: Column, lower: Column, upper: Column) -> Column:
    """Distance of ``value`` to the band [lower, upper]; 0 inside it, NULL for NULL (``greatest`` would skip it)."""
    return F.when(value.isNotNull(), F.greatest(lower - value, value - upper, F.lit(0.0)))


def static_curve(x: Column, a: float = 40.0, b: float = 0.0, c: float = 0.0) -> Column:
    """Resting output for a constant input."""
    return F.lit(a) * x * x + F.lit(b) * x + F.lit(c)


def move_towards(start: Column, target: Column, reach: Column) -> Column:
    """``start`` moved towards ``target`` by at most ``reach``."""
    gap = target - start
    return start + F.signum(gap) * F.least(F.abs(gap), reach)


@dataclass(frozen=True)
class TwoState:
    """Parameters of the two-state rule. ``steepness`` is the expected change per tick, scaled like the signal."""

    steepness: float
    tolerance: float = 0.1
    theta: float = 1.0
    ratio: float = 1.0
    normalized: bool = False

    def __post_init__(self) -> None:
        if self.steepness * self.tolerance < 0:
            raise ValueError("steepness * tolerance must not be negative")

    @property
    def beta(self) -> float:
        return 1 / (self.ratio + 1)

    @property
    def alpha(self) -> float:
        return 1 - self.beta

    @property
    def band(self) -> tuple[float, float]:
        """Steps that count as moving at the known rate."""
        return self.steepness * (1 - self.tolerance), self.steepness * (1 + self.tolerance)

    @property
    def still(self) -> float:
        """Largest step that counts as standing still."""
        return self.tolerance * self.steepness

    def errors_at_rest(self) -> tuple[float, float]:
        """Static and moving error of a step of size 0."""
        low, high = self.band
        return max(-self.still, 0.0) ** 2, max(low, -high, 0.0) ** 2

    def moving_error(self, d: Column) -> Column:
        """Squared distance of an absolute difference to the rate band."""
        low, high = self.band
        off = band_deviation(d, F.lit(float(low)), F.lit(float(high)))
        return off * off

    def static_error(self, d: Column) -> Column:
        """Squared distance of an absolute difference to standing still."""
        off = F.when(d.isNotNull(), F.greatest(d - F.lit(float(self.still)), F.lit(0.0)))
        return off * off

    def combine(self, mse: Column, tgds: Column) -> Column:
        weight = (1 - self.theta) if self.normalized else 1.0
        return F.lit(float(weight)) * mse + F.lit(float(self.theta)) * tgds
