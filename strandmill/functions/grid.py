"""The quantization grid of elapsed times, and the nearest-point lookup as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the method: the grid's centre, step, and steps to either side.
CENTER, STEP, STEPS = 0.03, 1.1, 64


def grid(center: float = CENTER, step: float = STEP, steps: int = STEPS, rounded: bool = True) -> list[float]:
    """Geometric points around center, rounded to eight decimals unless told otherwise."""
    points = [center * step**k for k in range(-steps, steps + 1)]
    return [float(f"{p:.8f}") for p in points] if rounded else points


def bucket(t: Column, points: list[float]) -> Column:
    """The index of the grid point nearest to t by relative distance, the upper of two equally near; null outside
    the closed range of the grid.

    The place in a (roughly) geometric grid is guessed by a logarithm and put right by comparing with the points
    around it, so the lookup stays inside the projection that it is part of.  Grids that are not geometric enough
    are looked up by counting the points below.
    """
    if len(points) == 1:
        return F.when(t == points[0], F.lit(0))
    last = len(points) - 1
    array = F.array(*[F.lit(float(p)) for p in points])
    at = lambda i: F.get(array, i)
    ratio = math.log(points[-1] / points[0]) / last
    if all(abs(math.log(p / points[0]) / ratio - k) < 0.49 for k, p in enumerate(points)):
        guess = F.least(F.greatest(F.floor(F.log(t / points[0]) / ratio).cast("int"), F.lit(0)), F.lit(last))
        low = F.when(at(guess) > t, F.greatest(guess - 1, F.lit(0))).when((guess < last) & (at(guess + 1) <= t), guess + 1).otherwise(guess)
    else:
        low = F.size(F.filter(array, lambda p: p <= t)) - 1
    found = F.when(t == at(low), low).when(t / at(low) - 1 < at(low + 1) / t - 1, low).otherwise(low + 1)
    return F.when(t.between(points[0], points[-1]), found)


def site_rate_grid(k: int = 20) -> list[float]:
    """k geometric site rates from 1 / k to k; one rate is 1."""
    return [1.0] if k == 1 else [k ** (-1 + 2 * i / (k - 1)) for i in range(k)]


def log_gamma_prior(rate: float) -> float:
    """Log-density of the gamma distribution with shape 3 and mean 1."""
    return 3 * math.log(3) - math.log(2) + 2 * math.log(rate) - 3 * rate


def gamma_mass_below(x: float) -> float:
    """Its cumulative distribution."""
    return 1 - math.exp(-3 * x) * (1 + 3 * x + 4.5 * x * x)


def initial_rate_weights(rates: list[float]) -> list[float]:
    """Share of the gamma distribution nearest to each of the ascending rates."""
    cuts = [0.0, *((a + b) / 2 for a, b in zip(rates, rates[1:], strict=False))]
    below = [gamma_mass_below(c) for c in cuts] + [1.0]
    return [b - a for a, b in zip(below, below[1:], strict=False)]
