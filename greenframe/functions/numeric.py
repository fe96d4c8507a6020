"""Bisection, hashed random numbers and the normal distribution as column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_array(values: list[float]) -> Column:
    """An array of finite doubles, as one parsed expression."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")").cast("array<double>")


def bisect_right(sorted_values: Column, value: Column, longest: int) -> Column:
    """Number of entries at or below ``value`` in an array of at most ``longest`` entries."""
    jumps = F.array(*[F.lit(2**p) for p in reversed(range(max(1, longest.bit_length())))])
    return F.aggregate(
        jumps, F.lit(0),
        lambda at, jump: F.when(
            (at + jump <= F.size(sorted_values)) & (F.get(sorted_values, at + jump - 1) <= value), at + jump
        ).otherwise(at),
    )


def hashed_uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on ``parts`` only, not on partitions or task order."""
    return (F.pmod(F.xxhash64(*parts), F.lit(2**52)).cast("double") + 0.5) / float(2**52)


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    """Horner's scheme, highest power first."""
    return reduce(lambda total, c: total * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


# Acklam's rational approximation of the normal quantile function
_TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
_TAIL_BOTTOM = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0]
_MID_TOP = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239]
_MID_BOTTOM = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0]
_TAIL = 0.02425
# Abramowitz and Stegun 26.2.17, the normal distribution function
_CDF = [1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530, 0.0]
_CDF_SCALE = 0.2316419


def normal_quantile(u: Column) -> Column:
    low = F.sqrt(-2.0 * F.log(u))
    high = F.sqrt(-2.0 * F.log(1.0 - u))
    middle = u - 0.5
    square = middle * middle
    return (
        F.when(u < _TAIL, _polynomial(low, _TAIL_TOP) / _polynomial(low, _TAIL_BOTTOM))
        .when(u > 1 - _TAIL, -_polynomial(high, _TAIL_TOP) / _polynomial(high, _TAIL_BOTTOM))
        .otherwise(middle * _polynomial(square, _MID_TOP) / _polynomial(square, _MID_BOTTOM))
    )


def normal_cdf(z: Column) -> Column:
    distance = F.abs(z)
    t = 1.0 / (1.0 + _CDF_SCALE * distance)
    upper = F.exp(-distance * distance / 2.0) * 0.3989422804014327 * _polynomial(t, _CDF)
    return F.when(z >= 0, 1.0 - upper).otherwise(upper)


def normal_quantiles(u: np.ndarray) -> np.ndarray:
    """As :func:`normal_quantile`, for arrays inside a task. Logarithms are taken of the few numbers in the tails only."""
    tail = lambda x: np.polyval(_TAIL_TOP, x) / np.polyval(_TAIL_BOTTOM, x)
    middle = u - 0.5
    square = middle * middle
    z = middle * np.polyval(_MID_TOP, square) / np.polyval(_MID_BOTTOM, square)
    low, high = u < _TAIL, u > 1 - _TAIL
    with np.errstate(divide="ignore", invalid="ignore"):
        z[low] = tail(np.sqrt(-2.0 * np.log(u[low])))
        z[high] = -tail(np.sqrt(-2.0 * np.log(1.0 - u[high])))
    return z


def normal_cdfs(z: np.ndarray) -> np.ndarray:
    """As :func:`normal_cdf`, for arrays inside a task."""
    distance = np.abs(z)
    upper = np.exp(-distance * distance / 2.0) * 0.3989422804014327 * np.polyval(_CDF, 1.0 / (1.0 + _CDF_SCALE * distance))
    return np.where(z >= 0, 1.0 - upper, upper)
