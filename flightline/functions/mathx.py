"""Numeric functions Spark lacks, as JVM-side expressions and for arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational minimax coefficients for erf/erfc (W. J. Cody, 1969), highest power first.
_ERF_SMALL_NUM = (
    1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2,
    3.77485237685302021e2, 3.20937758913846947e3,
)
_ERF_SMALL_DEN = (
    1.0, 2.36012909523441209e1, 2.44024637934444173e2,
    1.28261652607737228e3, 2.84423683343917062e3,
)
_ERFC_MID_NUM = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0,
    6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
    1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
)
_ERFC_MID_DEN = (
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
    1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
    3.43936767414372164e3, 1.23033935480374942e3,
)
_ERFC_TAIL_NUM = (
    1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
    1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4,
)
_ERFC_TAIL_DEN = (
    1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1,
    6.05183413124413191e-2, 2.33520497626869185e-3,
)
_INV_SQRT_PI = 1.0 / math.sqrt(math.pi)
# Values that are worked on together.
_ERF_PIECE = 8_192


def _horner(x: Column, coefficients) -> Column:
    acc = F.lit(coefficients[0])
    for value in coefficients[1:]:
        acc = acc * x + F.lit(value)
    return acc


def erf(x: Column) -> Column:
    """Error function, absolute error below 1e-14. Bind ``x`` to a column or lambda variable."""
    y = F.abs(x)
    small = x * _horner(x * x, _ERF_SMALL_NUM) / _horner(x * x, _ERF_SMALL_DEN)
    mid = F.exp(-x * x) * _horner(y, _ERFC_MID_NUM) / _horner(y, _ERFC_MID_DEN)
    inv = F.lit(1.0) / (x * x)
    tail_ratio = inv * _horner(inv, _ERFC_TAIL_NUM) / _horner(inv, _ERFC_TAIL_DEN)
    tail = F.exp(-x * x) * (F.lit(_INV_SQRT_PI) - tail_ratio) / y
    sign = F.signum(x)
    return (
        F.when(y <= 0.46875, small)
        .when(y <= 4.0, sign * (F.lit(1.0) - mid))
        .when(y < 6.0, sign * (F.lit(1.0) - tail))
        .otherwise(sign)
    )


def norm_cdf_z(z: Column) -> Column:
    """Normal CDF of an argument already divided by ``std * sqrt(2)``."""
    return F.lit(0.5) * (F.lit(1.0) + erf(z))


def _poly(v: np.ndarray, coefficients) -> np.ndarray:
    acc = v * coefficients[0]
    for value in coefficients[1:-1]:
        acc += value
        acc *= v
    acc += coefficients[-1]
    return acc


def _erf_piece(x: np.ndarray) -> np.ndarray:
    y, out = np.abs(x), np.sign(x)
    low, far = y <= 0.46875, y > 4.0
    (small,), (mid,), (tail,) = np.nonzero(low), np.nonzero((y <= 4.0) & ~low), np.nonzero(far & (y < 6.0))
    if small.size:
        v = x[small]
        square = v * v
        out[small] = v * _poly(square, _ERF_SMALL_NUM) / _poly(square, _ERF_SMALL_DEN)
    if mid.size:
        v = y[mid]
        out[mid] *= 1.0 - np.exp(-(v * v)) * _poly(v, _ERFC_MID_NUM) / _poly(v, _ERFC_MID_DEN)
    if tail.size:
        v = y[tail]
        inverse = 1.0 / (v * v)
        ratio = inverse * _poly(inverse, _ERFC_TAIL_NUM) / _poly(inverse, _ERFC_TAIL_DEN)
        out[tail] *= 1.0 - np.exp(-(v * v)) * (_INV_SQRT_PI - ratio) / v
    return out


def erf_values(x: np.ndarray) -> np.ndarray:
    """``erf`` for arrays, by the same approximations, in pieces that stay in the processor's cache."""
    flat = np.ascontiguousarray(x, dtype=float).ravel()
    out = np.empty_like(flat)
    for start in range(0, flat.size, _ERF_PIECE):
        out[start : start + _ERF_PIECE] = _erf_piece(flat[start : start + _ERF_PIECE])
    return out.reshape(x.shape)


def half_even(value: Column) -> Column:
    """Round to the nearest integer, ties to even."""
    return F.rint(value).cast("long")


def is_finite(value: Column) -> Column:
    """True for ordinary numbers; NaN sorts above infinity in Spark, so one comparison decides."""
    return F.coalesce(F.abs(value) < F.lit(math.inf), F.lit(False))
