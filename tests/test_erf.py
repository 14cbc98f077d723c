"""``erf`` of arrays: every branch, odd values, any shape."""

import math

import numpy as np

from flightline.functions import mathx


def test_values_equal_whole_array_polynomials_and_the_library():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 3, 40_000), [0.0, 0.46875, -0.46875, 4.0, -4.0, 6.0, -6.0, 1e300, math.inf, -math.inf]])
    y, square, poly = np.abs(x), x * x, lambda v, c: np.polyval(c, v)
    with np.errstate(all="ignore"):
        small = x * poly(square, mathx._ERF_SMALL_NUM) / poly(square, mathx._ERF_SMALL_DEN)
        mid = np.exp(-square) * poly(y, mathx._ERFC_MID_NUM) / poly(y, mathx._ERFC_MID_DEN)
        inverse = 1.0 / square
        ratio = inverse * poly(inverse, mathx._ERFC_TAIL_NUM) / poly(inverse, mathx._ERFC_TAIL_DEN)
        tail = np.exp(-square) * (mathx._INV_SQRT_PI - ratio) / y
    large = np.sign(x) * (1.0 - np.where(y <= 4.0, mid, np.where(y < 6.0, tail, 0.0)))
    assert np.array_equal(mathx.erf_values(x), np.where(y <= 0.46875, small, large))
    assert max(abs(a - math.erf(b)) for a, b in zip(mathx.erf_values(x), x.tolist())) < 1e-14
    assert np.array_equal(mathx.erf_values(x[:40_000].reshape(200, 200)).ravel(), mathx.erf_values(x[:40_000]))
    assert math.isnan(mathx.erf_values(np.array([math.nan]))[0]) and mathx.erf_values(np.empty((0, 22))).shape == (0, 22)


def test_only_the_branch_of_a_value_is_worked_out(monkeypatch):
    worked = []
    monkeypatch.setattr(mathx, "_poly", lambda v, c, poly=mathx._poly: worked.append(v.size) or poly(v, c))
    mathx.erf_values(np.linspace(-8.0, 8.0, 1_001))
    assert sum(worked) <= 2 * 1_001
