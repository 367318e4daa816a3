"""Distribution functions, from published formulas (series and continued fractions), vectorised with numpy."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _beta_fraction(a, b, x):
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / np.where(np.abs(c) < tiny, tiny, c)
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def beta_cdf(x, a, b):
    """The regularised incomplete beta function."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    low = inside < (a + 1) / (a + b + 2)
    direct = front * _beta_fraction(a, b, inside) / a
    mirrored = 1 - front * _beta_fraction(b, a, 1 - inside) / b
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, direct, mirrored)))


def beta_ppf(q, a, b):
    """By bisection; a and b positive."""
    q, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (q, a, b)))
    low, high = np.zeros(q.shape), np.ones(q.shape)
    for _ in range(80):
        middle = (low + high) / 2
        below = beta_cdf(middle, a, b) < q
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def normal_sf(x):
    return 0.5 * _erfc(np.asarray(x, float) / math.sqrt(2))


def t_sf2(t, df):
    """Two-sided p of Student's t; the normal where df is infinite."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    finite = np.isfinite(df)
    safe = np.where(finite, df, 1.0)
    with np.errstate(invalid="ignore"):
        p = np.where(finite, beta_cdf(safe / (safe + t * t), safe / 2, 0.5), 2 * normal_sf(np.abs(t)))
    return np.where(np.isnan(t), np.nan, p)


def chi2_sf(x, df):
    """Upper regularised incomplete gamma function of df / 2 and x / 2."""

    def one(x, df):
        a, x = df / 2, x / 2
        if not x > 0:
            return 1.0 if x == 0 or x < 0 else math.nan
        front = math.exp(-x + a * math.log(x) - math.lgamma(a))
        if x < a + 1:
            total = term = 1 / a
            n = a
            while abs(term) > abs(total) * 1e-16:
                n += 1
                term *= x / n
                total += term
            return 1 - total * front
        b = x + 1 - a
        c, d = 1e300, 1 / b
        h = d
        for i in range(1, 1000):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b or 1e-300)
            c = b + an / c or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return front * h

    return np.vectorize(one, otypes=[float])(x, df)


def f_sf(f, d1, d2):
    """Upper tail of F; chi-square over d1 where d2 is infinite."""
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, d1, d2)))
    finite = np.isfinite(d2)
    safe = np.where(finite, d2, 1.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        exact = beta_cdf(safe / (safe + d1 * f), safe / 2, d1 / 2)
    return np.where(finite, exact, chi2_sf(np.where(finite, 0.0, f * d1), d1))


def digamma(x):
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while np.any(x < 8):
        small = x < 8
        out = np.where(small, out - 1 / x, out)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x):
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while np.any(x < 8):
        small = x < 8
        out = np.where(small, out + 1 / (x * x), out)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - 5 * y / 66))))


def inverse_trigamma(value: float) -> float:
    """Newton steps on 1 / trigamma, which is nearly linear."""
    if value > 1e7:
        return 1 / math.sqrt(value)
    if value < 1e-6:
        return 1 / value
    y = 0.5 + 1 / value
    for _ in range(60):
        tri = float(trigamma(y))
        h = 1e-5 * y
        slope = (float(trigamma(y + h)) - float(trigamma(y - h))) / (2 * h)
        step = tri * (1 - tri / value) / slope
        y += step
        if abs(step) < 1e-10 * y:
            break
    return y


def fisher_exact(a: int, b: int, c: int, d: int, alternative: str = "two-sided") -> float:
    """p of the 2 x 2 table [[a, b], [c, d]]."""
    row, column, total = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + column - total), min(row, column)

    def log_p(k: int) -> float:
        lg = math.lgamma
        return lg(row + 1) - lg(k + 1) - lg(row - k + 1) + lg(total - row + 1) - lg(column - k + 1) - lg(total - row - column + k + 1) - (lg(total + 1) - lg(column + 1) - lg(total - column + 1))

    here = log_p(a)
    if alternative == "greater":
        own = range(a, hi + 1)
    elif alternative == "less":
        own = range(lo, a + 1)
    else:
        return min(1.0, sum(math.exp(p) for k in range(lo, hi + 1) if (p := log_p(k)) <= here + 1e-7))
    return min(1.0, sum(math.exp(log_p(k)) for k in own))
