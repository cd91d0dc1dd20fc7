"""Special functions in numpy: error function, gamma and beta with their incomplete forms, quantiles, Bessel functions."""

from __future__ import annotations

import math

import numpy as np

erf = np.vectorize(math.erf, otypes=[float])
erfc = np.vectorize(math.erfc, otypes=[float])
lgamma = np.vectorize(lambda x: math.lgamma(x) if x > 0 or x != math.floor(x) else math.inf, otypes=[float])
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)


def gammainc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    with np.errstate(all="ignore"):
        head = np.exp(-x + a * np.log(np.where(x > 0, x, 1)) - lgamma(a))
        term = total = 1 / a
        for n in range(1, 3000):
            term = term * x / (a + n)
            total = total + term
            if not (np.abs(term) > 1e-17 * np.abs(total))[(x < a + 1)].any():
                break
        low = (x > 0) & (x < a + 1)
        out[low] = (head * total)[low]
        b = x + 1 - a
        c, d = np.full(a.shape, 1e300), 1 / b
        h = d.copy()
        for n in range(1, 3000):
            an = -n * (n - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
            if not (np.abs(d * c - 1) > 5e-16)[(x >= a + 1)].any():
                break
        high = x >= a + 1
        out[high] = (1 - head * h)[high]
    return np.clip(out, 0, 1)


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, on the side where that is fast."""
    a, b, x = (v.astype(float).copy() for v in np.broadcast_arrays(a, b, x))
    with np.errstate(all="ignore"):
        swap = x > (a + 1) / (a + b + 2)
        a2, b2, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        front = np.exp(lgamma(a2 + b2) - lgamma(a2) - lgamma(b2) + a2 * np.log(np.where(y > 0, y, 1)) + b2 * np.log1p(-np.where(y < 1, y, 0))) / a2
        c, d = np.ones(a.shape), 1 - (a2 + b2) * y / (a2 + 1)
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        h = d.copy()
        for m in range(1, 2000):
            for num in (m * (b2 - m) * y / ((a2 + 2 * m - 1) * (a2 + 2 * m)), -(a2 + m) * (a2 + b2 + m) * y / ((a2 + 2 * m) * (a2 + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                h = h * d * c
            if not (np.abs(d * c - 1) > 5e-16).any():
                break
        value = np.where(y <= 0, 0.0, front * h)
    return np.clip(np.where(swap, 1 - value, value), 0, 1)


def norm_cdf(z):
    return 0.5 * erfc(-np.asarray(z, float) / math.sqrt(2))


def t_cdf(x, v):
    x, v = np.broadcast_arrays(np.asarray(x, float), np.asarray(v, float))
    tail = 0.5 * betainc(v / 2, np.full(v.shape, 0.5), v / (v + x * x))
    return np.where(x > 0, 1 - tail, tail)


def f_cdf(x, a, b):
    x, a, b = (np.asarray(v, float) for v in (x, a, b))
    return np.where(x > 0, betainc(a / 2, b / 2, a * x / (a * x + b)), 0.0)


def quantile(cdf, p, low, high, steps: int = 200):
    """x with cdf(x) = p for an increasing cdf, by bisection from brackets that grow where they must."""
    p = np.asarray(p, float)
    a, b = np.broadcast_to(np.asarray(low, float), p.shape).copy(), np.broadcast_to(np.asarray(high, float), p.shape).copy()
    for _ in range(1100):
        need = np.isfinite(b) & (cdf(b) < p)
        if not need.any():
            break
        b = np.where(need, b * 2 + 1, b)
    for _ in range(1100):
        need = cdf(a) > p
        if not need.any():
            break
        a = np.where(need, a * 2 - 1, a)
    for _ in range(steps):
        m = (a + b) / 2
        if not ((m > a) & (m < b)).any():
            break
        up = cdf(m) < p
        a, b = np.where(up, m, a), np.where(up, b, m)
    return (a + b) / 2


def _angles(n: int = 400) -> np.ndarray:
    return (np.arange(n) + 0.5) * math.pi / n


def bessel_j(x, n):
    """Of whole orders, by the mean of a periodic integrand over equal angles."""
    t = _angles()
    return np.cos(n[:, None] * t - x[:, None] * np.sin(t)).mean(1)


def bessel_i(x, n):
    t = _angles()
    return (np.exp(x[:, None] * np.cos(t)) * np.cos(n[:, None] * t)).mean(1)


def bessel_k(x, n):
    """For positive x: the integrand falls doubly exponentially, so a plain sum over equal steps is exact to rounding."""
    high = np.arccosh(1 + (740 + 40 * n) / x)
    t = np.linspace(0, 1, 1201)
    u = high[:, None] * t
    f = np.exp(-x[:, None] * np.cosh(u) + n[:, None] * u) * (1 + np.exp(-2 * n[:, None] * u)) / 2
    return (f.sum(1) - (f[:, 0] + f[:, -1]) / 2) * high / 1200


def bessel_y(x, n):
    """For positive x."""
    t = (_NODES + 1) * math.pi / 2
    swing = (np.sin(x[:, None] * np.sin(t) - n[:, None] * t) * _WEIGHTS).sum(1) / 2
    high = np.arcsinh((60 + 12 * n) / x)
    u = high[:, None] * (_NODES + 1) / 2
    tail = np.exp(n[:, None] * u - x[:, None] * np.sinh(u)) * (1 + np.where(n % 2 == 0, 1.0, -1.0)[:, None] * np.exp(-2 * n[:, None] * u))
    return swing - (tail * _WEIGHTS).sum(1) * high / 2 / math.pi
