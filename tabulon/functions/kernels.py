"""Functions that Catalyst can't express: Arrow-batched kernels over numpy, and scalar code for dates and text.

A kernel sees whole batches; outside its domain it gives NaN, which becomes NULL.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabulon.functions import special as sp
from tabulon.functions.registry import add
from tabulon.functions.scalar import as_date, num

#: Batches of numbers.
_D = "double"


def _numeric(f: Callable) -> Callable:
    """A Column builder of f, a numpy function of as many arrays of doubles as it gets arguments."""

    def run(*columns: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            out = np.asarray(f(*(c.astype(float).to_numpy() for c in columns)), float)
        return pd.Series(np.where(np.isfinite(out), out, np.nan))

    return lambda *args: F.pandas_udf(run, _D)(*(num(a) for a in args))


def _each(f: Callable, kind: str) -> Callable:
    """A Column builder of f, a Python function of one row's values; errors of its domain and nulls give NULL."""

    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            try:
                value = None if any(v is None or (isinstance(v, float) and math.isnan(v)) for v in row) else f(*row)
                out.append(None if isinstance(value, (float, complex)) and not np.isfinite(value) else value)
            except (ValueError, ZeroDivisionError, OverflowError, ArithmeticError, IndexError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return lambda *args: F.pandas_udf(run, kind)(*args)


def _where(test, value):
    return np.where(test, value, np.nan)


def _opt(build: Callable, total: int, *last):
    """The builder of total arguments; last fills what a call leaves out at the end."""
    return lambda *args: build(*args, *(F.lit(v) for v in (last[len(last) - (total - len(args)) :] if len(args) < total else ())))


# ---- distributions
add("NORM.S.DIST", 2, 2, _numeric(lambda z, c: np.where(c != 0, sp.norm_cdf(z), np.exp(-z * z / 2) / math.sqrt(2 * math.pi))))
add("NORMSDIST", 1, 1, _numeric(sp.norm_cdf))
add("NORM.DIST NORMDIST", 4, 4, _numeric(lambda x, m, s, c: _where(s > 0, np.where(c != 0, sp.norm_cdf((x - m) / s), np.exp(-(((x - m) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi))))))
add("GAUSS", 1, 1, _numeric(lambda z: 0.5 * sp.erf(z / math.sqrt(2))))
add("ERF", 1, 2, lambda a, b=None: _numeric(sp.erf)(a) if b is None else _numeric(lambda x, y: sp.erf(y) - sp.erf(x))(a, b))
add("ERF.PRECISE", 1, 1, _numeric(sp.erf))
add("ERFC ERFC.PRECISE", 1, 1, _numeric(sp.erfc))
add("GAMMA", 1, 1, _each(math.gamma, _D))
add("GAMMALN GAMMALN.PRECISE", 1, 1, _numeric(lambda x: _where(x > 0, sp.lgamma(np.where(x > 0, x, 1)))))
add("GAMMA.DIST GAMMADIST", 4, 4, _numeric(lambda x, a, b, c: _where((x >= 0) & (a > 0) & (b > 0), np.where(c != 0, sp.gammainc(a, x / b), np.exp((a - 1) * np.log(x) - x / b - sp.lgamma(a) - a * np.log(b))))))
add("GAMMA.INV GAMMAINV", 3, 3, _numeric(lambda p, a, b: _where((p >= 0) & (p < 1) & (a > 0) & (b > 0), b * sp.quantile(lambda x: sp.gammainc(a, np.maximum(x, 0)), np.where((p >= 0) & (p < 1), p, 0.5), 0.0, 1.0))))


def _beta_dist(x, a, b, c, lo, hi):
    y = (x - lo) / (hi - lo)
    good = (a > 0) & (b > 0) & (lo < hi) & (y >= 0) & (y <= 1)
    pdf = np.exp((a - 1) * np.log(y) + (b - 1) * np.log1p(-y) + sp.lgamma(a + b) - sp.lgamma(a) - sp.lgamma(b)) / (hi - lo)
    return _where(good, np.where(c != 0, sp.betainc(a, b, np.clip(y, 0, 1)), pdf))


def _beta_inv(p, a, b, lo, hi):
    good = (p > 0) & (p <= 1) & (a > 0) & (b > 0) & (lo < hi)
    q = np.where(good, p, 0.5)
    x, y = np.zeros(len(q)), np.ones(len(q))
    for _ in range(60):
        m = (x + y) / 2
        up = sp.betainc(a, b, m) < q
        x, y = np.where(up, m, x), np.where(up, y, m)
    return _where(good, np.where(p == 1, hi, lo + (hi - lo) * (x + y) / 2))


add("BETA.DIST", 4, 6, _opt(_numeric(_beta_dist), 6, 0.0, 1.0))
add("BETADIST", 3, 5, _opt(_numeric(lambda x, a, b, lo, hi: _beta_dist(x, a, b, np.ones(len(x)), lo, hi)), 5, 0.0, 1.0))
add("BETA.INV BETAINV", 3, 5, _opt(_numeric(_beta_inv), 5, 0.0, 1.0))
_df = np.floor
add("F.DIST", 4, 4, _numeric(lambda x, a, b, c: _where((x >= 0) & (a >= 1) & (b >= 1), np.where(c != 0, sp.f_cdf(x, _df(a), _df(b)), np.exp(sp.lgamma((_df(a) + _df(b)) / 2) - sp.lgamma(_df(a) / 2) - sp.lgamma(_df(b) / 2) + _df(a) / 2 * np.log(_df(a) / _df(b)) + (_df(a) / 2 - 1) * np.log(x) - (_df(a) + _df(b)) / 2 * np.log1p(_df(a) * x / _df(b)))))))
add("F.DIST.RT FDIST", 3, 3, _numeric(lambda x, a, b: _where((x >= 0) & (a >= 1) & (b >= 1), sp.betainc(_df(b) / 2, _df(a) / 2, _df(b) / (_df(b) + _df(a) * x)))))
add("F.INV", 3, 3, _numeric(lambda p, a, b: _where((p >= 0) & (p < 1) & (a >= 1) & (b >= 1), sp.quantile(lambda x: sp.f_cdf(x, _df(a), _df(b)), np.where((p >= 0) & (p < 1), p, 0.5), 0.0, 1.0))))
add("F.INV.RT FINV", 3, 3, _numeric(lambda p, a, b: _where((p > 0) & (p <= 1) & (a >= 1) & (b >= 1), sp.quantile(lambda x: sp.f_cdf(x, _df(a), _df(b)), np.where((p > 0) & (p <= 1), 1 - p, 0.5), 0.0, 1.0))))
add("T.DIST", 3, 3, _numeric(lambda x, v, c: _where(v >= 1, np.where(c != 0, sp.t_cdf(x, _df(v)), np.exp(sp.lgamma((_df(v) + 1) / 2) - sp.lgamma(_df(v) / 2)) / np.sqrt(_df(v) * math.pi) * (1 + x * x / _df(v)) ** (-(_df(v) + 1) / 2)))))
add("T.DIST.RT", 2, 2, _numeric(lambda x, v: _where(v >= 1, sp.t_cdf(-x, _df(v)))))
add("T.DIST.2T", 2, 2, _numeric(lambda x, v: _where((v >= 1) & (x >= 0), 2 * sp.t_cdf(-x, _df(v)))))
add("TDIST", 3, 3, _numeric(lambda x, v, k: _where((v >= 1) & (x >= 0) & ((np.floor(k) == 1) | (np.floor(k) == 2)), np.floor(k) * sp.t_cdf(-x, _df(v)))))
add("T.INV", 2, 2, _numeric(lambda p, v: _where((p > 0) & (p < 1) & (v >= 1), sp.quantile(lambda x: sp.t_cdf(x, _df(v)), np.where((p > 0) & (p < 1), p, 0.5), -1.0, 1.0))))
add("T.INV.2T TINV", 2, 2, _numeric(lambda p, v: _where((p > 0) & (p <= 1) & (v >= 1), -sp.quantile(lambda x: sp.t_cdf(x, _df(v)), np.where((p > 0) & (p <= 1), p / 2, 0.5), -1.0, 1.0))))


def _binom_cdf(k, n, p):
    return np.where(k < 0, 0.0, np.where(k >= n, 1.0, sp.betainc(np.maximum(n - k, 1e-9), k + 1, 1 - p)))


def _binom_pmf(k, n, p):
    logs = sp.lgamma(n + 1) - sp.lgamma(k + 1) - sp.lgamma(n - k + 1)
    return np.where(p == 0, (k == 0) * 1.0, np.where(p == 1, (k == n) * 1.0, np.exp(logs + k * np.log(p) + (n - k) * np.log1p(-p))))


def _binom_inv(n, p, alpha):
    n = int(n)
    if not (n >= 0 and 0 < p < 1 and 0 < alpha < 1):
        return None
    low, high = 0, n
    while low < high:
        m = (low + high) // 2
        if _binom_cdf(np.array([float(m)]), np.array([float(n)]), np.array([p]))[0] >= alpha * (1 - 1e-14):
            high = m
        else:
            low = m + 1
    return float(low)


def _hypergeom(k, n, m, total, cumulative):
    k, n, m, total = (int(x) for x in (k, n, m, total))
    if not (0 <= n <= total and 0 <= m <= total and k >= 0 and max(0, n + m - total) <= k <= min(n, m)):
        return None
    low = max(0, n + m - total) if cumulative else k
    return sum(math.exp(math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) + math.lgamma(total - m + 1) - math.lgamma(n - i + 1) - math.lgamma(total - m - n + i + 1) - math.lgamma(total + 1) + math.lgamma(n + 1) + math.lgamma(total - n + 1)) for i in range(low, k + 1))


_t = np.trunc
add("BINOM.DIST BINOMDIST", 4, 4, _numeric(lambda k, n, p, c: _where((_t(k) >= 0) & (_t(k) <= _t(n)) & (p >= 0) & (p <= 1), np.where(c != 0, _binom_cdf(_t(k), _t(n), p), _binom_pmf(_t(k), _t(n), p)))))
add("BINOM.DIST.RANGE", 3, 4, lambda n, p, a, b=None: _numeric(lambda n, p, a, b: _where((p >= 0) & (p <= 1) & (_t(a) >= 0) & (_t(a) <= _t(b)) & (_t(b) <= _t(n)), np.where(_t(a) == _t(b), _binom_pmf(_t(a), _t(n), p), _binom_cdf(_t(b), _t(n), p) - _binom_cdf(_t(a) - 1, _t(n), p))))(n, p, a, a if b is None else b))
add("BINOM.INV CRITBINOM", 3, 3, _each(_binom_inv, _D))
add("HYPGEOM.DIST", 5, 5, _each(_hypergeom, _D))
add("HYPGEOMDIST", 4, 4, lambda *a: _each(_hypergeom, _D)(*a, F.lit(0)))
_neg = lambda f, s, p, c: _where((_t(f) >= 0) & (_t(s) >= 1) & (p > 0) & (p < 1), np.where(c != 0, sp.betainc(_t(s), _t(f) + 1, p), np.exp(sp.lgamma(_t(f) + _t(s)) - sp.lgamma(_t(f) + 1) - sp.lgamma(_t(s)) + _t(s) * np.log(p) + _t(f) * np.log1p(-p))))
add("NEGBINOM.DIST", 4, 4, _numeric(_neg))
add("NEGBINOMDIST", 3, 3, _numeric(lambda f, s, p: _neg(f, s, p, np.zeros(len(f)))))
add("POISSON.DIST POISSON", 3, 3, _numeric(lambda x, m, c: _where((_t(x) >= 0) & (m >= 0), np.where(c != 0, 1 - sp.gammainc(_t(x) + 1, m), np.where(m == 0, (_t(x) == 0) * 1.0, np.exp(_t(x) * np.log(m) - m - sp.lgamma(_t(x) + 1)))))))
for n, f in {"BESSELJ": sp.bessel_j, "BESSELI": sp.bessel_i}.items():
    add(n, 2, 2, _numeric(lambda x, k, f=f: _where(_t(k) >= 0, f(x, _t(k)))))
for n, f in {"BESSELK": sp.bessel_k, "BESSELY": sp.bessel_y}.items():
    add(n, 2, 2, _numeric(lambda x, k, f=f: _where((_t(k) >= 0) & (x > 0), f(np.where(x > 0, x, 1.0), _t(k)))))

# ---- combinatorics
add("FACT", 1, 1, _each(lambda x: float(math.factorial(int(x))) if 0 <= x < 171 else None, _D))
add("COMBIN", 2, 2, _each(lambda n, k: float(math.comb(int(n), int(k))) if n >= 0 and 0 <= k and int(n) >= int(k) else None, _D))
add("COMBINA", 2, 2, _each(lambda n, k: (1.0 if int(k) == 0 else float(math.comb(int(n) + int(k) - 1, int(k)))) if n >= 0 and k >= 0 and (int(n) > 0 or int(k) == 0) else None, _D))
add("GCD", 1, 255, _each(lambda *x: float(math.gcd(*map(int, x))) if min(x) >= 0 else None, _D))
add("LCM", 1, 255, _each(lambda *x: float(math.lcm(*map(int, x))) if min(x) >= 0 else None, _D))
add("MULTINOMIAL", 1, 255, _each(lambda *x: float(math.factorial(sum(map(int, x))) // math.prod(math.factorial(int(v)) for v in x)) if min(x) >= 0 else None, _D))

# ---- complex numbers
_PARTS = re.compile(r"^([+-]?\d*\.?\d+(?:[eE][+-]?\d+)?)?(?:([+-]?(?:\d*\.?\d+(?:[eE][+-]?\d+)?)?)([ij]))?$")


def parse_complex(text) -> tuple[complex, str]:
    """The value and suffix of a number or of a text like `3-4i`."""
    if not isinstance(text, str):
        return complex(float(text)), ""
    m = _PARTS.match(text)
    if text in ("i", "j"):
        return 1j, text
    if not text or not m:
        raise ValueError(text)
    re_, im, suffix = m.groups()
    if suffix and im == "" and re_ is not None:  # `4i`: the number is the coefficient
        re_, im = None, re_
    return complex(float(re_ or 0), {None: 0.0, "": 1.0, "+": 1.0, "-": -1.0}.get(im, 0.0) if im in (None, "", "+", "-") else float(im)), suffix or ""


def _g(x: float) -> str:
    return "0" if x == 0 else f"{x:.15g}".replace("e+", "E+").replace("e-", "E-")


def complex_text(z: complex, suffix: str = "") -> str:
    suffix = suffix or "i"
    if z.imag == 0:
        return _g(z.real)
    im = {1.0: "", -1.0: "-"}.get(z.imag, _g(z.imag)) + suffix
    return im if z.real == 0 else _g(z.real) + ("" if im.startswith("-") else "+") + im


def _complex(f):
    def run(*texts):
        parts = [parse_complex(t) for t in texts]
        kinds = {s for _, s in parts if s}
        if len(kinds) > 1:
            return None
        z = f(*(v for v, _ in parts))
        return complex_text(z, next(iter(kinds), ""))

    build = _each(run, "string")
    return lambda *args: build(*(a.cast("string") for a in args))


def _power(text, n):
    z, s = parse_complex(text)
    if z == 0:
        return None if n <= 0 else "0"
    return complex_text(abs(z) ** n * complex(math.cos(n * math.atan2(z.imag, z.real)), math.sin(n * math.atan2(z.imag, z.real))), s)


def _im_exp(z):
    return math.exp(z.real) * complex(math.cos(z.imag), math.sin(z.imag))


add("COMPLEX", 2, 3, _opt(_each(lambda a, b, s: complex_text(complex(float(a), float(b)), s) if s in ("i", "j") else None, "string"), 3, "i"))
add("IMCONJUGATE", 1, 1, _complex(lambda z: z.conjugate()))
add("IMSUM", 1, 255, _complex(lambda *z: sum(z, 0j)))
add("IMSUB", 2, 2, _complex(lambda a, b: a - b))
add("IMPRODUCT", 1, 255, _complex(lambda *z: math.prod(z, start=1 + 0j)))
add("IMDIV", 2, 2, _complex(lambda a, b: a / b))
add("IMEXP", 1, 1, _complex(_im_exp))
add("IMLN", 1, 1, _complex(lambda z: complex(math.log(abs(z)), math.atan2(z.imag, z.real))))
add("IMSQRT", 1, 1, _complex(lambda z: math.sqrt(abs(z)) * complex(math.cos(math.atan2(z.imag, z.real) / 2), math.sin(math.atan2(z.imag, z.real) / 2))))
add("IMPOWER", 2, 2, lambda z, n: _each(_power, "string")(z.cast("string"), num(n)))

# ---- text
_ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
# Shorter pairs that forms 1 to 4 add.
_SHORT = {1: ((450, "LM"), (950, "LM"), (45, "VL"), (95, "VC")), 2: ((490, "XD"), (990, "XM"), (49, "IL"), (99, "IC")), 3: ((495, "VD"), (995, "VM")), 4: ((499, "ID"), (999, "IM"))}


def roman(n, form=0):
    n, form = int(n), int(form)
    if not (0 <= n <= 3999 and 0 <= form <= 4):
        return None
    table = dict(_ROMAN)
    for k in range(1, form + 1):
        for value, text in _SHORT[k]:
            table[value] = "LD" if value == 450 else text
    out = ""
    for value in sorted(table, reverse=True):
        while n >= value:
            out, n = out + table[value], n - value
    return out


def arabic(text):
    values = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    t = text.strip().upper()
    sign, t = (-1.0, t[1:]) if t.startswith("-") else (1.0, t)
    if len(t) > 255 or any(c not in values for c in t):
        return None
    v = [values[c] for c in t]
    return sign * sum(-x if any(y > x for y in v[i + 1 : i + 2]) else x for i, x in enumerate(v))


def proper(text):
    return "".join(c.upper() if not i or not text[i - 1].isalpha() and not text[i - 1].isdigit() else c.lower() for i, c in enumerate(text))


def text_format(x, code):
    """Number formats of 0 # , . % and literals in front and behind."""
    m = re.fullmatch(r'((?:"[^"]*"|[^0#.,%"])*)([0#,]*)(?:\.([0#]*))?(%*)((?:"[^"]*"|[^0#.,%"])*)', code)
    if not m or not (m[2] or m[3] is not None):
        return None
    head, whole, part, percent, tail = m[1].replace('"', ""), m[2], m[3] or "", m[4], m[5].replace('"', "")
    x = float(x) * 100 ** len(percent)
    thousand = len(whole) - len(whole.rstrip(","))
    x /= 1000**thousand
    whole = whole.rstrip(",")
    scaled = math.floor(abs(x) * 10 ** len(part) + 0.5)
    digits = f"{scaled:0{len(part) + 1}d}"
    a, b = (digits[: -len(part)], digits[-len(part) :]) if part else (digits, "")
    while b and part[len(b) - 1] == "#" and b[-1] == "0":
        b = b[:-1]
    least = whole.replace(",", "").count("0")
    a = a.lstrip("0").rjust(least, "0")
    if "," in whole:
        a = re.sub(r"(?<=\d)(?=(\d{3})+$)", ",", a)
    return ("-" if x < 0 and scaled else "") + head + a + ("." + b if b or (m[3] is not None and part == "") else "") + percent + tail


add("ROMAN", 1, 2, _opt(_each(roman, "string"), 2, 0))
add("ARABIC", 1, 1, _each(arabic, _D))
add("PROPER", 1, 1, _each(proper, "string"))
add("TEXT", 2, 2, lambda v, c: _each(text_format, "string")(num(v), c))
add("CHAR", 1, 1, _each(lambda n: bytes([int(n)]).decode("cp1252", "replace") if 1 <= int(n) <= 255 else None, "string"))
add("UNICHAR", 1, 1, _each(lambda n: chr(int(n)) if 1 <= n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else None, "string"))


def _replace_nth(text, pattern, new, nth, fold):
    import regex

    p = regex.compile(pattern, regex.IGNORECASE if fold else 0)
    new = regex.sub(r"\$(\d+)", r"\\g<\1>", new.replace("\\", "\\\\"))
    if int(nth) == 0:
        return p.sub(new, text)
    found = list(p.finditer(text))
    k = int(nth) - 1 if nth > 0 else len(found) + int(nth)
    return text if not 0 <= k < len(found) else text[: found[k].start()] + found[k].expand(new) + text[found[k].end() :]


add("REGEXREPLACE", 3, 5, _opt(_each(_replace_nth, "string"), 5, 0, 0))

# ---- working days
_DAY0 = dt.date(1899, 12, 30)


def _serial(d: dt.date) -> float:
    return float((d - _DAY0).days)


def _workday(start, n, mask, holidays):
    n, off = int(n), {h for h in holidays if h is not None}
    if mask == "1111111":
        return None
    step, d, week = (1 if n > 0 else -1), start, 7 - mask.count("1")
    near = sorted(off)
    whole = max(0, abs(n) // week - len(near) - 1)  # full weeks can't jump over more holidays than there are
    if whole:
        end = d + dt.timedelta(days=7 * whole * step)
        low, high = min(d + dt.timedelta(days=step), end), max(d + dt.timedelta(days=step), end)
        n -= step * (whole * week - sum(low <= h <= high and mask[h.weekday()] == "0" for h in near))
        d = end
    while n:
        d += dt.timedelta(days=step)
        if mask[d.weekday()] == "0" and d not in off:
            n -= step
    return _serial(d)


def _workdays(s, n, code=None, holidays=None):
    from tabulon.functions.scalar import weekend_mask

    mask = weekend_mask(F.lit("1") if code is None else code)
    return _each(_workday, _D)(as_date(s), num(n), mask, F.array().cast("array<date>") if holidays is None else holidays.cast("array<date>"))


add("WORKDAY", 2, 3, lambda s, n, h=None: _workdays(s, n, None, h))
add("WORKDAY.INTL", 2, 4, _workdays)


# ---- solvers
def _newton(f, guess, steps=60, tolerance=1e-12):
    x = float(guess)
    for _ in range(steps):
        h = 1e-6 * max(1.0, abs(x))
        y = f(x)
        slope = (f(x + h) - f(x - h)) / (2 * h)
        if slope == 0:
            return None
        new = x - y / slope
        if new <= -1:
            new = (x - 1) / 2
        if abs(new - x) <= tolerance * max(1.0, abs(new)):
            return new
        x = new
    return None


def irr(values, guess=0.1):
    v = [float(x) for x in values if x is not None]
    if not (any(x > 0 for x in v) and any(x < 0 for x in v)):
        return None
    return _newton(lambda r: sum(x / (1 + r) ** i for i, x in enumerate(v)), guess)


def xirr(values, dates, guess=0.1):
    v = [float(x) for x in values]
    if len(v) != len(dates) or not (any(x > 0 for x in v) and any(x < 0 for x in v)) or min(dates) < dates[0]:
        return None
    t = [(d - dates[0]).days / 365 for d in dates]
    return _newton(lambda r: sum(x / (1 + r) ** k for x, k in zip(v, t, strict=True)), guess)


def mirr(values, finance, reinvest):
    v = [float(x) for x in values if x is not None]
    n = len(v)
    bad = -sum(x / (1 + finance) ** i for i, x in enumerate(v) if x < 0)
    good = sum(x * (1 + reinvest) ** (n - 1 - i) for i, x in enumerate(v) if x > 0)
    return (good / bad) ** (1 / (n - 1)) - 1 if bad and good else None


def _rate(n, pmt, pv, fv, kind, guess):
    def f(r):
        if abs(r) < 1e-12:
            return pv + pmt * n + fv
        g = (1 + r) ** n
        return pv * g + pmt * (1 + r * (kind != 0)) * (g - 1) / r + fv

    return _newton(f, guess)


add("IRR", 1, 2, _opt(_each(irr, _D), 2, 0.1))
add("XIRR", 2, 3, lambda v, d, g=None: _each(xirr, _D)(v, F.transform(d, as_date), F.lit(0.1) if g is None else g))
add("MIRR", 3, 3, _each(mirr, _D))
add("RATE", 3, 6, _opt(lambda *a: _each(_rate, _D)(*map(num, a)), 6, 0.0, 0, 0.1))
add("NPV", 2, 255, lambda r, *v: _npv(r, v))


def _npv(r, values):
    total, growth = F.lit(0.0), F.lit(1.0)
    for v in values:
        growth = growth * (1 + num(r))
        total = total + num(v) / growth
    return F.when(num(r) != -1, total)


# ---- units: fixed values, factors to the first unit of each kind
UNITS = {
    "mass": {"g": 1.0, "sg": 14593.9029372064, "lbm": 453.59237, "u": 1.66053906660e-24, "ozm": 28.349523125, "grain": 0.06479891, "cwt": 45359.237, "uk_cwt": 50802.34544, "stone": 6350.29318, "ton": 907184.74, "uk_ton": 1016046.9088},
    "length": {"m": 1.0, "mi": 1609.344, "Nmi": 1852.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "ang": 1e-10, "ell": 1.143, "ly": 9460730472580800.0, "parsec": 3.0856775814913673e16, "pc": 3.0856775814913673e16, "Pica": 0.0254 / 72, "pica": 0.0254 / 6, "survey_mi": 6336000 / 3937},
    "time": {"sec": 1.0, "s": 1.0, "yr": 31557600.0, "day": 86400.0, "d": 86400.0, "hr": 3600.0, "mn": 60.0, "min": 60.0},
    "pressure": {"Pa": 1.0, "p": 1.0, "atm": 101325.0, "at": 101325.0, "mmHg": 133.322, "psi": 6894.757293168361, "Torr": 101325 / 760},
    "force": {"N": 1.0, "dyn": 1e-5, "dy": 1e-5, "lbf": 4.4482216152605, "pond": 0.00980665},
    "energy": {"J": 1.0, "e": 1e-7, "c": 4.184, "cal": 4.1868, "eV": 1.602176634e-19, "ev": 1.602176634e-19, "HPh": 2684519.537696173, "hh": 2684519.537696173, "Wh": 3600.0, "wh": 3600.0, "flb": 1.3558179483314004, "BTU": 1055.05585262, "btu": 1055.05585262},
    "power": {"W": 1.0, "w": 1.0, "HP": 745.6998715822702, "h": 745.6998715822702, "PS": 735.49875},
    "magnetism": {"T": 1.0, "ga": 1e-4},
    "volume": {"l": 1.0, "L": 1.0, "lt": 1.0, "tsp": 0.00492892159375, "tbs": 0.01478676478125, "oz": 0.0295735295625, "cup": 0.2365882365, "pt": 0.473176473, "us_pt": 0.473176473, "uk_pt": 0.56826125, "qt": 0.946352946, "uk_qt": 1.1365225, "gal": 3.785411784, "uk_gal": 4.54609, "barrel": 158.987294928, "bushel": 35.23907016688, "m3": 1000.0, "ft3": 28.316846592, "in3": 0.016387064, "yd3": 764.554857984},
    "area": {"m2": 1.0, "ha": 10000.0, "ar": 100.0, "uk_acre": 4046.8564224, "us_acre": 4046.872609874252, "ft2": 0.09290304, "in2": 0.00064516, "yd2": 0.83612736, "mi2": 2589988.110336, "Morgen": 2500.0},
    "information": {"bit": 1.0, "byte": 8.0},
    "speed": {"m/s": 1.0, "m/sec": 1.0, "m/h": 1 / 3600, "m/hr": 1 / 3600, "mph": 0.44704, "kn": 1852 / 3600, "admkn": 0.514773333333333},
}
PREFIXES = {"Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 1e1, "e": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24, "ki": 2.0**10, "Mi": 2.0**20, "Gi": 2.0**30, "Ti": 2.0**40, "Pi": 2.0**50}
PREFIXABLE = {"g", "u", "m", "ang", "ly", "parsec", "pc", "sec", "s", "Pa", "p", "atm", "at", "mmHg", "N", "dyn", "dy", "pond", "J", "e", "c", "cal", "eV", "ev", "Wh", "wh", "W", "w", "T", "ga", "l", "L", "lt", "m3", "m2", "ar", "bit", "byte", "m/s", "m/sec", "m/h", "m/hr"}
_HEAT = {"C": (1.0, 273.15), "cel": (1.0, 273.15), "F": (5 / 9, 459.67 * 5 / 9), "fah": (5 / 9, 459.67 * 5 / 9), "K": (1.0, 0.0), "kel": (1.0, 0.0), "Rank": (5 / 9, 0.0), "Reau": (1.25, 273.15)}


def unit(token: str) -> tuple[str, float]:
    for kind, table in UNITS.items():
        if token in table:
            return kind, table[token]
    for prefix, scale in sorted(PREFIXES.items(), key=lambda p: -len(p[0])):
        rest = token.removeprefix(prefix)
        if rest != token and rest in PREFIXABLE and (not prefix.endswith("i") or rest in ("bit", "byte")):
            for kind, table in UNITS.items():
                if rest in table:
                    return kind, table[rest] * scale ** (2 if rest == "m2" else 3 if rest == "m3" else 1)
    raise ValueError(token)


def convert(x, a, b):
    if a in _HEAT and b in _HEAT:
        (fa, oa), (fb, ob) = _HEAT[a], _HEAT[b]
        return float(x) if a == b else (x * fa + oa - ob) / fb
    (ka, fa), (kb, fb) = unit(a), unit(b)
    return x * fa / fb if ka == kb else None


add("CONVERT", 3, 3, lambda x, a, b: _each(convert, _D)(num(x), a, b))
