"""Bonds with coupons: numpy kernels over batches of dates, as days since 1970, and numbers.

What is outside a function's domain is NaN, which becomes NULL.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tabulon.functions.kernels import _numeric, _opt
from tabulon.functions.registry import add
from tabulon.functions.scalar import as_date, num

_EPOCH = 25569.0  # the serial number of 1970-01-01


def _months(days):
    """Months since 1970-01."""
    return days.astype("M8[D]").astype("M8[M]").astype(np.int64)


def _month_start(months):
    return months.astype("M8[M]").astype("M8[D]").astype(np.int64)


def _day(days):
    return days - _month_start(_months(days)) + 1


def _month_end(days):
    return _months(days + 1) != _months(days)


def add_months(days, n, end):
    """The same day n months on, or the month's last one where it has no such day or end holds."""
    months = _months(days) + n
    first, after = _month_start(months), _month_start(months + 1)
    return np.where(end, after - 1, np.minimum(first + _day(days), after) - 1)


def day_count(a, b, basis):
    d1, d2 = _day(a), _day(b)
    feb = (_months(a) % 12 == 1) & _month_end(a)
    u2 = np.where(feb & (_months(b) % 12 == 1) & _month_end(b), 30, d2)
    u1 = np.where(feb | (d1 == 31), 30, d1)
    u2 = np.where((u2 == 31) & (u1 == 30), 30, u2)
    european = basis == 4
    days = np.where(european, np.minimum(d2, 30) - np.minimum(d1, 30), u2 - u1)
    return np.where((basis == 0) | european, (_months(b) - _months(a)) * 30 + days, b - a).astype(float)


def _period(low, high, freq, basis):
    """Days of the coupon period from low to high."""
    return np.where((basis == 0) | (basis == 2) | (basis == 4), 360 / freq, np.where(basis == 3, 365 / freq, high - low))


class Coupons:
    """The coupon periods around settlements; good where there are such bonds."""

    def __init__(self, settlement, maturity, freq, basis):
        f, b = np.trunc(freq), np.trunc(basis)
        self.good = np.isin(f, (1, 2, 4)) & (b >= 0) & (b <= 4) & (settlement < maturity)
        f = np.where(self.good, f, 1)
        step, end = (12 // f).astype(np.int64), _month_end(maturity)
        n = np.maximum((_months(maturity) - _months(settlement)) // step, 1)  # one too few where that month's coupon is after settlement
        n = n + (add_months(maturity, -n * step, end) > settlement)
        self.s, self.f, self.b, self.n = settlement, f, b, n
        self.previous, self.next = add_months(maturity, -n * step, end), add_months(maturity, (1 - n) * step, end)
        self.days = _period(self.previous, self.next, f, b)
        self.accrued = day_count(self.previous, settlement, b)
        self.ahead = np.where((b == 0) | (b == 4), self.days - self.accrued, self.next - settlement)


class Flows:
    """Payments in periods from settlement: last at its time, one of odd at first, n equal ones of pay from start on."""

    def __init__(self, last, end, odd, first, pay, start, n):
        self.parts = last, end, odd, first, pay, start, n

    def value(self, force):
        """Their present value at a force of interest, the logarithm of 1 + the yield of a period."""
        last, end, odd, first, pay, start, n = self.parts
        flat = np.abs(force) < 1e-12
        annuity = np.where(flat, n, np.expm1(-n * force) / np.expm1(-np.where(flat, 1.0, force)))
        return last * np.exp(-end * force) + odd * np.exp(-first * force) + pay * np.exp(-start * force) * annuity

    def force(self, target, guess, steps: int = 100):
        """The force of interest at which they are worth target, by secants of the value's logarithm, which is convex and
        almost a line; NaN where there is none. Rows that are done leave the batch."""
        x = np.full(len(target), np.nan)
        rows = np.flatnonzero(np.isfinite(target) & (target > 0) & np.isfinite(guess))
        parts, goal, b = tuple(p[rows] for p in self.parts), np.log(target[rows]), guess[rows]
        a = b - 0.01
        fa = np.log(Flows(*parts).value(a)) - goal
        for _ in range(steps):
            if not len(rows):
                break
            fb = np.log(Flows(*parts).value(b)) - goal
            step = np.where(fb == fa, 0.0, -fb * (b - a) / np.where(fb == fa, 1.0, fb - fa))
            c = b + step
            done = np.abs(step) <= 1e-12 * np.maximum(np.abs(b), 1e-2)  # the next step would be below rounding
            x[rows[done]] = c[done]
            keep = ~done & np.isfinite(c)
            rows, parts, goal, a, fa, b = rows[keep], tuple(p[keep] for p in parts), goal[keep], b[keep], fb[keep], c[keep]
        x[rows] = b  # steps no larger than the value's rounding
        return x


def _regular(c: Coupons, rate, redemption):
    """Flows of a regular bond and the accrued interest."""
    k, pay, zero = c.ahead / c.days, 100 * rate / c.f, np.zeros(len(rate))
    return Flows(redemption, c.n - 1 + k, zero, zero, pay, k, c.n.astype(float)), pay * c.accrued / c.days


def _yielded(flows: Flows, target, rate, freq):
    """The yearly yield from which the flows have a value; none below -0.99."""
    y = freq * np.expm1(flows.force(target, np.log1p(np.clip(rate, 0, 10) / freq)))
    return np.where((y >= -0.99) & (y <= 8.0**10), y, np.nan)


def price(s, m, rate, yld, redemption, freq, basis):
    c = Coupons(s, m, freq, basis)
    flows, less = _regular(c, rate, redemption)
    one = (redemption + 100 * rate / c.f) / (1 + c.ahead / c.days * yld / c.f)
    return np.where(c.good & (rate >= 0) & (redemption > 0), np.where(c.n == 1, one, flows.value(np.log1p(yld / c.f))) - less, np.nan)


def bond_yield(s, m, rate, pr, redemption, freq, basis):
    c = Coupons(s, m, freq, basis)
    good = c.good & (rate >= 0) & (pr > 0) & (redemption > 0)
    flows, less = _regular(c, rate, redemption)
    paid, pay = (pr + less) / 100, rate / c.f
    one = (redemption / 100 + pay - paid) / paid * c.f * c.days / c.ahead
    return np.where(good, np.where(c.n == 1, one, _yielded(flows, np.where(good & (c.n > 1), pr + less, np.nan), rate, c.f)), np.nan)


def duration(s, m, coupon, yld, freq, basis):
    c = Coupons(s, m, freq, basis)
    good = c.good & (coupon >= 0) & (yld >= 0)
    k, pay, force, n = c.ahead / c.days, 100 * coupon / c.f, np.log1p(yld / c.f), np.where(good, c.n, 1)
    last = 100 * np.exp(-(n - 1 + k) * force)
    worth, timed, rows, i = last, (n - 1 + k) * last, np.arange(len(n)), 0
    while len(rows):
        flow = pay[rows] * np.exp(-(i + k[rows]) * force[rows])
        worth[rows], timed[rows] = worth[rows] + flow, timed[rows] + (i + k[rows]) * flow
        i += 1
        rows = rows[n[rows] > i]
    return np.where(good, timed / worth / c.f, np.nan)


def _share(a, b, period, basis):
    """Days from a to b as a share of a period's."""
    return np.where(b > a, np.maximum(day_count(a, b, basis), 0.0) / period, 0.0)


def _odd_periods(start, ends, first, freq, basis, end_of_month):
    """For each of ends, the quasi-coupon periods from start to it, counted back from first, of those beyond start."""
    out, step = [np.zeros(len(start)) for _ in ends], (12 // freq).astype(np.int64)
    rows, high, k = np.flatnonzero(first > start), first, 0
    while len(rows):
        k += 1
        top, f, b = high[rows], freq[rows], basis[rows]
        low = add_months(first[rows], -k * step[rows], end_of_month[rows])
        for total, end in zip(out, ends, strict=True):
            total[rows] += _share(np.maximum(low, start[rows]), np.minimum(top, end[rows]), _period(low, top, f, b), b)
        high = high.copy()
        high[rows] = low
        rows = rows[low > start[rows]]
    return out


def _frequency(freq):
    """Whole frequencies, with whether they are some; 1 where they aren't."""
    f = np.trunc(freq)
    good = np.isin(f, (1, 2, 4))
    return np.where(good, f, 1.0), good


def _odd_first(s, m, issue, first, rate, redemption, freq, basis):
    """Flows of bonds with an odd first period, the accrued interest, the frequency, and which are such bonds."""
    (f, good), basis, eom = _frequency(freq), np.trunc(basis), _month_end(m)
    good = good & (issue < s) & (s < first) & (first < m)
    start = np.where(good, issue, first)  # no periods of what isn't such a bond
    n = np.round((_months(m) - _months(first)) / (12 // f))
    full, past = _odd_periods(start, (first, s), first, f, basis, eom)
    ahead, pay = full - past, 100 * rate / f
    return Flows(redemption, n + ahead, pay * full, ahead, pay, 1 + ahead, n), pay * past, f, good


def odd_first_price(s, m, issue, first, rate, yld, redemption, freq, basis):
    flows, less, f, good = _odd_first(s, m, issue, first, rate, redemption, freq, basis)
    return np.where(good, flows.value(np.log1p(yld / f)) - less, np.nan)


def odd_first_yield(s, m, issue, first, rate, pr, redemption, freq, basis):
    flows, less, f, good = _odd_first(s, m, issue, first, rate, redemption, freq, basis)
    return _yielded(flows, np.where(good, pr + less, np.nan), rate, f)


def _odd_last(s, m, last, freq, basis):
    """Coupon periods from the last interest: all, up to settlement, from settlement; the frequency; which are such bonds."""
    (f, good), basis, eom = _frequency(freq), np.trunc(basis), _month_end(last)
    good = good & (last < s) & (s < m)
    step, low, k, out, rows = (12 // f).astype(np.int64), last, 0, [np.zeros(len(s)) for _ in range(3)], np.flatnonzero(good)
    while len(rows):
        k += 1
        a, t, e, b = low[rows], s[rows], m[rows], basis[rows]
        high = add_months(last[rows], k * step[rows], eom[rows])
        period = _period(a, high, f[rows], b)
        for total, x, y in zip(out, (a, a, np.maximum(a, t)), (np.minimum(high, e), np.minimum(high, t), np.minimum(high, e)), strict=True):
            total[rows] += _share(x, y, period, b)
        low = low.copy()
        low[rows] = high
        rows = rows[high < e]
    return *out, f, good


def odd_last_price(s, m, last, rate, yld, redemption, freq, basis):
    total, past, ahead, f, good = _odd_last(s, m, last, freq, basis)
    pay = 100 * rate / f
    return np.where(good, (redemption + total * pay) / (1 + ahead * yld / f) - past * pay, np.nan)


def odd_last_yield(s, m, last, rate, pr, redemption, freq, basis):
    total, past, ahead, f, good = _odd_last(s, m, last, freq, basis)
    pay = 100 * rate / f
    return np.where(good, ((redemption + total * pay) / (pr + past * pay) - 1) * f / ahead, np.nan)


def accrint(issue, first, s, rate, par, freq, basis, whole):
    (f, good), basis, eom = _frequency(freq), np.trunc(basis), _month_end(first)
    good = good & (issue < s) & (rate > 0) & (par > 0)
    step = (12 // f).astype(np.int64)
    k = np.maximum((_months(s) - _months(first)) // step, 0)
    near = np.where(k > 0, add_months(first, k * step, eom), first)
    anchor = np.where(near < s, add_months(first, (k + 1) * step, eom), near)
    start = np.where((whole != 0) | (s <= first), issue, first)
    (periods,) = _odd_periods(np.where(good, start, anchor), (s,), anchor, f, basis, eom)
    return np.where(good, par * rate / f * periods, np.nan)


def _bond(f, dates: int, total: int, *last):
    """The builder of f, whose first arguments are dates; last fills what a call leaves out."""

    def kernel(*columns):
        good = np.logical_and.reduce([np.isfinite(c) for c in columns])
        days = [np.where(good, c, 0.0).astype(np.int64) for c in columns[:dates]]
        return np.where(good, f(*days, *columns[dates:]), np.nan)

    build = _numeric(kernel)
    return _opt(lambda *a: build(*(F.unix_date(as_date(x)) for x in a[:dates]), *(num(x) for x in a[dates:])), total, *last)


def _of(f):
    """A kernel of the coupon periods."""

    def run(*a):
        c = Coupons(*a)
        return np.where(c.good, f(c), np.nan)

    return run


add("COUPNUM", 3, 4, _bond(_of(lambda c: c.n), 2, 4, 0))
add("COUPNCD", 3, 4, _bond(_of(lambda c: c.next + _EPOCH), 2, 4, 0))
add("COUPPCD", 3, 4, _bond(_of(lambda c: c.previous + _EPOCH), 2, 4, 0))
add("COUPDAYS", 3, 4, _bond(_of(lambda c: c.days), 2, 4, 0))
add("COUPDAYBS", 3, 4, _bond(_of(lambda c: c.accrued), 2, 4, 0))
add("COUPDAYSNC", 3, 4, _bond(_of(lambda c: c.ahead), 2, 4, 0))
add("PRICE", 6, 7, _bond(price, 2, 7, 0))
add("YIELD", 6, 7, _bond(bond_yield, 2, 7, 0))
add("DURATION", 5, 6, _bond(duration, 2, 6, 0))
add("MDURATION", 5, 6, _bond(lambda s, m, c, y, f, b: duration(s, m, c, y, f, b) / (1 + y / np.trunc(f)), 2, 6, 0))
add("ODDFPRICE", 8, 9, _bond(odd_first_price, 4, 9, 0))
add("ODDFYIELD", 8, 9, _bond(odd_first_yield, 4, 9, 0))
add("ODDLPRICE", 7, 8, _bond(odd_last_price, 3, 8, 0))
add("ODDLYIELD", 7, 8, _bond(odd_last_yield, 3, 8, 0))
add("ACCRINT", 6, 8, _bond(accrint, 3, 8, 0, True))
