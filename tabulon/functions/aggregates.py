"""Aggregate functions: Columns for agg(). Blanks (NULL) don't count; an aggregate over nothing gives NULL where a spreadsheet gives an error."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions import special as sp
from tabulon.functions.registry import add
from tabulon.functions.scalar import num
from tabulon.operators.criteria import criteria


def agg(names, least, most, build):
    add(names, least, most, build, "aggregate")


def both(x: Column, y: Column) -> tuple[Column, Column]:
    """The numbers of pairs, blank in both if either is."""
    x, y = num(x), num(y)
    keep = x.isNotNull() & y.isNotNull()
    return F.when(keep, x), F.when(keep, y)


def _total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _several(one, total):
    """An aggregate of 1 to 255 arguments from those of each."""
    return lambda *c: total([one(x) for x in c])


_sum = lambda c: F.coalesce(F.sum(num(c)), F.lit(0.0))
_first = lambda f: lambda c: f(*c) if len(c) > 1 else c[0]
agg("SUM", 1, 255, _several(_sum, _total))
agg("AVERAGE", 1, 255, lambda *c: F.avg(num(c[0])) if len(c) == 1 else F.try_divide(_total([_sum(x) for x in c]), _total([F.count(num(x)) for x in c])))
agg("MIN", 1, 255, _several(lambda c: F.min(num(c)), lambda c: F.coalesce(_first(F.least)(c), F.lit(0.0))))
agg("MAX", 1, 255, _several(lambda c: F.max(num(c)), lambda c: F.coalesce(_first(F.greatest)(c), F.lit(0.0))))
agg("COUNT", 1, 255, _several(lambda c: F.count(num(c)), _total))
agg("COUNTA", 1, 255, _several(F.count, _total))
agg("COUNTBLANK", 1, 1, lambda c: F.count_if(c.isNull() | (c.cast("string") == "")))
agg("PRODUCT", 1, 255, _several(lambda c: F.product(num(c)), lambda c: F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(1.0)) * F.coalesce(b, F.lit(1.0)), c), F.lit(0.0))))
agg("SUMSQ", 1, 255, _several(lambda c: _sum(num(c) * num(c)), _total))
agg("SUMPRODUCT", 1, 255, lambda *c: F.coalesce(F.sum(_product([F.coalesce(num(x), F.lit(0.0)) for x in c])), F.lit(0.0)))


def _product(columns):
    out = columns[0]
    for c in columns[1:]:
        out = out * c
    return out


#: Codes of SUBTOTAL; the others are unsupported.
SUBTOTALS = {1: "AVERAGE", 2: "COUNT", 3: "COUNTA", 4: "MAX", 5: "MIN", 9: "SUM"}


def _subtotal(code, c):
    from tabulon.functions.registry import FUNCTIONS

    if int(code) % 100 not in SUBTOTALS:
        raise NotImplementedError(f"SUBTOTAL code {code}")
    return FUNCTIONS[SUBTOTALS[int(code) % 100]](c)


add("SUBTOTAL", 2, 2, lambda code, c: _subtotal(code, c), "aggregate")


def _conditional(f):
    """criteria pairs first or last, as the function has them."""
    return lambda c, *pairs: f(F.when(criteria(*pairs), num(F.col(c) if isinstance(c, str) else c)))


class _Raw:
    """Conditional aggregates keep their criteria as Python values, so they bypass the wrapping of literals."""

    def __init__(self, name, build):
        self.name, self.build, self.kind, self.least, self.most, self.aliases = name, build, "aggregate", 2, 255, ()

    def __call__(self, *args):
        return self.build(*args)


def _raw(name, build):
    from tabulon.functions.registry import FUNCTIONS

    FUNCTIONS[name] = _Raw(name, build)


_raw("SUMIFS", _conditional(lambda c: F.coalesce(F.sum(c), F.lit(0.0))))
_raw("AVERAGEIFS", _conditional(F.avg))
_raw("MINIFS", _conditional(lambda c: F.coalesce(F.min(c), F.lit(0.0))))
_raw("MAXIFS", _conditional(lambda c: F.coalesce(F.max(c), F.lit(0.0))))
_raw("COUNTIFS", lambda *pairs: F.count_if(criteria(*pairs)))
_raw("COUNTIF", lambda c, v: F.count_if(criteria(c, v)))
_raw("SUMIF", lambda c, v, s=None: F.coalesce(F.sum(F.when(criteria(c, v), num(F.col(s or c) if isinstance(s or c, str) else s or c))), F.lit(0.0)))
_raw("AVERAGEIF", lambda c, v, s=None: F.avg(F.when(criteria(c, v), num(F.col(s or c) if isinstance(s or c, str) else s or c))))

agg("AVERAGEA", 1, 255, lambda *c: F.avg(_a(c[0])) if len(c) == 1 else F.try_divide(_total([F.coalesce(F.sum(_a(x)), F.lit(0.0)) for x in c]), _total([F.count(_a(x)) for x in c])))
agg("MAXA", 1, 255, _several(lambda c: F.max(_a(c)), lambda c: F.coalesce(_first(F.greatest)(c), F.lit(0.0))))
agg("MINA", 1, 255, _several(lambda c: F.min(_a(c)), lambda c: F.coalesce(_first(F.least)(c), F.lit(0.0))))


def _a(c):
    """Text counts as 0, logicals as 0 and 1."""
    return F.when(c.isNull(), F.lit(None)).when(F.typeof(c) == "string", F.lit(0.0)).otherwise(num(c))


def _spread(*c: Column) -> tuple[Column, Column]:
    """Numbers and sum of squared deviations of several columns together, from each one's own."""
    n, mean = [F.count(num(x)) for x in c], [F.coalesce(F.avg(num(x)), F.lit(0.0)) for x in c]
    all_ = _total(n)
    middle = F.try_divide(_total([k * m for k, m in zip(n, mean, strict=True)]), all_)
    own = [F.coalesce(F.var_pop(num(x)), F.lit(0.0)) * k for x, k in zip(c, n, strict=True)]
    return all_, _total([v + k * (m - middle) * (m - middle) for v, k, m in zip(own, n, mean, strict=True)])


def _variance(alone, sample: bool, root: bool):
    def build(*c):
        if len(c) == 1:
            return alone(num(c[0]))
        n, squares = _spread(*c)
        v = F.when(n > int(sample), squares / (n - int(sample)))
        return F.sqrt(v) if root else v

    return build


def _median(*c):
    """Of one column exactly; of several, over the numbers of their rows together, by their counts of each value."""
    if len(c) == 1:
        return F.median(num(c[0]))
    raise NotImplementedError("MEDIAN of several columns: stack them with VSTACK first")


agg("MEDIAN", 1, 255, _median)
agg("STDEV.S STDEV", 1, 255, _variance(F.stddev_samp, True, True))
agg("STDEV.P STDEVP", 1, 255, _variance(F.stddev_pop, False, True))
agg("VAR.S VAR", 1, 255, _variance(F.var_samp, True, False))
agg("VAR.P VARP", 1, 255, _variance(F.var_pop, False, False))
agg("DEVSQ", 1, 255, lambda *c: _spread(*c)[1])
_logs = lambda x: F.ln(F.when(num(x) > 0, num(x)))
agg("GEOMEAN", 1, 255, lambda *c: F.when(_first(F.least)([F.min(num(x)) for x in c]) > 0, F.exp(_total([F.coalesce(F.sum(_logs(x)), F.lit(0.0)) for x in c]) / _total([F.count(num(x)) for x in c]))))
agg("HARMEAN", 1, 255, lambda *c: F.when(_first(F.least)([F.min(num(x)) for x in c]) > 0, _total([F.count(num(x)) for x in c]) / _total([F.coalesce(F.sum(1 / F.when(num(x) != 0, num(x))), F.lit(0.0)) for x in c])))
agg("CORREL", 2, 2, lambda x, y: F.corr(*both(x, y)))
agg("PEARSON", 2, 2, lambda x, y: F.corr(*both(x, y)))
agg("RSQ", 2, 2, lambda y, x: F.pow(F.corr(*both(x, y)), 2))
agg("COVARIANCE.P COVAR", 2, 2, lambda x, y: F.covar_pop(*both(x, y)))
agg("COVARIANCE.S", 2, 2, lambda x, y: F.covar_samp(*both(x, y)))
agg("SLOPE", 2, 2, lambda y, x: F.regr_slope(num(y), num(x)))
agg("INTERCEPT", 2, 2, lambda y, x: F.regr_intercept(num(y), num(x)))
agg("SUMX2MY2", 2, 2, lambda x, y: F.sum(both(x, y)[0] * both(x, y)[0] - both(x, y)[1] * both(x, y)[1]))
agg("SUMX2PY2", 2, 2, lambda x, y: F.sum(both(x, y)[0] * both(x, y)[0] + both(x, y)[1] * both(x, y)[1]))
agg("SUMXMY2", 2, 2, lambda x, y: F.sum(F.pow(both(x, y)[0] - both(x, y)[1], 2)))
agg("PERCENTILE.INC PERCENTILE", 2, 2, lambda c, k: F.percentile(num(c), k))
agg("QUARTILE.INC QUARTILE", 2, 2, lambda c, q: F.percentile(num(c), q / 4))
agg("PERCENTOF", 2, 2, lambda part, all_: F.sum(num(part)) / F.sum(num(all_)))
agg("MODE.SNGL MODE", 1, 1, lambda c: F.mode(num(c), deterministic=True))
agg("Z.TEST ZTEST", 2, 3, lambda c, x, s=None: _upper((F.avg(num(c)) - num(x)) / ((F.stddev_samp(num(c)) if s is None else num(s)) / F.sqrt(F.count(num(c))))))


def _upper(z: Column) -> Column:
    @F.pandas_udf("double")
    def tail(v: pd.Series) -> pd.Series:
        return pd.Series(1 - sp.norm_cdf(v.to_numpy(float)))

    return tail(z)


def t_test(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column, tails: int, kind: int) -> Column:
    """The probability of a t test from counts, means and sample variances: kind 2 equal variances, 3 Welch."""
    if kind == 2:
        df, scale = n1 + n2 - 2, F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2))
    else:
        a, b = v1 / n1, v2 / n2
        df, scale = (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)), F.sqrt(a + b)
    return _t_tail(F.abs(m1 - m2) / scale, df, tails)


def _t_tail(t: Column, df: Column, tails: int) -> Column:
    @F.pandas_udf("double")
    def tail(t: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(tails * sp.t_cdf(-t.to_numpy(float), v.to_numpy(float)))

    return tail(t.cast("double"), df.cast("double"))


def _t_columns(x, y, tails, kind):
    x, y, tails, kind = num(x), num(y), int(tails), int(kind)
    if kind == 1:
        d = x - y
        return _t_tail(F.abs(F.avg(d)) / (F.stddev_samp(d) / F.sqrt(F.count(d))), (F.count(d) - 1).cast("double"), tails)
    return t_test(F.count(x), F.avg(x), F.var_samp(x), F.count(y), F.avg(y), F.var_samp(y), tails, kind)


def _f_columns(x, y):
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        p = sp.f_cdf(a.to_numpy(float) / b.to_numpy(float), n.to_numpy(float) - 1, m.to_numpy(float) - 1)
        return pd.Series(2 * np.minimum(p, 1 - p))

    x, y = num(x), num(y)
    return tail(F.var_samp(x), F.var_samp(y), F.count(x).cast("double"), F.count(y).cast("double"))


_raw("T.TEST", lambda x, y, tails, kind: _t_columns(x, y, tails, kind))
_raw("TTEST", lambda x, y, tails, kind: _t_columns(x, y, tails, kind))
agg("F.TEST FTEST", 2, 2, _f_columns)


def linest(y: Column, *x: Column, const: bool = True) -> Column:
    """Coefficients in reverse order of x, then the intercept (0 without const): sums of products in one pass, solved in an Arrow kernel."""
    values = [F.lit(1.0)] * const + [num(c) for c in x]
    keep = num(y).isNotNull()
    for c in x:
        keep = keep & num(c).isNotNull()
    n = len(values)
    sums = [F.sum(F.when(keep, values[i] * values[j])) for i in range(n) for j in range(i, n)] + [F.sum(F.when(keep, values[i] * num(y))) for i in range(n)]

    @F.pandas_udf("array<double>")
    def solve(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            a, k = np.zeros((n, n)), 0
            for i in range(n):
                for j in range(i, n):
                    a[i, j] = a[j, i] = row[k] if row[k] is not None else np.nan
                    k += 1
            b = np.array(row[k:], float)
            out.append(None if not np.isfinite(a).all() else [*np.linalg.lstsq(a, b, rcond=None)[0][::-1], *[0.0] * (not const)])
        return pd.Series(out)

    return solve(*sums)


agg("LINEST", 2, 64, linest)
agg("LOGEST", 2, 64, lambda y, *x: F.transform(linest(F.ln(F.when(num(y) > 0, num(y))), *x), F.exp))
