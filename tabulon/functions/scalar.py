"""Scalar functions as Catalyst expressions: logic, math, trigonometry, engineering, text, dates, simple finance."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.registry import add

when = F.when
NULL = None


def lit(value):
    """A literal; a Python worker, which imports this module for its kernels only, has no session and keeps the plain value."""
    from pyspark import SparkContext

    return F.lit(value) if SparkContext._active_spark_context else value


def num(c: Column) -> Column:
    return c.try_cast("double") if hasattr(c, "try_cast") else c.cast("double")


def finite(c: Column) -> Column:
    """The number, or NULL for a number that isn't finite."""
    return when(F.isnan(c) | (F.abs(c) == lit(math.inf)), NULL).otherwise(c)


def ok(test: Column, value: Column) -> Column:
    return when(test, value)


def trunc(c: Column) -> Column:
    return when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")


def div(a: Column, b: Column) -> Column:
    return when(b != 0, a / b)


# ---- logic
add("IF", 2, 3, lambda t, a, b=lit(False): when(t.cast("boolean"), a).otherwise(b))
add("IFERROR", 2, 2, lambda v, alt: F.coalesce(v, alt))
add("IFNA", 2, 2, lambda v, alt: F.coalesce(v, alt))
add("NOT", 1, 1, lambda c: ~c.cast("boolean"))
add("AND", 1, 255, lambda *c: reduce(lambda a, b: a & b, [x.cast("boolean") for x in c]))
add("OR", 1, 255, lambda *c: reduce(lambda a, b: a | b, [x.cast("boolean") for x in c]))
add("XOR", 1, 254, lambda *c: reduce(lambda a, b: a + b, [x.cast("boolean").cast("int") for x in c]) % 2 == 1)
add("TRUE", 0, 0, lambda: lit(True))
add("FALSE", 0, 0, lambda: lit(False))


def _ifs(*c):
    if len(c) % 2:
        raise TypeError("IFS takes pairs of a test and a value")
    out = None
    for t, v in zip(c[::2], c[1::2], strict=True):
        out = when(t.cast("boolean"), v) if out is None else out.when(t.cast("boolean"), v)
    return out


def _switch(e, *c):
    out = None
    for v, r in zip(c[0 : len(c) // 2 * 2 : 2], c[1::2], strict=False):
        same = F.lower(e.cast("string")) == F.lower(v.cast("string"))
        out = when(same, r) if out is None else out.when(same, r)
    return out.otherwise(c[-1]) if len(c) % 2 else out


add("IFS", 2, 254, _ifs)
add("SWITCH", 3, 254, _switch)
add("CHOOSE", 2, 255, lambda i, *c: F.coalesce(*[when(trunc(num(i)) == k, v) for k, v in enumerate(c, 1)]))


# ---- math
def _unary(f):
    return lambda c: finite(f(num(c)))


def _multiple(up: bool):
    def build(c, s):
        x, s = num(c), num(s)
        r = (F.ceil(x / s) if up else F.floor(x / s)).cast("double") * s
        if up:
            return when(s == 0, lit(0.0)).when((x > 0) & (s < 0), NULL).otherwise(r)
        return when((s == 0) & (x == 0), lit(0.0)).when((s == 0) | ((x > 0) & (s < 0)), NULL).otherwise(r)

    return build


def _precise(up: bool, mode: bool):
    def build(c, s=lit(1.0), away=lit(False)):
        x, s = num(c), F.abs(num(s))
        towards = (F.ceil if up else F.floor)(x / s).cast("double") * s
        other = (F.floor if up else F.ceil)(x / s).cast("double") * s
        r = when(away.cast("boolean") & (x < 0), other).otherwise(towards) if mode else towards
        return when(s == 0, lit(0.0)).otherwise(r)

    return build


def _scaled(rounding):
    """Rounds the scaled number, so 1.005 at two digits is 1.0."""

    def build(c, d=lit(0)):
        x, p = num(c), F.pow(lit(10.0), trunc(num(d)))
        return finite(rounding(x * p) / p)

    return build


def _half(y):
    return F.signum(y) * F.floor(F.abs(y) + 0.5)


def _away(y):
    return F.signum(y) * F.ceil(F.abs(y))


for names, f in {"ABS": F.abs, "EXP": F.exp, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "SINH": F.sinh, "COSH": F.cosh, "TANH": F.tanh, "ASINH": lambda x: F.signum(x) * F.ln(F.abs(x) + F.sqrt(x * x + 1)), "ATAN": F.atan, "DEGREES": F.degrees, "RADIANS": F.radians, "SIGN": F.signum, "SEC": lambda x: 1 / F.cos(x), "SECH": lambda x: 1 / F.cosh(x), "ACOT": lambda x: F.atan2(lit(1.0), x)}.items():
    add(names, 1, 1, _unary(f))
for names, test, f in [
    ("LN", lambda x: x > 0, F.ln), ("LOG10", lambda x: x > 0, F.log10), ("SQRT", lambda x: x >= 0, F.sqrt), ("SQRTPI", lambda x: x >= 0, lambda x: F.sqrt(x * math.pi)),
    ("ACOS", lambda x: F.abs(x) <= 1, F.acos), ("ASIN", lambda x: F.abs(x) <= 1, F.asin), ("ACOSH", lambda x: x >= 1, F.acosh), ("ATANH", lambda x: F.abs(x) < 1, F.atanh),
    ("ACOTH", lambda x: F.abs(x) > 1, lambda x: 0.5 * F.ln((x + 1) / (x - 1))), ("COT", lambda x: x != 0, lambda x: F.cos(x) / F.sin(x)), ("COTH", lambda x: x != 0, lambda x: 1 / F.tanh(x)),
    ("CSC", lambda x: x != 0, lambda x: 1 / F.sin(x)), ("CSCH", lambda x: x != 0, lambda x: 1 / F.sinh(x)),
]:
    add(names, 1, 1, lambda c, t=test, f=f: finite(when(t(num(c)), f(num(c)))))
add("INT", 1, 1, lambda c: F.floor(num(c)).cast("double"))
add("EVEN", 1, 1, lambda c: F.signum(num(c)) * F.ceil(F.abs(num(c)) / 2) * 2)
add("ODD", 1, 1, lambda c: when(num(c) == 0, lit(1.0)).otherwise(F.signum(num(c)) * (F.ceil((F.abs(num(c)) - 1) / 2) * 2 + 1)))
add("LOG", 1, 2, lambda c, b=lit(10.0): when((num(c) > 0) & (num(b) > 0) & (num(b) != 1), F.ln(num(c)) / F.ln(num(b))))
add("MOD", 2, 2, lambda c, d: when(num(d) != 0, num(c) - num(d) * F.floor(num(c) / num(d))))
add("MROUND", 2, 2, lambda c, m: when((num(m) == 0) | (num(c) == 0), lit(0.0)).when(F.signum(num(c)) == F.signum(num(m)), _half(num(c) / num(m)) * num(m)))
add("POWER", 2, 2, lambda a, b: finite(when(~((num(a) == 0) & (num(b) <= 0)), F.pow(num(a), num(b)))))
add("QUOTIENT", 2, 2, lambda a, b: trunc(div(num(a), num(b))))
add("ROUND", 2, 2, _scaled(_half))
add("ROUNDUP", 2, 2, _scaled(_away))
add("ROUNDDOWN", 1, 2, _scaled(trunc))
add("TRUNC", 1, 2, _scaled(trunc))
add("CEILING", 2, 2, _multiple(True))
add("FLOOR", 2, 2, _multiple(False))
add("CEILING.MATH", 1, 3, _precise(True, True))
add("FLOOR.MATH", 1, 3, _precise(False, True))
add("CEILING.PRECISE", 1, 2, _precise(True, False))
add("ISO.CEILING", 1, 2, _precise(True, False))
add("FLOOR.PRECISE", 1, 2, _precise(False, False))
add("PI", 0, 0, lambda: lit(math.pi))
add("ATAN2", 2, 2, lambda x, y: when(~((num(x) == 0) & (num(y) == 0)), F.atan2(num(y), num(x))))
add("SERIESSUM", 4, 4, lambda x, n, m, c: F.aggregate(F.sequence(lit(0), F.size(c) - 1), lit(0.0), lambda a, i: a + F.get(c, i) * F.pow(num(x), num(n) + i * num(m))))
add("PERMUT", 2, 2, lambda n, k: when((trunc(num(k)) >= 0) & (trunc(num(n)) >= trunc(num(k))), F.aggregate(when(trunc(num(k)) >= 1, F.sequence(lit(0), (trunc(num(k)) - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lit(1.0), lambda a, i: a * (trunc(num(n)) - i))))
add("PERMUTATIONA", 2, 2, lambda n, k: when((num(n) >= 0) & (num(k) >= 0), F.pow(trunc(num(n)), trunc(num(k)))))
add("FACTDOUBLE", 1, 1, lambda c: when(trunc(num(c)) >= -1, F.aggregate(when(trunc(num(c)) >= 1, F.sequence(trunc(num(c)).cast("int"), lit(1), lit(-1))).otherwise(F.array().cast("array<int>")), lit(1.0), lambda a, i: when((trunc(num(c)).cast("int") - i) % 2 == 0, a * i).otherwise(a))))
add("BASE", 2, 3, lambda c, r, w=lit(0): when((num(c) >= 0) & num(r).between(2, 36), F.lpad(_base(num(c), num(r)), F.greatest(F.length(_base(num(c), num(r))), w.cast("int")), "0")))
add("DECIMAL", 2, 2, lambda t, r: F.aggregate(F.split(F.upper(F.trim(t.cast("string"))), ""), lit(0.0), lambda a, d: when(_digit(d) < num(r), a * num(r) + _digit(d))))


def _digit(d: Column) -> Column:
    return (F.instr(lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), d) - 1).cast("double")


def _base(c: Column, r: Column) -> Column:
    """Digits from the highest power down; a double has at most 64 of base 2."""
    n = F.floor(c)
    size = when(n < 1, lit(1)).otherwise(F.floor(F.ln(n.cast("double")) / F.ln(r) + 1e-9).cast("int") + 1)
    digits = F.transform(F.sequence(size - 1, lit(0), lit(-1)), lambda k: F.substr(lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.floor(n / F.pow(r, k)) % r + 1).cast("int"), lit(1)))
    return F.array_join(digits, "")


# ---- engineering: bits and number systems
def _bits(f):
    return lambda a, b: when((num(a) >= 0) & (num(b) >= 0) & (num(a) < 2**48) & (num(b) < 2**48) & (num(a) == F.floor(num(a))) & (num(b) == F.floor(num(b))), f(num(a).cast("long"), num(b).cast("long")).cast("double"))


def _shift(sign: int):
    def build(a, s):
        x, k = num(a), trunc(num(s)) * sign
        r = F.floor(x * F.pow(lit(2.0), k))
        return when((x >= 0) & (x < 2**48) & (F.abs(k) <= 53) & (r < 2**48), r.cast("double"))

    return build


add("BITAND", 2, 2, _bits(lambda a, b: a.bitwiseAND(b)))
add("BITOR", 2, 2, _bits(lambda a, b: a.bitwiseOR(b)))
add("BITXOR", 2, 2, _bits(lambda a, b: a.bitwiseXOR(b)))
add("BITLSHIFT", 2, 2, _shift(1))
add("BITRSHIFT", 2, 2, _shift(-1))
add("DELTA", 1, 2, lambda a, b=lit(0.0): (num(a) == num(b)).cast("double"))
add("GESTEP", 1, 2, lambda a, b=lit(0.0): (num(a) >= num(b)).cast("double"))
#: Bits of ten digits of each number system.
_SYSTEMS = {"BIN": (2, 10), "OCT": (8, 30), "HEX": (16, 40)}


def _to_dec(t: Column, system: str) -> Column:
    radix, bits = _SYSTEMS[system]
    t = F.upper(t.cast("string"))
    digits = {"BIN": "01", "OCT": "0-7", "HEX": "0-9A-F"}[system]
    v = F.conv(t, radix, 10).cast("double")
    return when(t.rlike(f"^[{digits}]{{1,10}}$"), when(v >= 2 ** (bits - 1), v - 2**bits).otherwise(v)).when(t == "", lit(0.0))


def _from_dec(c: Column, system: str, places: Column | None) -> Column:
    radix, bits = _SYSTEMS[system]
    n = trunc(num(c))
    text = F.conv(when(n < 0, n + 2**bits).otherwise(n).cast("long").cast("string"), 10, radix)
    text = when((n >= -(2 ** (bits - 1))) & (n < 2 ** (bits - 1)), text)
    if places is None:
        return text
    p = trunc(num(places)).cast("int")
    return when(n < 0, text).when((p >= F.length(text)) & (p <= 10), F.lpad(text, p, "0"))


for s in _SYSTEMS:
    add(f"{s}2DEC", 1, 1, lambda t, s=s: _to_dec(t, s))
    add(f"DEC2{s}", 1, 2, lambda c, p=None, s=s: _from_dec(c, s, p))
    for o in _SYSTEMS:
        if o != s:
            add(f"{s}2{o}", 1, 2, lambda t, p=None, s=s, o=o: _from_dec(_to_dec(t, s), o, p))

# ---- information
add("ISBLANK", 1, 1, lambda c: c.isNull())
for n in ("ISERR", "ISERROR", "ISNA"):
    add(n, 1, 1, lambda c: c.isNull())
add("ISEVEN", 1, 1, lambda c: F.abs(trunc(num(c))) % 2 == 0)
add("ISODD", 1, 1, lambda c: F.abs(trunc(num(c))) % 2 == 1)
add("ISNUMBER", 1, 1, lambda c: F.typeof(c).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*|date|timestamp.*)$") & c.isNotNull())
add("ISTEXT", 1, 1, lambda c: (F.typeof(c) == "string") & c.isNotNull())
add("ISNONTEXT", 1, 1, lambda c: (F.typeof(c) != "string") | c.isNull())
add("ISLOGICAL", 1, 1, lambda c: (F.typeof(c) == "boolean") & c.isNotNull())
add("N", 1, 1, lambda c: F.coalesce(when(F.typeof(c) == "string", lit(0.0)).otherwise(num(c)), lit(0.0)))
add("NA", 0, 0, lambda: lit(None))
add("T", 1, 1, lambda c: F.coalesce(when(F.typeof(c) == "string", c.cast("string")), lit("")))
add("TYPE", 1, 1, lambda c: when(F.typeof(c) == "string", lit(2)).when(F.typeof(c) == "boolean", lit(4)).otherwise(lit(1)))
add("ERROR.TYPE", 1, 1, lambda c: reduce(lambda w, kv: w.when(c == kv[1], lit(kv[0])), list(enumerate(["#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A"], 2)), when(c == "#NULL!", lit(1))))

# ---- text
def txt(c: Column) -> Column:
    """The text of a value: whole numbers without a point, blanks as the empty text."""
    x = num(c)
    whole = F.typeof(c).isin("double", "float") & (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.coalesce(when(whole, F.floor(x).cast("string")).otherwise(c.cast("string")), lit(""))


add("LOWER", 1, 1, lambda c: F.lower(txt(c)))
add("UPPER", 1, 1, lambda c: F.upper(txt(c)))
add("LEN", 1, 1, lambda c: F.length(txt(c)).cast("double"))
add("LEFT", 1, 2, lambda c, n=lit(1): when(num(n) >= 0, F.substr(txt(c), lit(1), trunc(num(n)).cast("int"))))
add("RIGHT", 1, 2, lambda c, n=lit(1): when(num(n) >= 0, F.right(txt(c), trunc(num(n)).cast("int"))))
add("MID", 3, 3, lambda c, s, n: when((num(s) >= 1) & (num(n) >= 0), F.substr(txt(c), trunc(num(s)).cast("int"), trunc(num(n)).cast("int"))))
add("CONCAT", 1, 253, lambda *c: F.concat(*map(txt, c)))
add("CONCATENATE", 1, 255, lambda *c: F.concat(*map(txt, c)))
add("EXACT", 2, 2, lambda a, b: txt(a) == txt(b))
add("FIND", 2, 3, lambda f, w, s=lit(1): when(num(s) >= 1, F.nullif(F.position(txt(f), txt(w), trunc(num(s)).cast("int")), lit(0)).cast("double")))
add("SEARCH", 2, 3, lambda f, w, s=lit(1): when(num(s) >= 1, F.nullif(F.position(F.lower(txt(f)), F.lower(txt(w)), trunc(num(s)).cast("int")), lit(0)).cast("double")))
add("REPLACE", 4, 4, lambda c, s, n, r: when((num(s) >= 1) & (num(n) >= 0), F.concat(F.substr(txt(c), lit(1), trunc(num(s)).cast("int") - 1), txt(r), F.substr(txt(c), (trunc(num(s)) + trunc(num(n))).cast("int")))))
add("REPT", 2, 2, lambda c, n: when(num(n) >= 0, F.repeat(txt(c), trunc(num(n)).cast("int"))))
add("TRIM", 1, 1, lambda c: F.trim(F.regexp_replace(txt(c), " +", " ")))
add("CLEAN", 1, 1, lambda c: F.regexp_replace(txt(c), r"[\x00-\x1F]", ""))
add("TEXTJOIN", 3, 254, lambda d, skip, *c: _join(d, skip, c))
add("UNICODE", 1, 1, lambda c: when(txt(c) != "", F.ascii(txt(c)).cast("double")))
add("HYPERLINK", 1, 2, lambda a, b=None: a if b is None else b)


def _join(d, skip, c):
    parts = F.filter(F.array(*map(txt, c)), lambda x: ~(skip.cast("boolean") & (x == "")))
    return F.aggregate(parts, lit(None).cast("string"), lambda a, x: when(a.isNull(), x).otherwise(F.concat(a, txt(d), x)), lambda a: F.coalesce(a, lit("")))


def _substitute(c, old, new, nth=None):
    if nth is None:
        return when(txt(old) == "", txt(c)).otherwise(F.replace(txt(c), txt(old), txt(new)))
    parts = F.split(txt(c), F.concat(lit(r"\Q"), txt(old), lit(r"\E")), -1)
    k = trunc(num(nth)).cast("int")
    head, tail = F.array_join(F.slice(parts, lit(1), k), "\x01"), F.slice(parts, k + 1, F.greatest(F.size(parts) - k, lit(0)))
    back = lambda x: F.replace(x, lit("\x01"), txt(old))
    return when((txt(old) == "") | (F.size(parts) <= k), txt(c)).when(k >= 1, F.concat(back(head), txt(new), back(F.array_join(tail, "\x01"))))


def _around(after: bool):
    """Text before or after the nth delimiter; counted from the end if n is negative."""

    def build(c, d, n=lit(1), mode=lit(0), end=lit(0), missing=None):
        missing = lit(missing) if missing is None else missing
        flag = when(num(mode) == 1, lit("(?i)")).otherwise(lit(""))
        parts = F.split(txt(c), F.concat(flag, lit(r"\Q"), txt(d), lit(r"\E")), -1)
        k, size = trunc(num(n)).cast("int"), F.size(parts)
        at = when(k > 0, k).otherwise(size + k)  # delimiters before the cut, counted from the left
        fits = (k != 0) & (at >= 1) & (at < size)
        # positions by length, as delimiters may differ in case
        before = F.aggregate(F.slice(parts, lit(1), at), lit(0), lambda a, x: a + F.length(x)) + (at - 1) * F.length(txt(d))
        value = F.substr(txt(c), before + F.length(txt(d)) + 1) if after else F.substr(txt(c), lit(1), before)
        whole = lit("") if after else txt(c)
        other = when((num(end) == 1) & (at == size), whole).when((num(end) == 1) & (at == 0), txt(c) if after else lit("")).otherwise(missing.cast("string"))
        return when(txt(d) == "", txt(c) if after else lit("")).when(fits, value).otherwise(other)

    return build


add("SUBSTITUTE", 3, 4, _substitute)
add("TEXTBEFORE", 2, 6, _around(False))
add("TEXTAFTER", 2, 6, _around(True))
add("VALUE", 1, 1, lambda c: _value(F.trim(txt(c))))
add("DOLLAR", 1, 2, lambda c, d=lit(2): _dollar(num(c), d))
add("VALUETOTEXT", 1, 2, lambda c, f=lit(0): when((num(f) == 1) & (F.typeof(c) == "string"), F.concat(lit('"'), F.replace(txt(c), lit('"'), lit('""')), lit('"'))).otherwise(txt(c)))
add("REGEXTEST", 2, 3, lambda c, p, i=lit(0): F.regexp_like(txt(c), F.concat(when(num(i) == 1, lit("(?i)")).otherwise(lit("")), p)))
add("REGEXEXTRACT", 2, 4, lambda c, p, m=lit(0), i=lit(0): F.regexp_substr(txt(c), F.concat(when(num(i) == 1, lit("(?i)")).otherwise(lit("")), p)))
add("TEXTSPLIT", 2, 2, lambda c, d: F.split(txt(c), F.concat(lit(r"\Q"), txt(d), lit(r"\E")), -1))
add("ARRAYTOTEXT", 1, 2, lambda a, f=lit(0): when(num(f) == 1, F.concat(lit("{"), F.array_join(a.cast("array<string>"), ";"), lit("}"))).otherwise(F.array_join(a.cast("array<string>"), ", ")))


def _value(t):
    sign = when(t.rlike(r"^\(.*\)$"), lit(-1.0)).otherwise(lit(1.0))
    part = when(t.rlike(r"%\)?$"), lit(0.01)).otherwise(lit(1.0))
    return sign * part * F.regexp_replace(t, r"[,$%() ]", "").try_cast("double")


def _dollar(x, d):
    k = trunc(num(d)).cast("int")
    digits = F.coalesce(*[when(k == n, F.format_number(F.abs(x), n)) for n in range(0, 11)])
    return when(x < 0, F.concat(lit("($"), digits, lit(")"))).otherwise(F.concat(lit("$"), digits))


# ---- dates: a DATE or TIMESTAMP column, or a serial number of the 1900 system from 1 March 1900 on
EPOCH = "1899-12-30"


def as_date(c: Column) -> Column:
    """The date of a date, timestamp, ISO text or serial number."""
    kind = F.typeof(c)
    return when(kind.isin("date") | kind.startswith("timestamp") | (kind == "string"), F.substr(c.cast("string"), lit(1), lit(10)).try_cast("date")).otherwise(F.date_add(F.to_date(lit(EPOCH)), F.floor(c.cast("string").try_cast("double")).cast("int")))


def serial(d: Column) -> Column:
    return F.datediff(d, F.to_date(lit(EPOCH))).cast("double")


def seconds(c: Column) -> Column:
    """Seconds of the day of a serial number, rounded."""
    x = num(c)
    return F.pmod(F.floor((x - F.floor(x)) * 86400 + 0.5), lit(86400))


add("DATE", 3, 3, lambda y, m, d: serial(F.date_add(F.add_months(F.make_date(when(num(y) < 1900, trunc(num(y)) + 1900).otherwise(trunc(num(y))).cast("int"), lit(1), lit(1)), trunc(num(m)).cast("int") - 1), trunc(num(d)).cast("int") - 1)))
add("DATEVALUE", 1, 1, lambda c: serial(when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))))
add("TIMEVALUE", 1, 1, lambda c: when(c.rlike(r"^\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$"), (F.split(c, ":")[0].cast("double") * 3600 + F.split(c, ":")[1].cast("double") * 60 + F.coalesce(F.get(F.split(c, ":"), lit(2)).cast("double"), lit(0.0))) / 86400))
add("YEAR", 1, 1, lambda c: F.year(as_date(c)).cast("double"))
add("MONTH", 1, 1, lambda c: F.month(as_date(c)).cast("double"))
add("DAY", 1, 1, lambda c: F.dayofmonth(as_date(c)).cast("double"))
add("HOUR", 1, 1, lambda c: F.floor(seconds(c) / 3600).cast("double"))
add("MINUTE", 1, 1, lambda c: (F.floor(seconds(c) / 60) % 60).cast("double"))
add("SECOND", 1, 1, lambda c: (seconds(c) % 60).cast("double"))
add("TIME", 3, 3, lambda h, m, s: F.pmod((trunc(num(h)) * 3600 + trunc(num(m)) * 60 + trunc(num(s))) / 86400, lit(1.0)))
add("EDATE", 2, 2, lambda c, m: serial(F.add_months(as_date(c), trunc(num(m)).cast("int"))))
add("EOMONTH", 2, 2, lambda c, m: serial(F.last_day(F.add_months(as_date(c), trunc(num(m)).cast("int")))))
add("DAYS", 2, 2, lambda e, s: F.datediff(as_date(e), as_date(s)).cast("double"))
add("ISOWEEKNUM", 1, 1, lambda c: F.weekofyear(as_date(c)).cast("double"))


def _weekday(c, t=lit(1)):
    d = F.weekday(as_date(c))  # Monday 0
    first = when(num(t) == 1, lit(6)).when(num(t).isin(2, 3), lit(0)).when(num(t).between(11, 17), (num(t) - 11).cast("int"))
    return (F.pmod(d - first, lit(7)) + when(num(t) == 3, lit(0)).otherwise(lit(1))).cast("double")


def _weeknum(c, t=lit(1)):
    d = as_date(c)
    first = when(num(t) == 1, lit(6)).when(num(t) == 2, lit(0)).when(num(t).between(11, 17), (num(t) - 11).cast("int"))
    new_year = F.trunc(d, "year")
    return when(num(t) == 21, F.weekofyear(d)).otherwise(F.floor((F.datediff(d, new_year) + F.pmod(F.weekday(new_year) - first, lit(7))) / 7) + 1).cast("double")


def days360(a: Column, b: Column, european: Column) -> Column:
    d1, d2 = F.dayofmonth(a), F.dayofmonth(b)
    feb = (F.month(a) == 2) & (a == F.last_day(a))
    feb2 = (F.month(b) == 2) & (b == F.last_day(b))
    e1, e2 = F.least(d1, lit(30)), F.least(d2, lit(30))
    u1 = when(feb | (d1 == 31), lit(30)).otherwise(d1)
    u2 = when(feb & feb2, lit(30)).when((d2 == 31) & (u1 >= 30), lit(30)).otherwise(d2)
    x, y = when(european, e1).otherwise(u1), when(european, e2).otherwise(u2)
    return ((F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + y - x).cast("double")


def yearfrac(a: Column, b: Column, basis: Column) -> Column:
    """Fraction of a year between two dates, a not after b."""
    days = F.datediff(b, a)
    y1, y2 = F.year(a), F.year(b)
    leap = lambda y: F.dayofyear(F.make_date(y, lit(12), lit(31)))
    within = F.add_months(a, 12) >= b
    feb29 = F.exists(F.sequence(y1, y2), lambda y: (leap(y) == 366) & (F.make_date(y, lit(3), lit(1)) > a) & (F.date_sub(F.make_date(y, lit(3), lit(1)), 1) <= b))
    short = when(y1 == y2, leap(y1)).when(feb29, lit(366)).otherwise(lit(365)).cast("double")
    mean = F.aggregate(F.sequence(y1, y2), lit(0.0), lambda s, y: s + leap(y)) / (y2 - y1 + 1)
    return when(basis == 0, days360(a, b, lit(False)) / 360).when(basis == 1, days / when(within, short).otherwise(mean)).when(basis == 2, days / 360).when(basis == 3, days / 365).when(basis == 4, days360(a, b, lit(True)) / 360)


def _datedif(s, e, u):
    a, b = as_date(s), as_date(e)
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - (F.dayofmonth(b) < F.dayofmonth(a)).cast("int")
    u = F.upper(u)
    md = when(F.dayofmonth(b) >= F.dayofmonth(a), F.dayofmonth(b) - F.dayofmonth(a)).otherwise(F.dayofmonth(F.last_day(F.add_months(b, -1))) + F.dayofmonth(b) - F.dayofmonth(a))
    years = F.floor(months / 12).cast("int")
    return when(b >= a, when(u == "Y", years).when(u == "M", months).when(u == "D", F.datediff(b, a)).when(u == "YM", months % 12).when(u == "MD", md).when(u == "YD", F.datediff(b, F.add_months(a, years * 12)))).cast("double")


def weekend_mask(code: Column) -> Column:
    """Seven flags from Monday on, 1 for a day off, of a code 1-7, 11-17 or of a mask."""
    text = code.cast("string")
    n = text.try_cast("double").cast("int")
    two = F.array(*[lit(x) for x in ("0000011", "1000001", "1100000", "0110000", "0011000", "0001100", "0000110")])
    one = F.array(*[lit(x) for x in ("0000001", "1000000", "0100000", "0010000", "0001000", "0000100", "0000010")])
    return when(text.rlike("^[01]{7}$"), text).when(n.between(1, 7), F.get(two, n - 1)).when(n.between(11, 17), F.get(one, n - 11))


def _networkdays(s, e, code=lit("1"), holidays=None):
    a, b = as_date(s), as_date(e)
    low, high, mask = F.least(a, b), F.greatest(a, b), weekend_mask(code)
    off = lambda d: F.substr(mask, F.weekday(d) + 1, lit(1)) == "1"
    whole = F.floor((F.datediff(high, low) + 1) / 7)
    per_week = F.length(F.replace(mask, lit("1"), lit("")))
    rest = F.sequence(F.date_add(low, (whole * 7).cast("int")), F.date_add(high, 1))  # one day too many, left out below
    extra = F.size(F.filter(rest, lambda d: (d <= high) & ~off(d)))
    n = whole * per_week + extra
    if holidays is not None:
        n = n - F.size(F.array_distinct(F.filter(F.transform(holidays, lambda h: h.cast("date")), lambda h: h.between(low, high) & ~off(h))))
    return (n * when(a <= b, lit(1)).otherwise(lit(-1))).cast("double")


add("WEEKDAY", 1, 2, _weekday)
add("WEEKNUM", 1, 2, _weeknum)
add("DAYS360", 2, 3, lambda a, b, m=lit(False): days360(as_date(a), as_date(b), m.cast("boolean")))
add("YEARFRAC", 2, 3, lambda a, b, m=lit(0): when(as_date(a) <= as_date(b), lit(1.0)).otherwise(lit(-1.0)) * yearfrac(F.least(as_date(a), as_date(b)), F.greatest(as_date(a), as_date(b)), trunc(num(m))))
add("DATEDIF", 3, 3, _datedif)
add("NETWORKDAYS", 2, 3, lambda a, b, h=None: _networkdays(a, b, lit("1"), h))
add("NETWORKDAYS.INTL", 2, 4, _networkdays)
add("TODAY", 1, 1, lambda now: F.floor(num(now)).cast("double"))
add("NOW", 1, 1, num)

# ---- simple finance
_f = num


def _fv(r, n, p, v=lit(0.0), t=lit(0)):
    r, n, p, v = _f(r), _f(n), _f(p), _f(v)
    g = F.pow(1 + r, n)
    return finite(when(r == 0, -(v + p * n)).otherwise(-(v * g + p * (1 + r * when(_f(t) != 0, lit(1.0)).otherwise(lit(0.0))) * (g - 1) / r)))


def _pv(r, n, p, v=lit(0.0), t=lit(0)):
    r, n, p, v = _f(r), _f(n), _f(p), _f(v)
    g = F.pow(1 + r, n)
    return finite(when(r == 0, -(v + p * n)).otherwise(-(v + p * (1 + r * when(_f(t) != 0, lit(1.0)).otherwise(lit(0.0))) * (g - 1) / r) / g))


def _pmt(r, n, pv, fv=lit(0.0), t=lit(0)):
    r, n, pv, fv = _f(r), _f(n), _f(pv), _f(fv)
    g = F.pow(1 + r, n)
    return finite(when(n == 0, NULL).when(r == 0, -(pv + fv) / n).otherwise(-(pv * g + fv) * r / ((g - 1) * (1 + r * when(_f(t) != 0, lit(1.0)).otherwise(lit(0.0))))))


def _ipmt(r, k, n, pv, fv=lit(0.0), t=lit(0)):
    p = _pmt(r, n, pv, fv, t)
    due = _f(t) != 0
    before = _fv(r, _f(k) - 1, p, pv, t)
    i = when(due & (_f(k) == 1), lit(0.0)).when(due, (before - p) * _f(r)).otherwise(before * _f(r))
    return when(_f(k).between(lit(1.0), _f(n)), i)


def _nper(r, p, v, fv=lit(0.0), t=lit(0)):
    r, p, v, fv = _f(r), _f(p), _f(v), _f(fv)
    q = p * (1 + r * when(_f(t) != 0, lit(1.0)).otherwise(lit(0.0)))
    x = (q - fv * r) / (q + v * r)
    return finite(when(r == 0, div(-(v + fv), p)).when(x > 0, F.ln(x) / F.ln(1 + r)))


def _db(cost, salvage, life, period, month=lit(12)):
    c, s, n, k, m = map(_f, (cost, salvage, life, period, month))
    rate = F.floor((1 - F.pow(s / c, 1 / n)) * 1000 + 0.5) / 1000
    first = c * rate * m / 12
    book = (c - first) * F.pow(1 - rate, k - 2)
    return when((k >= 1) & (k <= n + (m < 12).cast("int")), when(k == 1, first).when(k == n + 1, book * rate * (12 - m) / 12).otherwise(book * rate))


add("FV", 3, 5, _fv)
add("PV", 3, 5, _pv)
add("PMT", 3, 5, _pmt)
add("IPMT", 4, 6, _ipmt)
add("PPMT", 4, 6, lambda r, k, n, pv, fv=lit(0.0), t=lit(0): _pmt(r, n, pv, fv, t) - _ipmt(r, k, n, pv, fv, t))
add("NPER", 3, 5, _nper)
add("SLN", 3, 3, lambda c, s, n: div(_f(c) - _f(s), _f(n)))
add("SYD", 4, 4, lambda c, s, n, k: when((_f(k) >= 1) & (_f(k) <= _f(n)), (_f(c) - _f(s)) * (_f(n) - _f(k) + 1) * 2 / (_f(n) * (_f(n) + 1))))
add("DB", 4, 5, _db)
add("EFFECT", 2, 2, lambda r, n: when((_f(r) > 0) & (trunc(_f(n)) >= 1), F.pow(1 + _f(r) / trunc(_f(n)), trunc(_f(n))) - 1))
add("NOMINAL", 2, 2, lambda r, n: when((_f(r) > 0) & (trunc(_f(n)) >= 1), trunc(_f(n)) * (F.pow(1 + _f(r), 1 / trunc(_f(n))) - 1)))
add("ISPMT", 4, 4, lambda r, k, n, pv: when(_f(n) != 0, -_f(pv) * _f(r) * (1 - _f(k) / _f(n))))
add("PDURATION", 3, 3, lambda r, a, b: when((_f(r) > 0) & (_f(a) > 0) & (_f(b) > 0), F.ln(_f(b) / _f(a)) / F.ln(1 + _f(r))))
add("RRI", 3, 3, lambda n, a, b: finite(when((_f(n) > 0) & (_f(a) != 0), F.pow(_f(b) / _f(a), 1 / _f(n)) - 1)))
add("FVSCHEDULE", 2, 2, lambda p, s: F.aggregate(s, _f(p), lambda a, r: a * (1 + F.coalesce(r, lit(0.0)))))
_price_scale = lambda d: F.pow(lit(10.0), F.ceil(F.log10(d)))
add("DOLLARDE", 2, 2, lambda x, d: when(trunc(_f(d)) >= 1, trunc(_f(x)) + (_f(x) - trunc(_f(x))) * _price_scale(trunc(_f(d))) / trunc(_f(d))))
add("DOLLARFR", 2, 2, lambda x, d: when(trunc(_f(d)) >= 1, trunc(_f(x)) + (_f(x) - trunc(_f(x))) * trunc(_f(d)) / _price_scale(trunc(_f(d)))))
add("STANDARDIZE", 3, 3, lambda x, m, s: when(_f(s) > 0, (_f(x) - _f(m)) / _f(s)))
add("EXPON.DIST EXPONDIST", 3, 3, lambda x, l, c: when((_f(x) >= 0) & (_f(l) > 0), when(c.cast("boolean"), 1 - F.exp(-_f(l) * _f(x))).otherwise(_f(l) * F.exp(-_f(l) * _f(x)))))
add("PHI", 1, 1, lambda x: F.exp(-_f(x) * _f(x) / 2) / math.sqrt(2 * math.pi))

# ---- discounted securities and bills
_basis = lambda b: trunc(num(b))
_frac = lambda s, m, b: yearfrac(as_date(s), as_date(m), _basis(b))
_dated = lambda s, m, v: when(as_date(s) < as_date(m), finite(v))
add("DISC", 4, 5, lambda s, m, p, r, b=lit(0): _dated(s, m, (_f(r) - _f(p)) / _f(r) / _frac(s, m, b)))
add("INTRATE", 4, 5, lambda s, m, i, r, b=lit(0): _dated(s, m, (_f(r) - _f(i)) / _f(i) / _frac(s, m, b)))
add("PRICEDISC", 4, 5, lambda s, m, d, r, b=lit(0): _dated(s, m, _f(r) * (1 - _f(d) * _frac(s, m, b))))
add("RECEIVED", 4, 5, lambda s, m, i, d, b=lit(0): _dated(s, m, _f(i) / (1 - _f(d) * _frac(s, m, b))))
add("YIELDDISC", 4, 5, lambda s, m, p, r, b=lit(0): _dated(s, m, (_f(r) / _f(p) - 1) / _frac(s, m, b)))
add("ACCRINTM", 3, 5, lambda i, s, r, p=lit(1000.0), b=lit(0): _dated(i, s, _f(p) * _f(r) * _frac(i, s, b)))
add("PRICEMAT", 5, 6, lambda s, m, i, r, y, b=lit(0): _dated(s, m, 100 * (1 + _frac(i, m, b) * _f(r)) / (1 + _frac(s, m, b) * _f(y)) - 100 * _frac(i, s, b) * _f(r)))
add("YIELDMAT", 5, 6, lambda s, m, i, r, p, b=lit(0): _dated(s, m, ((1 + _frac(i, m, b) * _f(r)) / (_f(p) / 100 + _frac(i, s, b) * _f(r)) - 1) / _frac(s, m, b)))
_bill = lambda s, m, v: when((as_date(s) < as_date(m)) & (as_date(m) <= F.add_months(as_date(s), 12)), finite(v))
_dsm = lambda s, m: F.datediff(as_date(m), as_date(s)).cast("double")
add("TBILLPRICE", 3, 3, lambda s, m, d: _bill(s, m, when(100 * (1 - _f(d) * _dsm(s, m) / 360) > 0, 100 * (1 - _f(d) * _dsm(s, m) / 360))))
add("TBILLYIELD", 3, 3, lambda s, m, p: _bill(s, m, (100 - _f(p)) / _f(p) * 360 / _dsm(s, m)))


def _tbilleq(s, m, d):
    n, d = _dsm(s, m), _f(d)
    price = (100 - d * 100 * n / 360) / 100
    days = when(n == 366, lit(366.0)).otherwise(lit(365.0))
    term = n / days
    long = (-2 * term + 2 * F.sqrt(term * term - (2 * term - 1) * (1 - 1 / price))) / (2 * term - 1)
    return _bill(s, m, when(n <= 182, 365 * d / (360 - d * n)).otherwise(long))


add("TBILLEQ", 3, 3, _tbilleq)

# ---- complex numbers that need no kernel, addresses
_COMPLEX = r"^([+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?(?![0-9.]*[ij]))?(?:([+-]?[0-9.]*(?:[eE][+-]?[0-9]+)?)[ij])?$"


def complex_parts(c: Column) -> tuple[Column, Column]:
    t = c.cast("string")
    im = F.regexp_extract(t, _COMPLEX, 2)
    has = t.rlike("[ij]$")
    re_ = F.regexp_extract(t, _COMPLEX, 1)
    good = t.rlike(_COMPLEX) & (t != "")
    i = when(~has, lit(0.0)).when(im.isin("", "+"), lit(1.0)).when(im == "-", lit(-1.0)).otherwise(im.try_cast("double"))
    return when(good, F.coalesce(re_.try_cast("double"), lit(0.0))), when(good, i)


add("IMREAL", 1, 1, lambda c: complex_parts(c)[0])
add("IMAGINARY", 1, 1, lambda c: complex_parts(c)[1])
add("IMABS", 1, 1, lambda c: F.hypot(*complex_parts(c)))
add("IMARGUMENT", 1, 1, lambda c: when(F.hypot(*complex_parts(c)) != 0, F.atan2(complex_parts(c)[1], complex_parts(c)[0])))


def _address(r, c, kind=lit(1), a1=lit(True), sheet=None):
    row, col = trunc(num(r)).cast("int"), trunc(num(c)).cast("int")
    z = (col - 1).cast("int")
    letter = lambda x: F.char(x + 65)
    name = when(col <= 26, letter(z)).when(col <= 702, F.concat(letter(F.floor((z - 26) / 26)), letter(F.pmod(z - 26, lit(26))))).otherwise(F.concat(letter(F.floor((z - 702) / 676)), letter(F.pmod(F.floor((z - 702) / 26), lit(26))), letter(F.pmod(z - 702, lit(26)))))
    k = num(kind)
    fixed_row, fixed_col = k.isin(1, 2), k.isin(1, 3)
    plain = F.concat(when(fixed_col, lit("$")).otherwise(lit("")), name, when(fixed_row, lit("$")).otherwise(lit("")), row.cast("string"))
    r1c1 = F.concat(lit("R"), when(fixed_row, row.cast("string")).otherwise(F.concat(lit("["), row.cast("string"), lit("]"))), lit("C"), when(fixed_col, col.cast("string")).otherwise(F.concat(lit("["), col.cast("string"), lit("]"))))
    out = when((row >= 1) & (col >= 1) & (row <= 1048576) & (col <= 16384) & k.between(1, 4), when(a1.cast("boolean"), plain).otherwise(r1c1))
    return out if sheet is None else F.concat(sheet, lit("!"), out)


add("ADDRESS", 2, 5, _address)
