"""Criteria texts as predicates: `>=25`, `<>x`, `ab*`, a number, a logical, or nothing (blank)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comparison signs, longer ones first.
_SIGNS = ("<>", "<=", ">=", "<", ">", "=")


def wildcard(pattern: str) -> str:
    """A regular expression for `*`, `?` and `~` escapes, over lower-cased text."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern) and pattern[i + 1] in "*?~":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"*": "[\\s\\S]*", "?": "[\\s\\S]"}.get(c) or re.escape(c)
        i += 1
    return "^" + out + "$"


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def criterion(column: Column | str, value, kind: str = "any") -> Column:
    """A predicate, never NULL. kind: number, text or any, as the column's type is known or not."""
    c = F.col(column) if isinstance(column, str) else column
    no = lambda p: F.coalesce(p, F.lit(False))
    if isinstance(value, bool):
        return no(c.cast("string") == str(value).lower())
    if isinstance(value, (int, float)):
        return no(c.try_cast("double") == float(value))
    if value is None:
        return no(c.cast("string").isNull() | (c.cast("string") == ""))
    sign = next((s for s in _SIGNS if value.startswith(s)), "")
    rest = value[len(sign) :]
    n = _number(rest.strip()) if rest.strip() else None
    if sign in ("", "=", "<>"):
        if rest == "":
            same = c.isNull() | (c.cast("string") == "")
        elif n is not None:
            same = c.try_cast("double") == n
        elif rest.lower() in ("true", "false"):
            same = F.lower(c.cast("string")) == rest.lower()
        elif re.search(r"[*?~]", rest):
            same = F.lower(c.cast("string")).rlike(wildcard(rest.lower()))
        else:
            same = F.lower(c.cast("string")) == rest.lower()
        return ~no(same) if sign == "<>" else no(same)
    left, right = (c.try_cast("double") if kind != "number" else c, F.lit(n)) if n is not None else (F.lower(c.cast("string")), F.lit(rest.lower()))
    return no({"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[sign])


def criteria(*pairs) -> Column:
    """All of (column, criterion, column, criterion, ...)."""
    if not pairs or len(pairs) % 2:
        raise ValueError("criteria come in pairs of a column and a criterion")
    out = criterion(pairs[0], pairs[1])
    for c, v in zip(pairs[2::2], pairs[3::2], strict=True):
        out = out & criterion(c, v)
    return out


def block(rows: list[dict]) -> Column:
    """A criteria block: rows are alternatives, a row's columns must all hold; a bare text matches as a prefix; a row without conditions matches all."""
    if not rows:
        raise ValueError("a criteria block needs a row")
    out = F.lit(False)
    for row in rows:
        own = F.lit(True)
        for name, value in row.items():
            if value is None or value == "":
                continue
            bare = isinstance(value, str) and not value.startswith(("<", ">", "=")) and _number(value) is None
            own = own & criterion(name, value + "*" if bare else value)
        out = out | own
    return out
