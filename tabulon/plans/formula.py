"""Formula texts to Catalyst plans: a lexer, an operator-precedence parser, and the lowering to Columns.

A formula is over one table. `[@name]` or a bare column name is the row's own value, `[name]` or `Table[name]` the whole
column, which only aggregates take. `calculate` adds row formulas, which may use each other; `evaluate` gives one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.registry import FUNCTIONS, function
from tabulon.operators.criteria import criterion

ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#CALC!", "#SPILL!")


class FormulaError(ValueError):
    """A formula that can't be planned: its text, a name it uses, or a cycle."""


@dataclass(frozen=True)
class Node:
    kind: str  # number, text, logical, error, row, column, call, unary, binary, percent, array
    value: object = None
    args: tuple = ()


_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<text>"(?:[^"]|"")*")|(?P<error>\#[A-Z0-9/]+[!?]?)
    |(?P<row>\[@\[?[^\[\]]+\]?\])|(?P<column>(?:[A-Za-z_]\w*)?\[[^\[\]@]+\])|(?P<name>[A-Za-z_][\w.]*)|(?P<op><>|<=|>=|[-+*/^&=<>%(),;{}]))""",
    re.X,
)
_BINARY = {"=": 1, "<>": 1, "<": 1, "<=": 1, ">": 1, ">=": 1, "&": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 5}


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        body = text.strip().removeprefix("=")
        while at < len(body.rstrip()):
            m = _TOKEN.match(body, at)
            if not m:
                raise FormulaError(f"unexpected {body[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def next(self, wanted: str | None = None):
        kind, text = self.peek()
        if kind is None or (wanted and text != wanted):
            raise FormulaError(f"expected {wanted or 'more'}, found {text!r}")
        self.at += 1
        return kind, text

    def expression(self, least: int = 0, depth: int = 0) -> Node:
        if depth > 256:
            raise FormulaError("nested too deep")
        kind, text = self.next()
        if text in ("-", "+") and kind == "op":
            left = Node("unary", text, (self.expression(6, depth + 1),))  # binds tighter than ^
        elif text == "(":
            left = self.expression(0, depth + 1)
            self.next(")")
        elif text == "{":
            items = [self.expression(0, depth + 1)]
            while self.peek()[1] in (",", ";"):
                self.next()
                items.append(self.expression(0, depth + 1))
            self.next("}")
            left = Node("array", None, tuple(items))
        elif kind == "number":
            left = Node("number", float(text))
        elif kind == "text":
            left = Node("text", text[1:-1].replace('""', '"'))
        elif kind == "error":
            if text not in ERRORS:
                raise FormulaError(text)
            left = Node("error", text)
        elif kind == "row":
            left = Node("row", text[2:-1].strip("[]"))
        elif kind == "column":
            left = Node("column", text[text.index("[") + 1 : -1])
        elif kind == "name":
            if self.peek()[1] == "(":
                self.next()
                args = []
                if self.peek()[1] != ")":
                    args.append(self._argument(depth))
                    while self.peek()[1] == ",":
                        self.next()
                        args.append(self._argument(depth))
                self.next(")")
                left = Node("call", text.upper(), tuple(args))
            else:
                left = Node("logical", text.upper() == "TRUE") if text.upper() in ("TRUE", "FALSE") else Node("row", text)
        else:
            raise FormulaError(f"unexpected {text!r}")
        while True:
            _, text = self.peek()
            if text == "%":
                self.next()
                left = Node("percent", None, (left,))
                continue
            power = _BINARY.get(text)
            if power is None or power <= least:
                return left
            self.next()
            left = Node("binary", text, (left, self.expression(power, depth + 1)))

    def _argument(self, depth):
        return Node("missing") if self.peek()[1] in (",", ")") else self.expression(0, depth + 1)


def parse(text: str) -> Node:
    p = _Parser(text)
    node = p.expression()
    if p.at != len(p.tokens):
        raise FormulaError(f"left over: {p.peek()[1]!r}")
    return node


def names(node: Node) -> set[str]:
    own = {node.value} if node.kind in ("row", "column") else set()
    return own.union(*(names(a) for a in node.args))


def calls(node: Node) -> list[str]:
    own = [node.value] if node.kind == "call" else []
    return own + [c for a in node.args for c in calls(a)]


def capabilities(texts: list[str]) -> list[tuple[str, str, str]]:
    """(formula, status, detail): supported, or what stands against planning it."""
    out = []
    function("ABS")
    for text in texts:
        try:
            unknown = sorted({c for c in calls(parse(text)) if c.removeprefix("_XLFN.") not in FUNCTIONS})
            out.append((text, "unsupported" if unknown else "supported", ", ".join(unknown)))
        except FormulaError as e:
            out.append((text, "syntax", str(e)))
    return out


#: Functions whose last arguments are numbers of the plan.
_NUMBERS_LAST = {"T.TEST": 2, "TTEST": 2}
_RAW = {"SUMIFS", "AVERAGEIFS", "MINIFS", "MAXIFS", "COUNTIFS", "COUNTIF", "SUMIF", "AVERAGEIF"}


def lower(node: Node, df: DataFrame) -> Column:
    """The Column of a node over df; a value that is an error is NULL."""
    kinds = dict(df.dtypes)

    def is_text(n: Node) -> bool:
        return n.kind == "text" or n.kind in ("row", "column") and kinds.get(n.value) == "string"

    def number(n: Node) -> Column:
        c = lower(n, df)
        if is_text(n):
            return F.coalesce(c.try_cast("double"), F.when(_filled(n, F.when(c.isNotNull(), F.lit(False)), F.lit(True), df), F.lit(0.0)))
        return _filled(n, c.cast("double"), F.lit(0.0), df)

    if node.kind in ("number", "text", "logical"):
        return F.lit(node.value)
    if node.kind in ("error", "missing"):
        return F.lit(None)
    if node.kind in ("row", "column"):
        if node.value not in df.columns:
            raise FormulaError(f"#NAME? {node.value}")
        return F.col(f"`{node.value}`")
    if node.kind == "array":
        return F.array(*[lower(a, df) for a in node.args])
    if node.kind == "unary":
        return -number(node.args[0]) if node.value == "-" else number(node.args[0])
    if node.kind == "percent":
        return number(node.args[0]) / 100
    if node.kind == "binary":
        a, b = node.args
        if node.value == "&":
            return F.concat(*[F.coalesce(lower(x, df).cast("string"), F.lit("")) for x in node.args])
        if node.value in ("=", "<>", "<", "<=", ">", ">="):
            x, y = lower(a, df), lower(b, df)
            if is_text(a) or is_text(b):
                x, y = (_filled(n, F.lower(c.cast("string")), F.lit(""), df) for n, c in ((a, x), (b, y)))
            else:
                x, y = (_filled(n, c, F.lit(0), df) if kinds.get(n.value) in _NUMBERS else c for n, c in ((a, x), (b, y)))
            return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[node.value]
        x, y = number(a), number(b)
        if node.value == "/":
            return F.try_divide(x, y)
        if node.value == "^":
            return FUNCTIONS["POWER"](x, y) if function("POWER") else x
        return {"+": x + y, "-": x - y, "*": x * y}[node.value]
    if node.value in _ERROR_TESTS:
        if len(node.args) != (2 if node.value in ("IFERROR", "IFNA") else 1):
            raise FormulaError(f"arguments of {node.value}")
        return _error_test(node, df)
    try:
        f = function(node.value)
    except KeyError:
        raise FormulaError(f"unsupported function {node.value}") from None
    if node.value in _RAW:
        plain = [a.value if a.kind in ("number", "text", "logical", "row", "column") else lower(a, df) for a in node.args]
        return f(*plain)
    if node.value == "SUBTOTAL":
        return f.build(node.args[0].value, lower(node.args[1], df))
    if node.value in _NUMBERS_LAST:
        k = _NUMBERS_LAST[node.value]
        return f(*[lower(a, df) for a in node.args[:k]], *[a.value for a in node.args[k:]])
    if node.value == "INDEX" and len(node.args) == 2:  # of an array, from 1
        return F.get(lower(node.args[0], df), number(node.args[1]).cast("int") - 1)
    if f.kind == "table":
        raise FormulaError(f"{node.value} takes tables: call the operator")
    if f.kind == "aggregate" and f.most == 255 and node.value != "SUMPRODUCT":  # a constant counts once, not once a row
        constants = [a.value for a in node.args if a.kind == "number"]
        if constants and len(constants) < len(node.args):
            if f.name != "SUM":
                raise FormulaError(f"{node.value} of columns and constants")
            return f(*[lower(a, df) for a in node.args if a.kind not in ("missing", "number")]) + F.lit(sum(constants))
    plain = [a for a in node.args if a.kind != "missing"]
    if f.kind == "scalar" and node.value not in _KEEP_BLANKS:  # a blank number is 0
        return f(*[_filled(a, lower(a, df), F.lit(0), df) if kinds.get(a.value if a.kind == "row" else None) in _NUMBERS else lower(a, df) for a in plain])
    return f(*[lower(a, df) for a in plain])


#: Types of number columns.
_NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}
#: Functions that tell blanks from zeros.
_KEEP_BLANKS = {"ISBLANK", "ISNUMBER", "ISTEXT", "ISNONTEXT", "ISLOGICAL", "TYPE", "T", "IF", "IFS", "SWITCH", "CHOOSE", "CONCAT", "CONCATENATE", "TEXTJOIN", "LEN", "EXACT"}
_ERROR_TESTS = {"IFERROR", "IFNA", "ISERROR", "ISERR", "ISNA", "ISBLANK", "ERROR.TYPE"}
#: The column that holds the error of a formula's column.
_ERROR_OF = "{}!error"
# The numbers of errors, and the errors of functions whose arguments are outside their domain (#NUM! for others).
_CODES = {"#NULL!": 1, "#DIV/0!": 2, "#VALUE!": 3, "#REF!": 4, "#NAME?": 5, "#NUM!": 6, "#N/A": 7}
_DOMAIN = {
    **dict.fromkeys(("MOD", "QUOTIENT", "ATAN2", "COT", "COTH", "CSC", "CSCH", "SLN"), "#DIV/0!"), **dict.fromkeys(("IFS", "SWITCH", "NA"), "#N/A"),
    **dict.fromkeys(("FIND", "SEARCH", "VALUE", "DATEVALUE", "TIMEVALUE", "LEFT", "RIGHT", "MID", "REPT", "REPLACE", "CHAR", "UNICHAR", "UNICODE", "CHOOSE", "SUBSTITUTE", "ARABIC", "ROMAN", "TEXT"), "#VALUE!"),
}


def _filled(node: Node, c: Column, blank: Column, df: DataFrame) -> Column:
    """The value of a cell, with blank for a blank one; an error stays NULL, and so does what isn't a cell."""
    if node.kind not in ("row", "column"):
        return c
    error = _ERROR_OF.format(node.value)
    return F.when(F.col(f"`{error}`").isNull(), F.coalesce(c, blank)) if error in df.columns else F.coalesce(c, blank)


def fault(node: Node, df: DataFrame) -> Column | None:
    """The error value of a node as text, NULL where it has none; None if it can't have one."""
    first = lambda columns: F.coalesce(*own) if (own := [c for c in columns if c is not None]) else None
    of = lambda n: fault(n, df)
    if node.kind == "error":
        return F.lit(node.value)
    if node.kind in ("row", "column"):
        error = _ERROR_OF.format(node.value)
        return F.col(f"`{error}`") if error in df.columns else None
    args = [of(a) for a in node.args]
    if node.kind == "binary" and node.value in "+-*/^" or node.kind in ("unary", "percent"):
        texts = [F.when(c.isNotNull() & c.try_cast("double").isNull(), F.lit("#VALUE!")) for a in node.args if a.kind in ("row", "text") and (a.kind == "text" or dict(df.dtypes).get(a.value) == "string") for c in [lower(a, df)]]
        own = {"/": "#DIV/0!", "^": "#NUM!"}.get(node.value if node.kind == "binary" else None)
        return first([*args, *texts, F.when(lower(node, df).isNull(), F.lit(own)) if own else None])
    if node.kind != "call":
        return first(args)
    if node.value == "NA":
        return F.lit("#N/A")
    if node.value == "IF":
        none = F.lit(None).cast("string")
        a, b = args[1], args[2] if len(args) > 2 else None
        branch = F.when(lower(node.args[0], df).cast("boolean"), none if a is None else a).otherwise(none if b is None else b)
        return first([args[0], branch])
    if node.value in ("IFERROR", "IFNA"):
        if args[0] is None:
            return None
        caught = args[0].isNotNull() if node.value == "IFERROR" else args[0] == "#N/A"
        return F.when(caught, F.lit(None).cast("string") if args[1] is None else args[1]).otherwise(args[0])
    if node.value == "ERROR.TYPE":
        return F.lit("#N/A") if args[0] is None else F.when(args[0].isNull(), F.lit("#N/A"))
    if node.value in _ERROR_TESTS:
        return None
    f = function(node.value)
    if f.kind == "aggregate":
        return first([F.max(c) for c in args if c is not None] + ([F.when(lower(node, df).isNull(), F.lit("#DIV/0!"))] if node.value.startswith(("AVERAGE", "STDEV", "VAR")) else []))
    return first([*args, F.when(lower(node, df).isNull(), F.lit(_DOMAIN.get(f.name, "#NUM!")))]) if f.kind == "scalar" and node.value not in _KEEP_BLANKS - {"IFS", "SWITCH", "CHOOSE"} else first(args)


def _error_test(node: Node, df: DataFrame) -> Column:
    """IFERROR, IFNA and the tests: by the error that a value has, not by its being NULL."""
    error, value = fault(node.args[0], df), lower(node.args[0], df)
    if node.value == "ISBLANK":
        blank = value.isNull() if node.args[0].kind in ("row", "column") else F.lit(False)
        return blank if error is None else blank & error.isNull()
    if node.value in ("IFERROR", "IFNA"):
        if error is None:
            return value
        return F.when(error.isNotNull() if node.value == "IFERROR" else F.coalesce(error == "#N/A", F.lit(False)), lower(node.args[1], df)).otherwise(value)
    if error is None:
        return F.lit(None).cast("double") if node.value == "ERROR.TYPE" else F.lit(False)
    if node.value == "ERROR.TYPE":
        return F.coalesce(*[F.when(error == text, F.lit(float(k))) for text, k in _CODES.items()])
    is_na = F.coalesce(error == "#N/A", F.lit(False))
    return {"ISERROR": error.isNotNull(), "ISERR": error.isNotNull() & ~is_na, "ISNA": is_na}[node.value]


def calculate(df: DataFrame, formulas: dict[str, str], errors: bool = False) -> DataFrame:
    """df with a column for each formula; formulas may use each other in any order, but not in a cycle.

    An error is NULL, as a blank is; with errors, a column `name!error` says which error it is (NULL for none).
    """
    nodes = {n: parse(t) for n, t in formulas.items()}
    waiting, done, told = dict(nodes), df, []
    while waiting:
        ready = [n for n, node in waiting.items() if not (names(node) & set(waiting))]
        if not ready:
            raise FormulaError(f"circular reference: {', '.join(sorted(waiting))}")
        values = {n: lower(waiting[n], done) for n in ready}
        found = {_ERROR_OF.format(n): c for n in ready if (c := fault(waiting[n], done)) is not None}
        needed = {v for node in waiting.values() for v in names(node)}  # by formulas that follow
        for n in ready:
            del waiting[n]
        found = {n: c for n, c in found.items() if errors or n.removesuffix("!error") in needed}
        told += found
        done = done.withColumns({**values, **found})
    return done if errors else done.drop(*told)


def evaluate(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """One row with the value of each formula over whole columns."""
    return df.agg(*[lower(parse(t), df).alias(n) for n, t in formulas.items()])


__all__ = ["FormulaError", "calculate", "calls", "capabilities", "criterion", "evaluate", "lower", "names", "parse"]
