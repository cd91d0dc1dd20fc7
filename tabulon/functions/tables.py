"""Functions that take and give tables, as operators on DataFrames, and lambdas over arrays and columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.functions.registry import FUNCTIONS, Function
from tabulon.operators import arrays, grouping, lookup, ranks




class _Plain(Function):
    def __call__(self, *args, **options):
        return self.build(*args, **options)


for name, build in {
    "FILTER": arrays.filter_rows, "SORT": arrays.sort, "SORTBY": arrays.sort, "UNIQUE": arrays.unique, "TAKE": arrays.take, "DROP": arrays.drop,
    "CHOOSECOLS": arrays.choose_columns, "CHOOSEROWS": arrays.choose_rows, "VSTACK": arrays.vstack, "HSTACK": arrays.hstack, "EXPAND": arrays.expand,
    "TOCOL": arrays.to_column, "TOROW": arrays.to_column, "WRAPROWS": arrays.wrap_rows, "WRAPCOLS": arrays.wrap_columns, "SEQUENCE": arrays.sequence,
    "MUNIT": arrays.munit, "MMULT": arrays.mmult, "TRANSPOSE": arrays.transpose, "MINVERSE": arrays.minverse, "SCAN": arrays.scan,
    "GROUPBY": grouping.groupby, "PIVOTBY": grouping.pivotby, "XLOOKUP": lookup.xlookup, "XMATCH": lookup.match, "MATCH": lookup.match,
    "VLOOKUP": lookup.vlookup, "HLOOKUP": lookup.hlookup, "LOOKUP": lookup.lookup,
    **{n: (lambda df, field, rows, n=n: grouping.database(df, n, field, rows)) for n in (*grouping._DATABASE, "DGET", "DCOUNTA")},
    "INDEX": lambda df, place, row, column: df.where(F.col(place) == row).select(df.columns[column - 1]),
    "ROWS": lambda df: df.count(), "COLUMNS": lambda df: len(df.columns),
    "MAP": lambda a, f: F.transform(a, f), "REDUCE": lambda start, a, f: F.aggregate(a, start, f), "LET": lambda value, body: body(value),
    "LAMBDA": lambda f: f, "BYROW": lambda columns, f: f(F.array(*columns)), "BYCOL": lambda columns, f: [f(F.col(c)).alias(c) for c in columns],
    "MAKEARRAY": lambda rows, columns, f: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(rows)), lambda r: F.transform(F.sequence(F.lit(1), F.lit(columns)), lambda c: f(r, c)))),
    "LARGE": lambda df, value, k: df.where(F.col(value).isNotNull()).orderBy(F.desc(value)).limit(k).agg(F.min(value).alias("value")),
    "SMALL": lambda df, value, k: df.where(F.col(value).isNotNull()).orderBy(value).limit(k).agg(F.max(value).alias("value")),
    "RANK.EQ": lambda df, value, order=0: ranks.rank(df, value, ascending=bool(order)),
    "TREND": ranks.trend, "GROWTH": lambda df, y, x, new=None, const=True, name="growth": ranks.trend(df, y, x, new, const, name, growth=True),
    "PERCENTRANK.INC": lambda value, digits=3: F.floor(F.percent_rank().over(Window.orderBy(value)) * 10**digits + 1e-9) / 10**digits,
    "AVEDEV": lambda df, value: df.join(F.broadcast(df.agg(F.avg(value).alias("__m")))).agg(F.avg(F.abs(F.col(value) - F.col("__m"))).alias("value")),
    "OFFSET": lambda value, order, rows: F.lag(value, -rows).over(Window.orderBy(order)),
}.items():
    FUNCTIONS[name] = _Plain(name, "table", 1, 255, build)
for alias, name in {"RANK": "RANK.EQ", "PERCENTRANK": "PERCENTRANK.INC"}.items():
    FUNCTIONS[alias] = FUNCTIONS[name]
