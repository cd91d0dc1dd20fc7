"""GROUPBY, PIVOTBY and the database functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.criteria import block


def _keys(df: DataFrame, fields: list[str], order: str | None) -> tuple[DataFrame, list[Column]]:
    """Text keys fold case; the first label by order is kept, else the least."""
    folded = [F.lower(F.col(f)).alias(f"__k{i}") if dict(df.dtypes)[f] == "string" else F.col(f).alias(f"__k{i}") for i, f in enumerate(fields)]
    return df, folded


def groupby(df: DataFrame, fields: list[str], aggregates: dict[str, Column], depth: int = 1, where: Column | None = None, order: str | None = None) -> DataFrame:
    """One row a group, with a column `level`: 0 details, n a subtotal over the last n fields.

    depth 0 has details alone, 1 the grand total, more also that many less one prefixes of the fields. Aggregates are
    Columns; their partial results make frequent groups no hot spot.
    """
    if abs(depth) > len(fields):
        raise ValueError("#VALUE!")
    df = df if where is None else df.where(where)
    label = lambda f: F.min_by(f, order) if order else F.min(f)
    df, keys = _keys(df, fields, order)
    wide = df.select("*", *keys)
    names = [f"__k{i}" for i in range(len(fields))]
    base = wide.rollup(*names) if depth else wide.groupBy(*names)
    level = F.grouping_id() if depth else F.lit(0)
    out = base.agg(level.alias("__g"), *[label(f).alias(f"__l{i}") for i, f in enumerate(fields)], *[a.alias(n) for n, a in aggregates.items()])
    n = len(fields)
    out = out.withColumn("level", F.when(F.col("__g") == 0, 0).otherwise(F.length(F.bin("__g"))))
    keep = {0, n} if abs(depth) == 1 else {0, n, *range(n - abs(depth) + 1, n)} if depth else {0}
    out = out.where(F.col("level").isin(*keep))
    return out.select(*[F.when(F.col("level") < n - i, F.col(f"__l{i}")).alias(f) for i, f in enumerate(fields)], "level", *aggregates)


def pivotby(df: DataFrame, rows: list[str], column: str, value: str, function: Callable[[Column], Column] = F.sum, values: list | None = None, relative: str | None = None) -> DataFrame:
    """A cross-tab with row totals and a grand total row. relative: column, row or grand shares of sums.

    values: the column labels; without them they are collected, as the header of a cross-tab is part of its schema.
    """
    labels = values if values is not None else [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    if relative is None:
        cells = [function(F.when(F.col(column) == v, F.col(value))).alias(str(v)) for v in labels]
        return df.rollup(*rows).agg(F.grouping_id().alias("level"), *cells, function(F.col(value)).alias("Total")).where(F.col("level").isin(0, 2 ** len(rows) - 1))
    sums = [F.sum(F.when(F.col(column) == v, F.col(value))).alias(f"s{i}") for i, v in enumerate(labels)]
    table = df.groupBy(*rows).agg(*sums, F.sum(value).alias("t"))
    total = df.agg(*[F.sum(F.when(F.col(column) == v, F.col(value))).alias(f"c{i}") for i, v in enumerate(labels)], F.sum(value).alias("g"))
    both = table.join(F.broadcast(total))  # one row
    of = {"column": lambda i: F.col(f"c{i}"), "row": lambda i: F.col("t"), "grand": lambda i: F.col("g")}[relative]
    return both.select(*rows, *[F.try_divide(F.col(f"s{i}"), of(i)).alias(str(v)) for i, v in enumerate(labels)])


#: The aggregates of the database functions, over the field's numbers in selected records.
_DATABASE = {
    "DSUM": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "DAVERAGE": F.avg, "DCOUNT": F.count, "DMAX": lambda c: F.coalesce(F.max(c), F.lit(0.0)),
    "DMIN": lambda c: F.coalesce(F.min(c), F.lit(0.0)), "DPRODUCT": lambda c: F.coalesce(F.product(c), F.lit(0.0)), "DSTDEV": F.stddev_samp,
    "DSTDEVP": F.stddev_pop, "DVAR": F.var_samp, "DVARP": F.var_pop,
}


def database(df: DataFrame, name: str, field: str | None, rows: list[dict], out: str = "value") -> DataFrame:
    """A database function over the records that a criteria block selects; without a field, counts count records."""
    chosen = df.where(block(rows))
    if name == "DGET":
        return chosen.agg(F.when(F.count(F.lit(1)) == 1, F.max(field)).alias(out))
    if name == "DCOUNTA" or field is None:
        return chosen.agg(F.count(F.lit(1) if field is None else F.col(field)).alias(out))
    return chosen.agg(_DATABASE[name](F.col(field).try_cast("double")).alias(out))
