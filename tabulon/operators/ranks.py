"""Ranks over a whole column, and predictions of a regression, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.aggregates import linest, num


def rank(df: DataFrame, value: str, name: str = "rank", ascending: bool = False, ranges: int = 200) -> DataFrame:
    """df with the rank (from 1) of every value of a numeric column among all; equal values share the least, null has none.

    Equal values are counted first, so a frequent value is one row. The distinct values are dealt to ranges by quantiles
    of the column; a range's ranks begin behind the counts of the ranges before it, one row a range.
    """
    inner = df.approxQuantile(value, [i / ranges for i in range(1, ranges)], 0.5 / ranges)
    bounds = F.array(*[F.lit(float(b)) for b in sorted(set(inner))]).cast("array<double>")
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__range", F.size(F.filter(bounds, lambda b: b <= F.col("__v").cast("double"))))
    down = (lambda c: F.asc(c)) if ascending else (lambda c: F.desc(c))
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.groupBy("__range").agg(F.sum("__n").alias("__n")).select("__range", before(Window.orderBy(down("__range"))).alias("__first"))  # one row a range
    own = counts.select("__v", "__range", before(Window.partitionBy("__range").orderBy(down("__v"))).alias("__own"))
    ranks = own.join(F.broadcast(first), "__range").select("__v", (F.col("__first") + F.col("__own") + 1).alias(name))
    return df.drop(name).join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")


def trend(df: DataFrame, y: str, x: list[str], new: DataFrame | None = None, const: bool = True, name: str = "trend", growth: bool = False) -> DataFrame:
    """new (df itself by default), which has the columns x, with the prediction of the linear regression of y on x in df.

    const: with an intercept, else through the origin. growth: the regression of ln y, its prediction raised to e; a y
    that isn't positive gives NULL, the error. Rows of df with a null are no part of the fit; a null in x predicts NULL.
    """
    target = F.ln(F.col(y)) if growth else F.col(y)
    fit = linest(target, *map(F.col, x), const=const)
    fit = df.agg(F.when(F.min(num(F.col(y))) > 0, fit).alias("__fit") if growth else fit.alias("__fit"))
    out = (df if new is None else new).drop(name).join(F.broadcast(fit))  # one row
    value = F.col("__fit")[len(x)]
    for i, c in enumerate(reversed(x)):
        value = value + F.col("__fit")[i] * num(F.col(c))
    return out.withColumn(name, F.exp(value) if growth else value).drop("__fit")
