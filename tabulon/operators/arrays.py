"""Array shaping on DataFrames: filter, sort, unique, take, stack, reshape, matrices. A DataFrame's row order is a column of unique keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def filter_rows(df: DataFrame, include: Column) -> DataFrame:
    return df.where(F.coalesce(include.cast("boolean"), F.lit(False)))


def sort_keys(df: DataFrame, keys: list[tuple[str, int]], order: str) -> list[Column]:
    """Blanks first going up; text by lower case; ties by row order."""
    out = []
    for name, way in keys:
        c = F.lower(F.col(name)) if dict(df.dtypes)[name] == "string" else F.col(name)
        out.append(c.asc_nulls_first() if way >= 0 else c.desc_nulls_last())
    return [*out, F.col(order)]


def sort(df: DataFrame, keys: list[tuple[str, int]], order: str) -> DataFrame:
    return df.orderBy(*sort_keys(df, keys, order))


def take(df: DataFrame, n: int, keys: list[Column], columns: int | None = None) -> DataFrame:
    """The first n rows by keys, or the last -n; columns likewise. A top-k plan: no full sort."""
    if n == 0:
        raise ValueError("#CALC!")
    flip = [c if isinstance(c, str) else c for c in keys]
    if n < 0:
        flip = [F.desc(c) if isinstance(c, str) else F.desc(c) for c in keys]
    out = df.orderBy(*flip).limit(abs(n))
    names = df.columns if columns is None else df.columns[:columns] if columns > 0 else df.columns[columns:]
    return out.select(*names)


def drop(df: DataFrame, n: int, order: str) -> DataFrame:
    """All but the first n rows by order, or the last -n: an anti join with the few that go."""
    gone = take(df, n, [order]).select(order)
    return df.join(gone, order, "left_anti")


def unique(df: DataFrame, by: list[str], order: str, exactly_once: bool = False) -> DataFrame:
    """First rows of distinct keys (ASCII case doesn't count), or of keys that occur once."""
    fold = [F.translate(F.col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias(f"__{c}") if dict(df.dtypes)[c] == "string" else F.col(c).alias(f"__{c}") for c in by]
    out = df.groupBy(*fold).agg(F.min_by(F.struct(*df.columns), order).alias("r"), F.count(F.lit(1)).alias("n"))
    return (out.where("n = 1") if exactly_once else out).select("r.*")


def choose_columns(df: DataFrame, *index: int) -> DataFrame:
    if any(i == 0 or abs(i) > len(df.columns) for i in index):
        raise ValueError("#VALUE!")
    return df.select(*[df.columns[i - 1 if i > 0 else i] for i in index])


def choose_rows(df: DataFrame, place: str, *index: int) -> DataFrame:
    """Rows by their place column (from 1), negative from the end, in the asked order."""
    size = df.agg(F.max(place)).first()[0] or 0
    wanted = [i if i > 0 else size + 1 + i for i in index]
    if any(not 1 <= i <= size for i in wanted):
        raise ValueError("#VALUE!")
    asked = df.sparkSession.createDataFrame([*enumerate(wanted)], f"__at int, `{place}` long")
    return df.join(F.broadcast(asked), place).orderBy("__at").drop("__at")


def vstack(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by position of columns, padded with NULL."""
    width = max(len(f.columns) for f in frames)
    names = next(f.columns for f in frames if len(f.columns) == width)
    return reduce(DataFrame.union, [f.select(*f.columns, *[F.lit(None).alias(n) for n in names[len(f.columns) :]]).toDF(*names) for f in frames])


def hstack(left: DataFrame, right: DataFrame, place: str) -> DataFrame:
    """Columns of both by the place column they share, padded with NULL."""
    return left.join(right, place, "full_outer")


def expand(df: DataFrame, place: str, rows: int, pad=None) -> DataFrame:
    """Rows up to a place, those added filled with pad."""
    every = df.sparkSession.range(1, rows + 1).withColumnRenamed("id", place)
    out = every.join(df.withColumn("__there", F.lit(True)), place, "left")
    return out.select(place, *[F.when(F.col("__there"), F.col(c)).otherwise(F.lit(pad)).alias(c) for c in df.columns if c != place])


def to_column(df: DataFrame, place: str, columns: list[str], ignore: int = 0, by_column: bool = False) -> DataFrame:
    """One column `value` with its new place order (major, minor); ignore 1 leaves blanks out."""
    parts = F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).alias("value")) for i, n in enumerate(columns)])
    out = df.select(F.col(place).alias("__r"), F.explode(parts).alias("x")).select("__r", "x.c", "x.value")
    out = out.where("value is not null") if ignore in (1, 3) else out
    return out.select(*([F.col("c").cast("long").alias("major"), F.col("__r").cast("long").alias("minor")] if by_column else [F.col("__r").cast("long").alias("major"), F.col("c").cast("long").alias("minor")]), "value")


def wrap_rows(df: DataFrame, place: str, value: str, width: int) -> DataFrame:
    """A vector as rows of a width: row, c1, ... cw; missing cells are NULL."""
    at = F.col(place) - 1
    cells = df.select((F.floor(at / width) + 1).alias("row"), (at % width + 1).alias("c"), F.col(value).alias("v"))
    return cells.groupBy("row").agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(f"c{i}") for i in range(1, width + 1)])


def wrap_columns(df: DataFrame, place: str, value: str, height: int, columns: int) -> DataFrame:
    at = F.col(place) - 1
    cells = df.select((at % height + 1).alias("row"), (F.floor(at / height) + 1).alias("c"), F.col(value).alias("v"))
    return cells.groupBy("row").agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(f"c{i}") for i in range(1, columns + 1)])


def sequence(spark: SparkSession, rows: int, columns: int = 1, start: float = 1, step: float = 1) -> DataFrame:
    ids = spark.range(rows)
    return ids.select((F.col("id") + 1).alias("row"), *[(F.lit(float(start)) + (F.col("id") * columns + c) * float(step)).alias(f"c{c + 1}") for c in range(columns)])


def munit(spark: SparkSession, n: int) -> DataFrame:
    """The identity as cells (i, j, v) that aren't zero."""
    return spark.range(1, n + 1).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def mmult(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two matrices of cells (i, j, v): a join on the inner index and a partial sum."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("j2"), F.col("v").alias("w"))
    return a.withColumnRenamed("j", "k").join(right, "k").groupBy("i", F.col("j2").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def minverse(a: DataFrame, limit: int = 2000) -> DataFrame:
    """The inverse of a square matrix of cells, of at most limit rows; a singular one gives no rows."""
    import numpy as np
    import pandas as pd

    if a.agg(F.max("i")).first()[0] > limit:
        raise ValueError(f"more than {limit} rows")

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["i"].max())
        m = np.zeros((n, n))
        m[pdf["i"] - 1, pdf["j"] - 1] = pdf["v"]
        if np.linalg.matrix_rank(m) < n:
            return pd.DataFrame({"i": [], "j": [], "v": []}).astype({"i": int, "j": int, "v": float})
        inverse = np.linalg.inv(m)
        i, j = np.indices((n, n))
        return pd.DataFrame({"i": i.ravel() + 1, "j": j.ravel() + 1, "v": inverse.ravel()})

    return a.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double")).groupBy().applyInPandas(invert, "i long, j long, v double")


def scan(df: DataFrame, value: str, order: str, partition: list[str] | None = None, out: str = "running") -> DataFrame:
    """The running sum in row order, within partitions."""
    w = Window.partitionBy(*(partition or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))
