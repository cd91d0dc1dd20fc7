"""Lookups as joins: exact, first or last match, next smaller or larger, wildcard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Rows of a side that may be broadcast for a wildcard join; beyond it the join is refused, as it would be a product.
PATTERNS = 10_000


def _folded(df: DataFrame, name: str):
    return F.lower(F.col(name)) if dict(df.dtypes)[name] == "string" else F.col(name)


def xlookup(probes: DataFrame, key: str, table: DataFrame, table_key: str, returns: list[str], order: str, match: int = 0, search: int = 1, missing=None) -> DataFrame:
    """probes with the returned columns of each probe's match in table; order is the table's unique column of row order.

    match 0: equal, 1: else the next larger, -1: else the next smaller, 2: the table's keys match the probe's wildcards.
    search 1: the first match in order, -1: the last. A probe without a match, or a null one, gets missing.
    """
    table = table.select(_folded(table, table_key).alias("__k"), F.col(order).alias("__o"), *[F.col(r).alias(f"__r{i}") for i, r in enumerate(returns)]).where("__k is not null")
    pick = F.min_by if search > 0 else F.max_by
    picked = F.struct(*[f"__r{i}" for i in range(len(returns))])
    one = table.groupBy("__k").agg(pick(picked, "__o").alias("__v"))  # partial aggregates: a frequent key is no hot spot
    probes = probes.withColumn("__p", _folded(probes, key))
    if match == 0:
        found = probes.join(one.withColumnRenamed("__k", "__p"), "__p", "left")
    elif match == 2:
        found = _wildcards(probes, one)
    else:
        found = asof(probes, "__p", one.withColumnRenamed("__k", "__key"), "__key", "__v", below=match < 0)
    columns = [c for c in probes.columns if c != "__p"]
    out = [F.when(F.col("__v").isNull(), F.lit(missing)).otherwise(F.col(f"__v.__r{i}")).alias(r) if missing is not None else F.col(f"__v.__r{i}").alias(r) for i, r in enumerate(returns)]
    return found.select(*columns, *out)


def _wildcards(probes: DataFrame, one: DataFrame) -> DataFrame:
    from tabulon.operators.criteria import wildcard

    patterns = [r[0] for r in probes.select("__p").where("__p is not null").distinct().limit(PATTERNS + 1).collect()]
    if len(patterns) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns")
    table = one.sparkSession.createDataFrame([(p, wildcard(p)) for p in patterns], "__p string, __w string")
    hits = one.join(F.broadcast(table), F.expr("__k rlike __w")).groupBy("__p").agg(F.min_by("__v", "__k").alias("__v"))
    return probes.join(hits, "__p", "left")


def asof(probes: DataFrame, key: str, table: DataFrame, table_key: str, value: str, below: bool = True, ranges: int = 200) -> DataFrame:
    """probes with value of the greatest table_key up to key (below) or the least from key on.

    Both sides are dealt to ranges of the key, so each range is one sorted pass; what a range needs from its
    neighbours, the nearest key of an earlier range, is one row a range. The ranges' bounds are drawn once and are
    constants of the plan: bounds that Spark draws (repartitionByRange) differ between two readings of the same rows.
    """
    both = probes.select(F.struct(*probes.columns).alias("__row"), F.col(key).alias("__k"), F.lit(1).alias("__side"), F.lit(None).cast(dict(table.dtypes)[value]).alias("__val"))
    both = both.unionByName(table.select(F.lit(None).cast(both.schema["__row"].dataType).alias("__row"), F.col(table_key).alias("__k"), F.lit(0).alias("__side"), F.col(value).alias("__val")))
    null = both.where("__k is null").where("__side = 1")
    both = both.where("__k is not null")
    both = both.withColumn("__part", _range(F.col("__k"), _bounds(both.select("__k"), ranges), both.schema["__k"].dataType))
    direction = F.col("__k") if below else F.col("__k").desc()
    own = Window.partitionBy("__part").orderBy(direction, "__side").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("__near", F.last(F.when(F.col("__side") == 0, F.struct("__k", "__val")), ignorenulls=True).over(own))
    edge = near.groupBy("__part").agg((F.max_by if below else F.min_by)(F.struct("__k", "__val"), F.when(F.col("__side") == 0, F.col("__k"))).alias("__edge"), F.max("__side").alias("__any"), F.max(F.when(F.col("__side") == 0, 1)).alias("__has"))
    edge = edge.withColumn("__edge", F.when(F.col("__has") == 1, F.col("__edge")))
    across = Window.orderBy("__part" if below else F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    edge = edge.withColumn("__edge", F.last("__edge", ignorenulls=True).over(across)).select("__part", "__edge")
    found = near.where("__side = 1").join(F.broadcast(edge), "__part", "left").select("__row", F.coalesce("__near", "__edge").alias("__n"))
    found = found.select("__row.*", F.col("__n.__val").alias("__v"))
    return found.unionByName(null.select("__row.*", F.col("__val").alias("__v")))


def _bounds(keys: DataFrame, ranges: int) -> list:
    """The keys, in order, between ranges of about as many rows each, from a random sample of 20 rows a range."""
    drawn = [r[0] for r in keys.orderBy(F.rand(7)).limit(20 * ranges).orderBy("__k").collect()]
    return list(dict.fromkeys(drawn[i * len(drawn) // ranges] for i in range(1, ranges) if drawn))


def _range(key, bounds: list, kind, step: int = 14):
    """How many of the ascending bounds aren't above key: every step-th is compared, then those of one step."""
    array = lambda values: F.array(*map(F.lit, values)).cast(ArrayType(kind))
    reached = lambda values: F.size(F.filter(values, lambda b: b <= key))
    before = reached(array(bounds[step - 1 :: step])) * step
    return before + reached(F.slice(array(bounds), before + 1, F.lit(step)))


def match(probes: DataFrame, key: str, table: DataFrame, table_key: str, order: str, kind: int = 0) -> DataFrame:
    """probes with position, the place (from 1, by order) of the match: 0 first equal, 1 last not above, -1 last not below."""
    placed = table.select(F.col(table_key), F.col(order), place(F.col(order)).alias("position"))
    return xlookup(probes, key, placed, table_key, ["position"], order, {0: 0, 1: -1, -1: 1}[kind], 1 if kind == 0 else -1)


def place(order) -> F.Column:
    """Place by order. The window has one partition by nature; use it on tables that fit a task, or keep a place column."""
    return F.row_number().over(Window.orderBy(order))


def vlookup(probes: DataFrame, key: str, table: DataFrame, index: int, order: str, approximate: bool = True) -> DataFrame:
    """The index-th column of table for the probe's key in its first column: exact first match, or the last key not above."""
    columns = [c for c in table.columns if c != order]
    if not 1 <= index <= len(columns):
        raise ValueError("#REF!")
    return xlookup(probes, key, table, columns[0], [columns[index - 1]], order, -1 if approximate else 0)


def hlookup(probes: DataFrame, key: str, table: DataFrame, index: int, order: str, approximate: bool = True, name: str = "value") -> DataFrame:
    """probes with the value of the table's index-th row, in the column whose first row has the probe's key.

    Rows are in the order of the column order, which is no part of the table; its other columns are of types with a common
    one. Exact first match, or the last key not above. A table of fewer rows gives NULL.
    """
    columns = [c for c in table.columns if c != order]
    if index < 1:
        raise ValueError("#VALUE!")
    rows = table.orderBy(order).limit(index).withColumn("__place", F.row_number().over(Window.orderBy(order)))  # index rows
    cells = rows.select("__place", F.posexplode(F.array(*columns)).alias("__c", "__v"))
    at = lambda place: F.max(F.when(F.col("__place") == place, F.col("__v")))
    across = cells.groupBy("__c").agg(at(1).alias("__first"), at(index).alias(name))
    return xlookup(probes, key, across, "__first", [name], "__c", -1 if approximate else 0)


def lookup(probes: DataFrame, key: str, table: DataFrame, table_key: str, result: str, order: str) -> DataFrame:
    """The last exact match, else the last smaller key's row."""
    return xlookup(probes, key, table, table_key, [result], order, -1, -1)
