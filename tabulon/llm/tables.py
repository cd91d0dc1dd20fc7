"""Shared folder, written tables and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local master may go without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.gettempdir()}/tabulon-shared"
    return folder.rstrip("/")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB instead of Spark's default of 64, of which a task holds several copies; a value that was set stays."""
    if spark.conf.get(_BATCH) in ("64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(_BATCH, "4m")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The DataFrame, written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The written DataFrame and its path, for drop() when nothing reads it any more."""
    return _stored(df, name)[:2]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, str, dict]:
    """The written DataFrame, its path, and sums over its rows, taken by the job that writes.

    The job's shuffle files go when it ends, as nothing reads them again; else they stay until the driver happens to
    collect its garbage.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    seen = Observation()
    out = df.observe(seen, *[F.sum(c).alias(n) for n, c in counts.items()]) if counts else df
    cleanup = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        out.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if cleanup is None else spark.conf.set(_CLEANUP, cleanup)
    return spark.read.schema(df.schema).parquet(path), path, {n: v or 0 for n, v in seen.get.items()} if counts else {}


def _delete(session: SparkSession, path: str) -> None:
    p = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        _delete(spark, path)
        _made.remove((spark, path))


def drop_written(spark: SparkSession | None = None) -> None:
    """Delete what written() has made; call it when results are stored elsewhere. Runs when Python ends, too."""
    for session, path in _made[:]:
        if spark is None or session is spark:
            _made.remove((session, path))
            try:
                _delete(session, path)
            except Exception:  # noqa: BLE001  the session is gone; nothing else to do
                return


atexit.register(drop_written)


def bounded_broadcast(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """The DataFrame with a broadcast hint if its counted rows fit limit bytes, else as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(limit // row_bytes + 1).count() * row_bytes <= limit else df


def rows_among(df: DataFrame, column: str, keys: DataFrame, inside: bool = True, limit: int = 32 << 20) -> DataFrame:
    """The rows of df whose key in the column (a long, not null) is one of keys' (a column of that name), or is none of them.

    Keys count up from a few numbers, as rows of partitions do: they are broadcast as a bit each, so df stays in place;
    beyond limit bytes of bitmaps it is a shuffled join.
    """
    at = lambda c: F.shiftright(c, 15)
    bits = keys.select(at(column).alias("__at"), F.col(column).bitwiseAND(F.lit(32767)).alias("__bit")).repartition("__at").groupBy("__at").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    bits = written(bits, "row-bits")
    if bits.limit(limit // 4200 + 1).count() * 4200 > limit:
        return df.join(keys.select(column).distinct(), column, "left_semi" if inside else "left_anti")
    there = F.expr(f"shiftright(cast(conv(hex(substring(__bits, cast(shiftright(`{column}` & 32767, 3) as int) + 1, 1)), 16, 10) as int), cast(`{column}` & 7 as int)) & 1 = 1")
    both = df.join(F.broadcast(bits), at(column) == F.col("__at"), "inner" if inside else "left")
    return both.where(there if inside else ~F.coalesce(there, F.lit(False))).select(*[F.col(f"`{c}`") for c in df.columns])


def contract(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Edges as stars: every node that isn't the least of its connected nodes, and that least node."""
    both = pa.concat_arrays([a, b]).dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = rank[both.indices.to_numpy()]
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(order))
    while len(x):
        x, y = least[x], least[y]
        open_ = x != y
        x, y = x[open_], y[open_]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := least[least], least):
            least = further
    moved = np.flatnonzero(least != np.arange(len(least)))
    return both.dictionary.take(pa.array(order[moved])), both.dictionary.take(pa.array(order[least[moved]]))


def _starring(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from edges (a, b) to a, b and foreign of their stars; see stars()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def give():
            table = pa.Table.from_batches(held).combine_chunks()
            own = table.column("a").combine_chunks()
            a, b = contract(own, table.column("b").combine_chunks())
            foreign = pc.cast(pc.invert(pc.is_in(a, own)), pa.int64())
            for k in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([a.slice(k, 1 << 16), b.slice(k, 1 << 16), foreign.slice(k, 1 << 16)], ["a", "b", "foreign"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size > 1 << 20 and not whole:
                yield from give()
                held, size = [], 0
        if held:
            yield from give()

    return run


def stars(edges: DataFrame, whole: bool = False) -> DataFrame:
    """a, b and foreign of each task's edges as stars. whole: a task's edges at once, else in runs, to shorten what is shuffled.

    foreign: a is no larger end of the task's own edges, so the edge is news for the task that has a's edges.
    """
    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").mapInArrow(_starring(whole), f"a {kind}, b {kind}, foreign long")


def stars_made(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The stars of the edges (a, b, longs) that a mapInArrow function makes of df, by one worker a task instead of two in a row."""
    run = _starring(False)
    return df.mapInArrow(lambda batches: run(work(batches)), "a long, b long, foreign long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b): node and component, the least node reachable, of every node of an edge but loops.

    Edges with a column foreign are what stars() or stars_made() gave.
    Each round deals the edges by their larger end and makes every task's edges stars, so a node keeps one edge and what
    its neighbours have in common goes to them; when that brings nothing new, nodes are hung to their parents' parents,
    until all hang on roots. Tasks hold a share of the edges, however large a component is: edges go by their larger
    end, of which a task that made stars has left one. Rounds grow with the logarithm of a component's length. The job
    that writes a round also counts its changes; the round before is deleted.
    """
    spark = edges.sparkSession
    e, path, seen = _stored(edges if "foreign" in edges.columns else stars(edges.where("a <> b")), name, n=F.lit(1))
    fresh = 0
    while seen["n"]:
        new, new_at, seen = _stored(stars(e.repartition("a"), whole=True), name, n=F.lit(1), foreign=F.col("foreign"))
        _delete(spark, path)
        e, path, fresh = new, new_at, fresh + 1
        if seen["foreign"] and fresh < 3:
            continue
        fresh, foreign = 0, seen["foreign"]
        up = e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("c"))
        if seen["n"] * 64 <= 32 << 20:  # a bound of the rows, as they were counted
            up = F.broadcast(up)
        jump = e.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().cast("long").alias("moved"))
        new, new_at, seen = _stored(jump, name, n=F.lit(1), moved=F.col("moved"))
        _delete(spark, path)
        e, path = new, new_at
        if not foreign and not seen["moved"]:
            break
    star = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())
