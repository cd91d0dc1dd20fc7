"""Nearest neighbours by cosine with vantage-point trees, one per shard.

Vectors are normalised, so nearness by cosine is nearness by Euclidean distance, a metric. A shard's tree splits its
vectors by their distance from a vantage point and keeps the range of distances on both sides. A search visits the
nearer side first and prunes a side if the triangle inequality, times the relaxation factor, puts it beyond the worst
neighbour found so far: factor 1 is exact, larger factors prune more. All queries of a block go down a tree together.

Every row is indexed, and every shard's tree is built once and written. Every query block meets every tree: the pairs of
blocks are dealt out by their numbers, so neither side is broadcast or gathered; a tree travels once for each block of
8192 queries, a query once for each tree. Equal vectors of a shard are one point with its smallest ids.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.llm.tables import written

#: Rows of a shard (the memory of a task), queries of a block, vectors of a leaf, relaxation of pruning, rows that a block's queries come in.
SHARD, QUERIES, LEAF, FACTOR, PARTS = 8192, 8192, 128, 1.15, 8


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        """ids and original vectors (double) of a shard; k: neighbours asked for."""
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(1)]) if len(ids) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(ids)))
        keep = np.minimum(size, k + 1)  # a query of that vector leaves itself out
        self.ids = ids[np.repeat(start - (np.cumsum(keep) - keep), keep) + np.arange(keep.sum())]
        self.first, self.count = np.cumsum(keep) - keep, keep
        self.raw = vectors[start]
        self.norm = np.sqrt((self.raw * self.raw).sum(1))
        self.unit = self.raw / self.norm[:, None]
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(start)), np.random.default_rng(len(start)))

    def _build(self, rows: np.ndarray, rng) -> int:
        at = len(self.nodes)
        if len(rows) <= LEAF:
            self.nodes.append((None, rows, 0, 0, 0, 0, 0, 0))
            return at
        self.nodes.append(())
        sample = rows[rng.choice(len(rows), 8, replace=False)]
        tries = [np.linalg.norm(self.unit[rows] - self.unit[v], axis=1) for v in sample]
        best = max(range(8), key=lambda i: tries[i].std())
        d = tries[best]
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        bounds = d[near[0]], d[near[-1]], d[far[0]], d[far[-1]]
        self.nodes[at] = (int(sample[best]), None, self._build(rows[near], rng), self._build(rows[far], rng), *map(float, bounds))
        return at

    def closed(self) -> bytes:
        """The tree as bytes: it is built once and sent to the query blocks."""
        return pickle.dumps((self.ids, self.first, self.count, self.raw, self.nodes, self.root), protocol=5)

    @classmethod
    def opened(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.ids, tree.first, tree.count, tree.raw, tree.nodes, tree.root = pickle.loads(data)
        tree.norm = np.sqrt((tree.raw * tree.raw).sum(1))
        tree.unit = tree.raw / tree.norm[:, None]
        return tree

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        """query id, id, score of the k nearest found for every query, the query's own id left out."""
        q_norm = np.sqrt((queries * queries).sum(1))
        unit = queries / q_norm[:, None]
        worst = np.full(len(queries), np.inf)  # distance of the k-th neighbour
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        eps = 1e-7  # distances of rounded unit vectors

        def leaf(rows, active):
            scores = (queries[active] @ self.raw[rows].T) / (q_norm[active][:, None] * self.norm[rows][None, :])
            d = np.sqrt(np.maximum(0, 2 - 2 * scores))
            for i, a in enumerate(active):
                close = np.flatnonzero(d[i] <= worst[a] + eps)
                if not len(close):
                    continue
                if len(close) > 4 * k:  # with ties of the k-th
                    edge = np.partition(scores[i][close], len(close) - 2 * k)[len(close) - 2 * k]
                    close = close[scores[i][close] >= edge]
                points, s = rows[close], scores[i][close]
                size = self.count[points]
                ids = self.ids[np.repeat(self.first[points] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                s = np.repeat(s, size)
                other = ids != query_ids[a]
                ids, s = np.concatenate([found[a][0], ids[other]]), np.concatenate([found[a][1], s[other]])
                order = np.lexsort((ids, -s))[:k]
                found[a] = ids[order], s[order]
                if len(order) == k:
                    worst[a] = np.sqrt(max(0.0, 2 - 2 * s[order[-1]]))

        def visit(node, active):
            if not len(active):
                return
            vantage, rows, near, far, a, b, c, e = self.nodes[node]
            if rows is not None:
                leaf(rows, active)
                return
            d = np.linalg.norm(unit[active] - self.unit[vantage], axis=1)
            gap_near = np.maximum(0, np.maximum(d - b, a - d))
            gap_far = np.maximum(0, np.maximum(d - e, c - d))
            first = gap_near <= gap_far
            for side, node_a, node_b, gap_a, gap_b in ((first, near, far, gap_near, gap_far), (~first, far, near, gap_far, gap_near)):
                own = active[side]
                visit(node_a, own[gap_a[side] * factor <= worst[own] + eps])
                visit(node_b, own[gap_b[side] * factor <= worst[own] + eps])

        if len(self.raw):
            visit(self.root, np.arange(len(queries)))
        n = [len(f[0]) for f in found]
        return np.repeat(query_ids, n), np.concatenate([f[0] for f in found]) if n else np.zeros(0, np.int64), np.concatenate([f[1] for f in found]) if n else np.zeros(0)


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id and vector (array of double) of the rows that take part: vectors without null or non-finite components and not zero."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(fine & F.col(id_column).isNotNull())


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR, id_column: str = "vec_id", vector: str = "embedding", shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query, the k rows found with the largest cosine, its own id left out.

    Equal cosines go by the smaller id. Scores are cosines of the original vectors in double precision. Null vectors,
    zero ones, and those with null or non-finite components take no part, nor do rows without an id; repeated ids with equal vectors count once a row.
    Vectors of another length than the query's are never its neighbours. A query with fewer than k candidates gets all; an empty table gives an empty result.
    """
    rows, queries = usable(rows, id_column, vector), usable(queries, id_column, vector)
    size = F.size("v")
    trees = written(_trees(rows, k, shard), "nearest-trees")
    # a tree goes once to every query block, a query once to every tree: blocks are few, as they grow with the trees
    shards, count = trees.groupBy("n").agg(F.count(F.lit(1)).alias("shards")), queries.groupBy(size.alias("n")).agg(F.count(F.lit(1)).alias("queries"))
    plan = [(r["n"], r["shards"], max(1, -(-r["queries"] // block))) for r in shards.join(count, "n").collect()]  # a row for each length of vectors
    if not plan:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plan = F.broadcast(rows.sparkSession.createDataFrame(plan, "n int, shards long, blocks long"))
    spread = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    asked = queries.withColumn("n", size).join(plan, "n").withColumn("b", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")))
    asked = asked.groupBy("n", "b", "shards", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(PARTS)).alias("p")).agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("vs")).withColumn("s", spread("shards"))
    asked = asked.select("n", "b", "s", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("tree"), "ids", "vs")
    sent = trees.join(plan, "n").withColumn("b", spread("blocks")).select("n", "b", "s", F.lit(0).alias("kind"), "tree", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("array<double>").alias("vs"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, key = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            for i, (n, b, s, kind) in enumerate(keys):
                if kind == 0:
                    tree, key = Tree.opened(batch.column(4)[i].as_py()), (n, b, s)
                elif key == (n, b, s):
                    q, found, score = tree.search(batch.column(5)[i].values.to_numpy(), batch.column(6)[i].values.to_numpy().reshape(-1, n), k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    found = sent.unionByName(asked).repartition("n", "s", "b").sortWithinPartitions("n", "s", "b", "kind").mapInArrow(search, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _trees(rows: DataFrame, k: int, shard: int) -> DataFrame:
    """n (length of vectors), s (number of the shard) and its tree, one row a shard: every tree is built once."""
    sized = rows.withColumn("n", F.size("v"))
    shards = F.broadcast(sized.groupBy("n").agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards")))  # a row for each length

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None

        def tree():
            ids, vectors = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]).reshape(-1, current[0])
            return pa.RecordBatch.from_arrays([pa.array([current[0]], pa.int32()), pa.array([current[1]], pa.int64()), pa.array([Tree(ids, vectors, k).closed()], pa.binary())], ["n", "s", "tree"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(2)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part, key = batch.slice(int(a), int(b - a)), (int(keys[0, a]), int(keys[1, a]))
                if key != current and held:
                    yield tree()
                    held = []
                current = key
                held.append((part.column(2).to_numpy(), part.column(3).flatten().to_numpy()))
        if held:
            yield tree()

    dealt = sized.join(shards, "n").select("n", F.pmod(F.xxhash64("id"), F.col("shards")).alias("s"), "id", "v")
    return dealt.repartition("n", "s").sortWithinPartitions("n", "s").select("n", "s", "id", "v").mapInArrow(build, "n int, s long, tree binary")
