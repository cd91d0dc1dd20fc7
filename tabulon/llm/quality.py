"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of hashed tokens (three-grams of byte classes, word repetitions and word shapes), weighted by
root frequency and inverse document frequency and projected to a latent space that a singular value decomposition of
a bounded sample of labelled texts has given. The sample's vectors are broadcast; every document's cosines with all of
them are computed exactly, in blocks, and its NEIGHBOURS nearest vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textbytes as tb
from tabulon.llm.tables import small_batches

#: The fit's bounds: labelled texts of the sample, hashed features, latent dimensions. 4 MB of features, 1 MB broadcast.
SAMPLE, GRAMS, SHAPES, LATENT, NEIGHBOURS = 4000, 1000, 24, 48, 25
DIMS = GRAMS + SHAPES
_CODE = np.arange(256, dtype=np.uint64)
_CODE[97:123], _CODE[65:91], _CODE[48:58], _CODE[128:] = 1, 2, 3, 1


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """For each slice: its first text and a row of DIMS weights for each text; null and empty texts have zeros."""
    data, offsets = tb.buffers(column)
    for first, last in tb.slices(offsets):
        part, own = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        code = _CODE[part]
        grams = np.zeros(len(part), np.int64)
        if len(part) > 2:
            grams[:-2] = (tb.mix(code[:-2] * np.uint64(65536) + code[1:-1] * np.uint64(256) + code[2:]) % np.uint64(GRAMS)).astype(np.int64)
        starts, ends, at = tb.spans(part, own, tb.NOT_SPACE)
        words = tb.hashes(part, starts, ends)
        lower, upper, digit = (s[ends] - s[starts] for s in (np.concatenate([[0], np.cumsum(code == k)]) for k in (1, 2, 3)))
        size = ends - starts
        shapes = [np.ones(len(words), bool), upper == size, upper > 1, digit > 0, lower + upper < size - 1, lower + upper == 0, size == 1, size > 20]
        for k in (1, 2, 3):
            same = np.zeros(len(words), bool)
            same[k:] = words[k:] == words[:-k]
            shapes.append(same)
        sums = [np.concatenate([[0], np.cumsum(s)]) for s in shapes]
        out = np.zeros((last - first, DIMS), np.float32)
        for i in range(last - first):
            if own[i + 1] > own[i]:
                out[i, :GRAMS] = np.bincount(grams[own[i] : own[i + 1]], minlength=GRAMS)
        for k, s in enumerate(sums):
            out[:, GRAMS + k] = 8 * (s[at[1:]] - s[at[:-1]])
        out /= np.maximum(out.sum(1, keepdims=True), 1)
        yield first, np.sqrt(out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """Weights, projection, and the sample's latent vectors with their labels."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.idf = (np.log((len(x) + 1) / ((x > 0).sum(0) + 1)) + 0.3).astype(np.float32)
        x = unit(x * self.idf)
        _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.project = np.ascontiguousarray(vectors[:, ::-1][:, :LATENT]).astype(np.float32)
        self.vectors, self.labels = unit(x @ self.project), labels.astype(np.float32)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        """Similarity-weighted votes of the nearest labelled vectors, with one vote of the prior."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        k, out = min(NEIGHBOURS, len(self.labels)), np.empty(len(x))
        for a in range(0, len(x), 512):
            cosines = unit((unit(x[a : a + 512] * self.idf)) @ self.project) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            sims = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64)
            floor = np.minimum(sims.min(1, keepdims=True), 0.999)
            weights = ((sims - floor) / (1 - floor) + 0.05) * (sims > 0)
            out[a : a + 512] = ((weights * self.labels[near]).sum(1) + 0.05 * self.prior) / (weights.sum(1) + 0.05)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most sample labelled texts of (doc_id, text) and (doc_id, label 0 or 1): those of the least hashes.

    The hash is of doc_id, text and label together, so texts that share an id are drawn apart, and equal rows count once.
    Rows without doc_id have no label; null labels are left out.
    """
    labels = labels.where("doc_id is not null and label is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).distinct()
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(docs.sparkSession)
    key = F.xxhash64("doc_id", "hash", "label").alias("key")
    hashed = docs.select("doc_id", F.xxhash64("text").alias("hash"))
    chosen = hashed.join(labels, "doc_id").select("doc_id", "hash", "label", key).distinct().orderBy("key", "doc_id", "hash", "label").limit(sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in features(batch.column("text")):
                part = batch.slice(first, len(x))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "label", "x"])

    drawn = docs.withColumn("hash", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "hash"]).select("key", "label", "text")
    table = drawn.mapInArrow(rows, "key long, label int, x binary").groupBy("key").agg(F.first("label").alias("label"), F.first("x").alias("x")).orderBy("key").toArrow()
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(-1, DIMS)
    return Model(x, table.column("label").to_numpy())


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score (0 to 1, higher: label 1 likelier), which replaces a column of that name.

    Null and empty texts are scored like texts without any token: by the sample's share of label 1 and its neighbours
    at similarity zero, that is the share alone. Repeated rows get the same score; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    small_batches(docs.sparkSession)
    schema = docs.select("*", F.lit(0.0).alias("score")).schema
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(x) for _, x in features(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=schema.names)

    return docs.mapInArrow(score, schema)
