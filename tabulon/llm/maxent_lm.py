"""Language-model scores by a hashed maximum-entropy model.

A word's probability is that of its class, given the words before it, times the word's share of its class; that product
is the prior of the word after the two before it, to which the counts of the three together are added. Classes are
hashed endings. The class softmax adds weights of hashed features: the word before, the two before together, and a skip
feature, the second word before. Its weights are trained by gradient updates: in every round each task takes minibatch
steps on its own texts from the shared start, and the results are averaged, weighted by the gradient a row has seen.
The first round runs over an eighth of the texts, to give a start, the second over all.

Counts of words, contexts and three-grams are over all training texts and grow with them. Texts are dealt to blobs of
some megabytes; a blob sends each distinct key once, with its count, to one of the parts of the key space (more parts
for more tokens), as packed arrays; a part adds up and sends every blob the totals of its keys. So a frequent key is
one number a blob, and no table is broadcast but the bounded one of the softmax. Words are told apart by 64 bits, the
others by 32 bits within their part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textbytes as tb
from tabulon.llm.tables import small_batches, written

#: Classes, rows of the weight table (2 MB of weights), tokens of a minibatch, step size.
CLASSES, ROWS, BATCH, RATE = 32, 1 << 14, 8192, 0.25
#: Weight of the prior in counts, bytes of text in a blob, keys in a part, shares of the texts that the rounds of training take.
PRIOR, BLOB, PART, ROUNDS = 25.0, 2 << 20, 4 << 20, (8, 1)
#: Rows of weights that are summed as one.
_CHUNK = 256
_END = tb.mix(np.array([0xE2D], np.uint64))[0]


def token_slices(column: pa.Array):
    """For each slice: first text, last text, token hashes, classes, first token of each text and end.

    Tokens of a text: its words of non-space bytes with A-Z lower-cased, then one end.
    """
    for first, last, part, _, ends, at, words in tb.word_slices(column, tb.NOT_SPACE):
        tail = part[ends - 1].astype(np.uint64) * np.uint64(256)
        tail += np.where(ends > 1, part[ends - 2], 0).astype(np.uint64) if len(ends) else tail
        classes = 1 + (tb.mix(tail) % np.uint64(CLASSES - 1)).astype(np.int64)
        yield first, last, np.insert(words, at[1:], _END), np.insert(classes, at[1:], 0), at + np.arange(len(at))


def _before(tokens: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The token before every token and the second one before it, none across texts."""
    before = []
    for k in (1, 2):
        w = np.zeros(len(tokens), np.uint64)
        w[k:] = tokens[:-k]
        for j in range(k):  # the first tokens of a text have no word there
            first = at[:-1] + j
            w[first[first < at[1:]]] = np.uint64(j + 1)
        before.append(w)
    return before


def contexts(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of the weight table for every token: three features, none across texts, and the bias in row 0."""
    n, before = len(tokens), _before(tokens, at)
    with np.errstate(over="ignore"):
        keys = [before[0], before[0] * np.uint64(31) + before[1] * np.uint64(1_000_003), before[1]]
        rows = [(tb.mix(k + np.uint64(i << 56)) % np.uint64(ROWS - 1)).astype(np.int64) + 1 for i, k in enumerate(keys)]
    return np.stack([*rows, np.zeros(n, np.int64)])


def log_classes(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural logarithms of the classes' probabilities."""
    z = weights[rows[0]]
    for r in rows[1:]:
        z += weights[r]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def step(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
    """One gradient update of a minibatch, scaled by each row's own past gradients."""
    gradient = np.exp(log_classes(weights, rows))
    gradient[np.arange(len(classes)), classes] -= 1
    for r in rows[:-1]:
        order = np.argsort(r.astype(np.uint16), kind="stable")
        sorted_ = r[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        own = sorted_[first]
        g = np.add.reduceat(gradient[order], first, axis=0)
        squares[own] += (g * g).mean(1)
        weights[own] -= RATE * g / np.sqrt(squares[own] + 1e-6)[:, None]
    g = gradient.sum(0)
    squares[0] += (g * g).mean()
    weights[0] -= RATE * g / np.sqrt(squares[0] + 1e-6)


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (train, row, text) as compressed bundles of about BLOB bytes of text or one row, with a number of its own."""
    held: list[pa.RecordBatch] = []
    size, number = 0, TaskContext.get().partitionId() << 32

    def bundle():
        table = pa.Table.from_batches(held).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([tb.closed(table.to_batches()[0])], pa.binary())], ["blob", "payload"])

    for batch in batches:
        offsets = tb.buffers(batch.column(2))[1]
        for first, last in tb.slices(offsets):
            held.append(batch.slice(first, last - first))
            size += int(offsets[last] - offsets[first]) + 64 * (last - first)
            if size > BLOB:
                yield bundle()
                held, size, number = [], 0, number + 1
    if held:
        yield bundle()


def _keys(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit keys of every token's context (the two words before it) and of the context with the token."""
    one, two = _before(tokens, at)
    with np.errstate(over="ignore"):
        context = tb.mix(one * np.uint64(0x9E3779B97F4A7C15) + two * np.uint64(0xD1B54A32D192ED03))
        return np.concatenate([context, tb.mix(context ^ (tokens * np.uint64(0x8CB92BA72F3D8DD7)))])


def _placed(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts begin in sorted keys, a part being a range of keys, and 32 bits of each key's place in its part, in order."""
    bits = np.uint64(parts.bit_length())
    with np.errstate(over="ignore"):
        x = (keys >> bits) * np.uint64(parts)
        return np.searchsorted(x >> (np.uint64(64) - bits), np.arange(parts + 1, dtype=np.uint64)), (x << bits >> np.uint64(32)).astype(np.uint32)


class _Blob:
    """A blob's texts as tokens, with the distinct words and keys and where they stand."""

    def __init__(self, payload: pa.Scalar):
        self.rows = tb.opened(payload)
        train = self.rows.column(0).to_numpy(zero_copy_only=False)
        found = list(token_slices(self.rows.column(2)))
        self.slices = [(tokens, classes, at) for _, _, tokens, classes, at in found]
        self.tokens = np.concatenate([f[2] for f in found])
        self.length = np.concatenate([np.diff(f[4]) for f in found])
        self.classes = np.concatenate([f[3] for f in found])
        self.counted = np.repeat(train, self.length)
        self.words, first, self.word_at = np.unique(self.tokens, return_index=True, return_inverse=True)
        self.word_class = self.classes[first].astype(np.uint8)
        self.keys, self.key_at = np.unique(np.concatenate([k.reshape(2, -1) for k in (_keys(t, at) for t, _, at in self.slices)], axis=1).ravel(), return_inverse=True)

    def training(self, at: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(at, np.tile(self.counted, len(at) // max(1, len(self.counted))), n).astype(np.uint32)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs, by planes of bytes, compressed."""
    width = 1 if (most := int(counts.max(initial=0))) < 1 << 8 else 2 if most < 1 << 16 else 4
    raw = counts.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    width, size = packed[0], int.from_bytes(packed[1:9], "little")
    raw = pa.decompress(packed[9:], decompressed_size=size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").ravel().astype(np.uint32)


_PARTS = "part long, blob long, words binary, kinds binary, word_counts binary, keys binary, counts binary"


def _sent(parts: int):
    """Of blobs, for every part the distinct words and keys in it with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blob = _Blob(payload)
                words, keys = blob.training(blob.word_at, len(blob.words)), blob.training(blob.key_at, len(blob.keys))
                w, (k, low) = _placed(blob.words, parts)[0], _placed(blob.keys, parts)
                steps = lambda x: _packed(np.diff(x, prepend=np.uint32(0)))
                some = np.flatnonzero((np.diff(w) > 0) | (np.diff(k) > 0))
                cut = lambda x, at, form=np.ndarray.tobytes: pa.array([form(x[at[p] : at[p + 1]]) for p in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), number)), cut(blob.words, w), cut(blob.word_class, w), cut(words, w, _packed), cut(low, k, steps), cut(keys, k, _packed)], [c.split()[0] for c in _PARTS.split(", ")])

    return run


_TOTALS = "blob long, part long, word_counts binary, counts binary, n array<long>, v array<long>"


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by part: for every blob the totals of what it sent, and for a part the training tokens and distinct words of every class."""
    names = [c.split()[0] for c in _TOTALS.split(", ")]
    held: list[tuple] = []
    current = None

    def added(values: list[np.ndarray], counts: list[bytes]):
        flat = np.concatenate(values)
        keys, first, at = np.unique(flat, return_index=True, return_inverse=True)
        total = np.bincount(at, np.concatenate([_unpacked(c) for c in counts]), len(keys)).astype(np.int64)
        cut = np.cumsum([0, *map(len, values)])
        back = np.minimum(total, 2**32 - 1).astype(np.uint32)[at]
        return first, total, [_packed(back[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def answer():
        blobs, words, kinds, word_counts, keys, counts = zip(*held, strict=True)
        first, total, own = added([np.frombuffer(w, np.uint64) for w in words], word_counts)
        kind = np.frombuffer(b"".join(kinds), np.uint8)[first]
        _, _, back = added([np.cumsum(_unpacked(k), dtype=np.uint32) for k in keys], counts)
        n = len(blobs)
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.int64()), pa.array([current] * n, pa.int64()), pa.array(own, pa.binary()), pa.array(back, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names)
        seen = [np.bincount(kind, x, CLASSES).astype(np.int64).tolist() for x in (total, total > 0)]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([current], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *(pa.array([x], pa.list_(pa.int64())) for x in seen)], names)

    for batch in batches:
        for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != current and held:
                yield from answer()
                held = []
            current = part
            held.append(tuple(row))
    if held:
        yield from answer()


def train(blobs: DataFrame, bias: np.ndarray, rounds: tuple[int, ...] = ROUNDS) -> np.ndarray:
    """The weight table after rounds over shares of the blobs (1 of each so many), started with the bias."""
    out = np.zeros((ROWS, CLASSES), np.float32)
    out[0] = bias

    def run(shared, share):
        def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, squares, n = shared.value.copy(), np.zeros(ROWS, np.float32), 0
            for batch in batches:
                for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if number % share:
                        continue
                    rows = tb.opened(payload)
                    for _, _, tokens, classes, at in token_slices(rows.column(2).filter(rows.column(0))):
                        context = contexts(tokens, at)
                        for a in range(0, len(tokens), BATCH):
                            step(weights, squares, context[:, a : a + BATCH], classes[a : a + BATCH])
                        n += len(tokens)
            if n:
                # a row counts by how much gradient it has seen, so that rows a task never met don't dilute others
                seen = np.sqrt(squares)
                for k in range(0, ROWS, _CHUNK):
                    if seen[k : k + _CHUNK].any():
                        part = np.concatenate([weights[k : k + _CHUNK] * seen[k : k + _CHUNK, None], seen[k : k + _CHUNK, None]], axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], ["k", "w"])

        return steps

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(w, np.float32).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["k", "w"])

    for share in rounds:
        shared = blobs.sparkSession.sparkContext.broadcast(out)
        new = out.copy()
        for r in blobs.mapInArrow(run(shared, share), "k int, w binary").repartition("k").mapInArrow(total, "k int, w binary").collect():
            part = np.frombuffer(r["w"], np.float64).reshape(-1, CLASSES + 1)
            met = part[:, -1] > 0
            new[r["k"] : r["k"] + len(part)][met] = part[met, :-1] / part[met, -1:]
        out = new
    return out


def score_texts(docs: DataFrame, training: Column) -> DataFrame:
    """docs without text, with n_tokens, n_known, train_tokens, base_score and score, which replace columns of these names.

    The model learns from the texts of the rows where training (a Column over docs) is true. base_score: sum over a
    text's tokens of log10((c + 1) / (N + V + 1)), with c the token's count in the training texts, N all their tokens, V
    the distinct ones; n_known: tokens with c > 0. score: the model's log10 probability of the text. Null and empty
    texts are one end token. Repeated rows are scored alike. Without training texts all counts are 0.
    """
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in docs.columns if c != "text" and c not in names]
    small_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.coalesce(training, F.lit(False)).alias("train"), row.alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    blobs = written(rows.mapInArrow(_blobs, "blob long, payload binary"), "lm-blobs")
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    parts = max(1, -(-int(size) // (2 * PART)))  # a word has some six bytes and two keys
    totals = blobs.mapInArrow(_sent(parts), _PARTS).repartition("part").sortWithinPartitions("part").mapInArrow(_totals, _TOTALS)
    totals = written(totals, "lm-counts")
    by_class = totals.where("n is not null").select(F.posexplode(F.arrays_zip("n", "v")).alias("k", "x")).groupBy("k").agg(F.sum("x.n").alias("n"), F.sum("x.v").alias("v")).collect()
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        tokens[r["k"]], distinct[r["k"]] = r["n"], r["v"]
    n, v = int(tokens.sum()), int(distinct.sum())
    weights = train(blobs, np.log((tokens + 1) / (tokens + 1).sum()))
    shared = docs.sparkSession.sparkContext.broadcast((weights, np.log(tokens + distinct + 1)))

    def scored(blob: _Blob, back: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        weights, log_size = shared.value
        words = np.concatenate([_unpacked(x) for x, _ in back])[blob.word_at].astype(float)
        context, three = np.concatenate([_unpacked(x) for _, x in back])[blob.key_at].reshape(2, -1).astype(float)
        prior = np.empty(len(blob.tokens))
        done = 0
        for tokens, classes, at in blob.slices:
            features = contexts(tokens, at)
            for a in range(0, len(tokens), BATCH):
                z = log_classes(weights, features[:, a : a + BATCH])
                prior[done : done + len(z)] = z[np.arange(len(z)), classes[a : a + BATCH]]
                done += len(z)
        prior += np.log(words + 1) - log_size[blob.classes]
        score = np.log10(three + PRIOR * np.exp(prior)) - np.log10(context + PRIOR)
        begin = np.cumsum(blob.length) - blob.length
        base = np.add.reduceat(np.log10(words + 1), begin) - blob.length * np.log10(n + v + 1)
        new = [pa.array(blob.length.astype(np.int64)), pa.array(np.add.reduceat((words > 0).astype(np.int64), begin)), pa.array(np.full(len(begin), n)), pa.array(base), pa.array(np.add.reduceat(score, begin))]
        return pa.RecordBatch.from_arrays([blob.rows.column(1), *new], ["row", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, back, number = None, [], None
        for batch in batches:
            for own, part, payload, word_counts, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if own != number and number is not None:
                    yield scored(blob, back)
                if part < 0:
                    blob, back, number = _Blob(payload), [], own
                else:
                    back.append((word_counts, counts))
        if number is not None:
            yield scored(blob, back)

    none = F.lit(None).cast("binary")
    both = blobs.select("blob", F.lit(-1).cast("long").alias("part"), "payload", none.alias("word_counts"), none.alias("counts"))
    both = both.unionByName(totals.where("n is null").select("blob", "part", none.alias("payload"), "word_counts", "counts"))
    out = both.repartition("blob").sortWithinPartitions("blob", "part").mapInArrow(run, f"row {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *names)
