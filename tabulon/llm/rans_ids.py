"""Token ids in files: a static range asymmetric numeral system with shared frequency tables.

Files are Parquet tables of blocks (uncompressed columns; committed and retried like any Spark output), with one
frequency table for all blocks beside them. A block holds whole documents, about BLOCK tokens, in LANES interleaved
streams: token i is in lane i mod LANES. It can be decoded without any other block, and, from the checkpoints (lane
states and position in the words) inside it, in parts; a CRC-32 of its ids is checked on reading.

Texts are encoded by the tokenizers library. A text is cut where byte-level BPE always ends a word (before a
space between two other characters, around a line end, between letters, digits and signs), and a task encodes every
distinct piece of text once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import textbytes as tb
from tabulon.llm.tables import new_path, small_batches, written

#: Tokens of a block and between checkpoints, lanes, bits of the frequency scale, known pieces of text held by a worker (some 100 MB).
BLOCK, CHECK, LANES, SCALE, KNOWN = 1 << 20, 1 << 18, 1024, 20, 1 << 21
_LOW = np.uint64(1 << 31)
#: Visible ASCII, and its kinds: letters, digits, signs (not the apostrophe, which may join letters to a word).
_PLAIN = tb.byte_class([(0x21, 0x7E)])
_KIND = np.zeros(256, np.int8)
_KIND[0x21:0x7F] = 3
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x30:0x3A], _KIND[0x27] = 2, 0
_STORE = "part long, seq long, first_id long, last_id long, ordered boolean, start long, n_tokens long, doc_ids binary, lengths binary, ids binary, tokens array<int>, counts array<long>"


# ---- the coder


def scaled(counts: np.ndarray, bits: int = SCALE) -> np.ndarray:
    """Frequencies with sum 2 ** bits, at least 1 for every counted token."""
    total, out = counts.sum(), np.zeros(len(counts), np.int64)
    there = counts > 0
    if (1 << bits) < there.sum():
        raise ValueError("more tokens than the scale has slots")
    if not total:
        return out
    out[there] = np.maximum(1, (counts[there].astype(float) / total * (1 << bits)).astype(np.int64))
    while (gap := (1 << bits) - out.sum()) != 0:  # the largest give or take the difference
        order = np.argsort(-out, kind="stable")[: max(1, min(len(out), abs(int(gap))))]
        if gap > 0:
            out[order] += max(1, int(gap) // len(order)) if gap >= len(order) else 1
        else:
            take = np.minimum(out[order] - 1, max(1, -int(gap) // len(order)))
            out[order] -= np.where(np.cumsum(take) <= -gap, take, 0)
    return out


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = SCALE):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.mask = np.uint64((1 << bits) - 1)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, int, list[tuple[int, int, bytes]]]:
        """Words, first lane states, number of lanes, checkpoints (first token, first word, lane states)."""
        lanes = int(np.clip(len(ids) // 64, 1, LANES))
        steps = -(-len(ids) // lanes)
        x, out, marks = np.full(lanes, _LOW), [], []
        f_all, c_all = self.freq[ids], self.cum[ids]
        top, word = np.uint64(63) - self.bits, np.uint64(32)
        every = max(1, CHECK // lanes)
        for s in range(steps - 1, -1, -1):
            f, c = f_all[s * lanes : (s + 1) * lanes], c_all[s * lanes : (s + 1) * lanes]
            y = x[: len(f)]
            over = y >= f << top
            out.append(y[over].astype(np.uint32))
            y = np.where(over, y >> word, y)
            q = y // f
            x[: len(f)] = (q << self.bits) + (y - q * f) + c
            if s and s % every == 0:
                marks.append((s, len(out), x.tobytes()))
        sizes = np.cumsum([0, *(len(w) for w in reversed(out))])
        points = [(s * lanes, int(sizes[s]), states) for s, _, states in reversed(marks)]
        return b"".join(w.tobytes() for w in reversed(out)), x.tobytes(), lanes, points

    def decode(self, words: bytes, states: bytes, lanes: int, n: int, first_token: int = 0, first_word: int = 0) -> np.ndarray:
        """Ids from a block's begin, or from a checkpoint, up to token n of the block."""
        x, w, at = np.frombuffer(states, np.uint64).copy(), np.frombuffer(words, np.uint32).astype(np.uint64), first_word
        out = np.empty(n - first_token, np.uint32)
        for a in range(0, len(out), lanes):
            y = x[: min(lanes, len(out) - a)]
            slot = y & self.mask
            symbol = self.symbol[slot]
            out[a : a + len(y)] = symbol
            y[:] = self.freq[symbol] * (y >> self.bits) + slot - self.cum[symbol]
            low = np.flatnonzero(y < _LOW)
            y[low] = (y[low] << np.uint64(32)) | w[at : at + len(low)]
            at += len(low)
        return out


# ---- tokens


class _Encoder:
    """Ids of texts, each distinct piece of text encoded once."""

    def __init__(self, path: str, end: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.library, self.end = Tokenizer.from_file(path), end
        self.keys, self.start, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        # special tokens would match across pieces: texts that hold one are encoded whole
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) + len(keys) > KNOWN and len(self.keys):
            self.keys, self.start, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        start = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))])
        keys, start, size = np.concatenate([self.keys, keys]), np.concatenate([self.start, start]), np.concatenate([self.size, size])
        order = np.argsort(keys, kind="stable")
        self.keys, self.start, self.size = keys[order], start[order], size[order]

    def slices(self, column: pa.Array):
        """For each slice: first text, ids of its texts with the end id behind each, lengths."""
        data, offsets = tb.buffers(column)
        for first, last in tb.slices(offsets, 1 << 20):
            part, own = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            n = last - first
            raw = part.tobytes()
            if any(s in raw for s in self.special):
                ids = [self.library.encode(raw[own[i] : own[i + 1]].decode(), add_special_tokens=False).ids + [self.end] for i in range(n)]
                yield first, np.array([x for i in ids for x in i], np.uint32), np.array([len(i) for i in ids], np.int64)
                continue
            if not len(part):
                yield first, np.full(n, self.end, np.uint32), np.ones(n, np.int64)
                continue
            cut = np.zeros(len(part), bool)
            wide = np.concatenate([[0], part[:-1]])  # the byte before
            latin = (part >= 0x80) & (part < 0xC0) & (wide >= 0xC3) & (wide <= 0xC5) & (part != 0x97) & (part != 0xB7)  # ends an accented letter
            before, kind = _PLAIN[part] | latin, np.where(latin, 1, _KIND[part])
            after = _PLAIN[part] | (part >= 0xC3) & (part <= 0xC5)
            cut[1:-1] = (part[1:-1] == 32) & before[:-2] & after[2:]
            cut[1:] |= (kind[:-1] > 0) & (_KIND[part[1:]] > 0) & (kind[:-1] != _KIND[part[1:]])
            cut[1:] |= (part[1:] == 10) & before[:-1]  # a single line end is a word of its own
            cut[2:] |= (part[1:-1] == 10) & before[:-2] & after[2:]
            cut[own[:-1][own[1:] > own[:-1]]] = True
            if len(own) > 2:  # no cut over the end of a text
                inner = own[1:-1]
                inner = inner[(inner > 0) & (inner < len(part))] - 1
                inner = inner[~np.isin(inner, own[:-1])]
                cut[inner] = False
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(part))
            keys = tb.hashes(part, starts, ends)
            uniq, one = np.unique(keys, return_index=True)
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, uniq), len(self.keys) - 1)
                new = self.keys[at] != uniq
            else:
                new = np.ones(len(uniq), bool)
            if new.any():
                if len(self.keys) + new.sum() > KNOWN:
                    new[:] = True
                rows = one[new]
                self._learn(uniq[new], [raw[a:b].decode() for a, b in zip(starts[rows], ends[rows], strict=True)])
            at = np.searchsorted(self.keys, keys)
            begin, size = self.start[at], self.size[at]
            total = np.cumsum(size)
            ids = self.flat[np.repeat(begin - (total - size), size) + np.arange(total[-1])]
            upto = np.concatenate([[0], total])[np.searchsorted(starts, own)]
            yield first, np.insert(ids, upto[1:], self.end), np.diff(upto) + 1


@lru_cache(maxsize=1)
def _encoder(path: str, end: int) -> _Encoder:
    """A Python worker's encoder, which keeps what it knows from task to task."""
    return _Encoder(path, end)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _STORE.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class _Blocks:
    """Gathers documents of a task to rows of the store."""

    def __init__(self):
        self.part, self.seq, self.start, self.ordered, self.last = TaskContext.get().partitionId(), 0, 0, True, -(2**63)
        self.doc_ids, self.lengths, self.ids, self.size = [], [], [], 0

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray):
        self.doc_ids.append(doc_ids)
        self.lengths.append(lengths)
        self.ids.append(ids)
        self.size += len(ids)
        if self.size >= BLOCK:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        doc_ids, lengths, ids = np.concatenate(self.doc_ids), np.concatenate(self.lengths), np.concatenate(self.ids)
        self.ordered &= bool((np.diff(doc_ids) >= 0).all() and doc_ids[0] >= self.last)
        self.last = int(doc_ids.max())
        row = (self.part, self.seq, int(doc_ids.min()), self.last, self.ordered, self.start, len(ids), doc_ids.tobytes(), lengths.tobytes(), ids.astype(np.uint16 if ids.max() < 65536 else np.uint32).tobytes(), None, None)
        self.seq, self.start, self.size = self.seq + 1, self.start + len(ids), 0
        self.doc_ids, self.lengths, self.ids = [], [], []
        return _packed([row])


_NULL = -(2**63)  # stands for a null doc_id, first in order


def _unpack(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32).astype(np.uint32)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = 2) -> None:
    """Write the ids of all texts of docs (doc_id, text) in ascending doc_id order to path.

    tokenizer: a file of the tokenizers library with a byte-level BPE model; end: the id behind each document. Null and empty texts give the
    end id alone. Rows without doc_id come first; rows with the same doc_id all stay, in any order among themselves. Other columns take no part.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, blocks, counts = _encoder(tokenizer, end), _Blocks(), np.zeros(end + 1, np.int64)
        for batch in batches:
            doc_ids = batch.column(0).fill_null(_NULL).to_numpy()
            for first, ids, lengths in encoder.slices(batch.column(1)):
                more = np.bincount(ids)
                if len(more) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(more) - len(counts), np.int64)])
                counts[: len(more)] += more
                yield from blocks.add(doc_ids[first : first + len(lengths)], lengths, ids)
        if blocks.size:
            yield blocks.flush()
        there = np.flatnonzero(counts)
        if len(there):
            yield _packed([(None,) * 10 + (there.tolist(), counts[there].tolist())])

    store_path = new_path(spark, "ids-store")
    store = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokenize, _STORE)
    store.write.option("compression", "zstd").parquet(store_path)
    store = spark.read.schema(store.schema).parquet(store_path)
    counts = store.where("tokens is not null").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).groupBy("x.tokens").agg(F.sum("x.counts").alias("c")).toArrow()
    blocks = store.where("part is not null").drop("tokens", "counts")

    def parts_of(blocks: DataFrame) -> list:
        rows = blocks.groupBy("part").agg(F.min("first_id").alias("low"), F.max("last_id").alias("high"), F.min("ordered").alias("ordered"), F.sum("n_tokens").alias("n")).collect()
        return sorted(rows, key=lambda r: (r["low"], r["high"], r["part"]))

    parts = parts_of(blocks)
    if not (all(r["ordered"] for r in parts) and all(a["high"] <= b["low"] for a, b in zip(parts[:-1], parts[1:], strict=True))):
        blocks = written(_sorted(blocks), "ids-sorted")
        parts = parts_of(blocks)
    bases, total = [], 0
    for r in parts:
        bases.append((r["part"], total))
        total += r["n"]
    tokens, freq = counts.column(0).to_numpy(), np.zeros(max([end, *counts.column(0).to_pylist()]) + 1, np.int64)
    freq[tokens] = counts.column(1).to_numpy()
    freq = scaled(freq)
    shared = spark.sparkContext.broadcast((freq, dict(bases)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, base = shared.value
        coder = Coder(freq)
        for batch in batches:
            for r in batch.to_pylist():
                ids = _unpack(r["ids"], r["n_tokens"])
                words, states, lanes, points = coder.encode(ids)
                yield pa.RecordBatch.from_pylist([{"start": base[r["part"]] + r["start"], "n_tokens": len(ids), "doc_ids": r["doc_ids"], "lengths": r["lengths"], "lanes": lanes, "states": states, "words": words, "checkpoints": [{"token": t, "word": w, "states": s} for t, w, s in points], "crc32": zlib.crc32(ids.tobytes())}], schema=_FILE)

    blocks.mapInArrow(code, _FILE_DDL).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(SCALE, freq.astype("<i4").tobytes())], "scale int, frequencies binary").coalesce(1).write.option("compression", "none").parquet(f"{path}/table")


_FILE_DDL = "start long, n_tokens long, doc_ids binary, lengths binary, lanes int, states binary, words binary, checkpoints array<struct<token:long,word:long,states:binary>>, crc32 long"
_FILE = pa.schema([("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("lanes", pa.int32()), ("states", pa.binary()), ("words", pa.binary()), ("checkpoints", pa.list_(pa.struct([("token", pa.int64()), ("word", pa.int64()), ("states", pa.binary())]))), ("crc32", pa.int64())])


def _sorted(blocks: DataFrame) -> DataFrame:
    """The store's documents in order of doc_id, dealt to ranges."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                doc_ids, cut = np.frombuffer(r["doc_ids"], np.int64), np.concatenate([[0], np.cumsum(np.frombuffer(r["lengths"], np.int64))])
                width = len(r["ids"]) // max(1, r["n_tokens"])
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(np.diff(cut)), pa.array([r["ids"][a * width : b * width] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc_id", "n", "ids"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks()
        for batch in batches:
            doc_ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(batch.num_rows):
                yield from blocks.add(doc_ids[i : i + 1], n[i : i + 1], _unpack(batch.column(2)[i].as_py(), int(n[i])))
        if blocks.size:
            yield blocks.flush()

    each = blocks.mapInArrow(rows, "doc_id long, n long, ids binary")
    salt = F.rand(7)  # spreads equal ids; their order is free
    return each.withColumn("salt", salt).repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id").select("doc_id", "n", "ids").mapInArrow(gather, _STORE).drop("tokens", "counts")


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Per document of the files: doc_id, start (tokens before it), n_tokens, ids_crc32 and, if wanted, ids (array of int).

    A block whose checksum doesn't fit raises an error. Every block is read by itself.
    """
    small_batches(spark)
    table = spark.read.parquet(f"{path}/table").first()
    shared = spark.sparkContext.broadcast((np.frombuffer(table["frequencies"], "<i4").astype(np.int64), table["scale"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for batch in batches:
            for r in batch.to_pylist():
                flat = coder.decode(r["words"], r["states"], r["lanes"], r["n_tokens"])
                if zlib.crc32(flat.tobytes()) != r["crc32"]:
                    raise ValueError(f"block at token {r['start']}: wrong checksum")
                doc_ids, lengths = np.frombuffer(r["doc_ids"], np.int64), np.frombuffer(r["lengths"], np.int64)
                cut = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(flat.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                columns = [pa.array(doc_ids, mask=doc_ids == _NULL), pa.array(r["start"] + cut[:-1]), pa.array(lengths), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    return spark.read.schema(_FILE_DDL).parquet(f"{path}/blocks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
