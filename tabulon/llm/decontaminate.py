"""Benchmark decontamination: a prefix-filtered join of documents with benchmark windows.

A benchmark item gives windows of WINDOW consecutive words (one shorter window, if it has fewer). The tokens of the
join are shingles of up to PREFIX words, ordered by rarity among the windows. As every word of a window must occur,
one token is a sufficient prefix: a window is filed under its rarest one, with the token's position in it. Documents
are joined on these tokens; a window that doesn't fit in at that position (length and position bounds) goes, then
those whose hash over the window's own size differs, and the words of what is left are compared byte by byte.
Benchmarks of any size are taken in blocks of about BLOCK / 2 bytes of text: a task makes each block's index, of
some six times those bytes, which is then broadcast as it is to all documents.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textbytes as tb
from tabulon.llm.tables import small_batches, written

WINDOW, PREFIX, BLOCK = 8, 3, 16 << 20
#: Blocks held by a task at once.
AT_ONCE = 4
_WEIGHTS = tb.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n if len(out) else 0):
            out += words[k : len(words) - n + 1 + k] * _WEIGHTS[k]
        return tb.mix(out + np.uint64(n))


class Windows:
    """The windows of some items as arrays, filed under their rarest tokens: each is a place in the items' words."""

    def __init__(self, rows: list[tuple[str, str]], size: int):
        texts = pa.array([t for _, t in rows], pa.large_string())
        raw, begins, ends, hashed, firsts = [], [], [], [], [np.zeros(1, np.int64)]
        done = words_done = 0
        for _, _, part, starts, stops, at, words in tb.word_slices(texts, tb.ALNUM):
            raw.append(part)
            begins.append(starts + done)
            ends.append(stops + done)
            hashed.append(words)
            firsts.append(at[1:] + words_done)
            done, words_done = done + len(part), words_done + len(words)
        self.raw = np.concatenate([np.zeros(0, np.uint8), *raw]).tobytes()
        self.begins, self.ends = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (begins, ends))
        words, first = np.concatenate([np.zeros(0, np.uint64), *hashed]), np.concatenate(firsts)
        n = np.diff(first)
        count = np.where(n == 0, 0, np.maximum(1, n - size + 1))
        item = np.repeat(np.arange(len(n)), count)
        at = first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(size, n[item])
        # equal windows are one, with the items they are of
        full, second = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for m in np.unique(length):
            own = length == m
            full[own], second[own] = _grams(words, int(m))[at[own]], _grams(tb.mix(words + np.uint64(1)), int(m))[at[own]]
        order = np.lexsort((item, second, full))
        new = np.ones(len(order), bool)
        new[1:] = (full[order][1:] != full[order][:-1]) | (second[order][1:] != second[order][:-1])
        one = order[new]
        self.at, self.size, self.full = at[one], length[one], full[one]
        names = [str(r[0]) for r in rows]
        which = np.cumsum(new) - 1
        pair = np.unique(np.stack([which, item[order]]), axis=1) if len(order) else np.zeros((2, 0), np.int64)
        self.item_names, self.window_items = names, pair[1]
        self.item_first = np.searchsorted(pair[0], np.arange(len(one) + 1))
        # order of rarity: windows that hold the token, then its hash
        self.files = {}
        width = np.minimum(PREFIX, self.size)
        for m in np.unique(width):
            own = np.flatnonzero(width == m)
            grams, tries = _grams(words, int(m)), int(self.size[own].max() - m + 1)
            offset = np.arange(tries)
            there = offset[None, :] <= (self.size[own] - m)[:, None]
            tokens = grams[np.minimum(self.at[own][:, None] + offset, max(0, len(grams) - 1))]
            held = np.unique(np.stack([np.repeat(own, tries).reshape(len(own), tries)[there].astype(np.uint64), tokens[there]]), axis=1)[1]
            token, often = np.unique(held, return_counts=True)
            rarity = np.where(there, often[np.minimum(np.searchsorted(token, tokens), len(token) - 1)], np.iinfo(np.int64).max)
            best = np.lexsort((tokens.ravel(), rarity.ravel(), np.repeat(np.arange(len(own)), tries)))[::tries] % tries
            key = tokens[np.arange(len(own)), best]
            order = np.argsort(key, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.files[int(m)] = (key[order], own[order], best[order], bits)

    def same(self, window: int, raw: bytes, starts: np.ndarray, ends: np.ndarray, first: int) -> bool:
        """Whether the words from the given one on are the window's, byte by byte."""
        at, n = self.at[window], int(self.size[window])
        return all(raw[starts[first + k] : ends[first + k]] == self.raw[self.begins[at + k] : self.ends[at + k]] for k in range(n))

    def items(self, window: int) -> list[str]:
        return [self.item_names[i] for i in self.window_items[self.item_first[window] : self.item_first[window + 1]]]

    def hits(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a slice's word hashes: first words and numbers of the windows that occur, by hash."""
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        grams: dict[int, np.ndarray] = {}
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for n, (key, window, offset, there) in self.files.items():
            g = _grams(words, n)
            pos = np.flatnonzero(there[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
            low, high = np.searchsorted(key, g[pos], "left"), np.searchsorted(key, g[pos], "right")
            pos, low, high = pos[high > low], low[high > low], high[high > low]
            for a in range(0, len(pos), 100_000):
                p, count = pos[a : a + 100_000], (high - low)[a : a + 100_000]
                each = np.repeat(low[a : a + 100_000] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                start, w = np.repeat(p, count) - offset[each], window[each]
                fits = (start >= 0) & (start + self.size[w] <= len(words))
                start, w = start[fits], w[fits]
                fits = text[start] == text[start + self.size[w] - 1]
                start, w = start[fits], w[fits]
                same = np.zeros(len(w), bool)
                for size in np.unique(self.size[w]):
                    if size not in grams:
                        grams[size] = _grams(words, int(size))
                    rows = np.flatnonzero(self.size[w] == size)
                    same[rows] = grams[size][start[rows]] == self.full[w[rows]]
                out.append((start[same], w[same]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _free(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, least_items: int = 2) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated, which replace columns of these names.

    Words are runs of bytes 0-9, a-z and from 0x80 up of the text with A-Z lower-cased. n_hit counts words inside any
    occurrence of a window, n_items the items with an occurring window (distinct item_ids); items_sha256 is the
    SHA-256 of their ids, sorted as strings and comma-joined; contaminated: n_items >= least_items. Null and empty
    texts have no words and no hits. Benchmark rows with a null item_id or text, or no words, have no windows; repeated ones count once.
    Every document row gives one result; an empty benchmark leaves all documents clean.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs = docs.drop(*names)
    benchmark = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (BLOCK // 2)))
    at, held = docs.columns.index("text"), len(docs.columns)
    hits_name, items_name = (_free(docs, n) for n in ("hits", "items"))
    work = docs.withColumns({"n_words": F.lit(None).cast("long"), hits_name: F.lit(None).cast("binary"), items_name: F.lit(None).cast("array<string>")})
    schema = work.schema

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = pickle.loads(shared.value)
            for batch in batches:
                n_words, hits, items = [], [], []
                before = batch.column(held + 1).to_pylist(), batch.column(held + 2).to_pylist()
                for first, last, part, starts, ends, words_at, words in tb.word_slices(batch.column(at), tb.ALNUM):
                    n_words += np.diff(words_at).tolist()
                    start, window = windows.hits(words, words_at)
                    text = np.searchsorted(words_at, start, "right") - 1
                    by_text: dict[int, list[tuple[int, int]]] = defaultdict(list)
                    raw = part.tobytes() if len(start) else b""
                    for s, w, t in zip(start.tolist(), window.tolist(), text.tolist(), strict=True):
                        if windows.same(w, raw, starts, ends, s):
                            by_text[t].append((s, w))
                    for i in range(last - first):
                        a, b = words_at[i], words_at[i + 1]
                        old_hits, old_items = before[0][first + i], before[1][first + i]
                        if i not in by_text:
                            hits.append(old_hits)
                            items.append(old_items)
                            continue
                        flags = np.zeros(b - a, bool)
                        if old_hits:
                            flags = np.unpackbits(np.frombuffer(old_hits, np.uint8), count=b - a).astype(bool)
                        own_items = set(old_items or ())
                        for s, w in by_text[i]:
                            flags[s - a : s - a + windows.size[w]] = True
                            own_items.update(windows.items(w))
                        hits.append(np.packbits(flags).tobytes())
                        items.append(sorted(own_items))
                new = [pa.array(n_words, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:held], *new], names=schema.names)

        return run

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for k, *row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.setdefault(k, []).append(row)
        for k, rows in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(Windows(rows, size), protocol=5)], pa.binary())], ["k", "windows"])

    # tasks make the index of a block each; the driver only hands a block's arrays on
    dealt = benchmark.distinct().select(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("k"), "item_id", "text")
    made = written(dealt.repartition(blocks, "k").mapInArrow(index, "k long, windows binary"), "decontaminate-windows") if total else None
    for k in range(blocks if total else 0):
        for r in made.where(F.col("k") == k).select("windows").collect():
            work = work.mapInArrow(search(spark.sparkContext.broadcast(bytes(r["windows"]))), schema)
        if k % AT_ONCE == AT_ONCE - 1 and k + 1 < blocks:
            work = written(work, "decontaminate")
    if not total:
        work = work.mapInArrow(search(spark.sparkContext.broadcast(pickle.dumps(Windows([], size)))), schema)

    hits, items = F.col(f"`{hits_name}`"), F.coalesce(F.col(f"`{items_name}`"), F.array().cast("array<string>"))
    counted = [
        "n_words", F.coalesce(F.bitmap_count(hits), F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size(items) >= least_items).alias("contaminated"),
    ]
    return work.select(*[F.col(f"`{c}`") for c in docs.columns], *counted)
