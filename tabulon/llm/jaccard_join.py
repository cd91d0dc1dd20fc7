"""Near duplicates: an exact n-gram Jaccard join by signature trees.

Every document becomes the set of its word n-grams (64-bit hashes). Documents with the same set form a class, and
only classes go on. A class sends its prefix (its rarest tokens, as many as any set similar enough must share one of)
to the buckets of these tokens, so two linked classes meet in at least one bucket. Inside a bucket a signature tree
(nodes with OR-combined token bitmaps and size ranges) drops the pairs whose greatest possible overlap is too small;
what is left connects classes to blocks. A block is cut into chunks of bounded size, and each chunk's trees are
traversed with exact counts at the leaves. A pair that is connected already isn't counted again, so a group of many
near copies costs about as much as its members.

Results are exact: bitmaps, sizes, prefixes and rarity only decide which pairs need no count. The rarity of a token is
estimated over all documents: each task reports the tokens it has met at least twice, the most frequent
FREQUENT ones of all tasks go to the end of the order of tokens, and all others are ordered by hash. Any such order
gives right results; this one keeps passages that many documents share out of the prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textbytes as tb
from tabulon.llm.tables import bounded_broadcast, components, drop, rows_among, small_batches, stars, stars_made, stored, written

#: Tokens in the broadcast table of frequent ones: 12 bytes each, so 3 MB at any size of the corpus.
FREQUENT = 1 << 18
#: Bitmaps have 2 ** 9 to 2 ** 17 bits; classes of a chunk; documents of a leaf; classes of a bucket taken pair by pair.
WIDTHS, CHUNK, LEAF, FEW = (9, 17), 1024, 32, 6
#: Rows of tokens that a task holds at a time.
RUN = 1 << 18


def set_slices(column: pa.Array, n: int):
    """For each slice of texts: its first text and a list of sorted distinct n-gram hashes for each text."""
    weights = tb.mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    for first, last, _, _, _, at, words in tb.word_slices(column, tb.NOT_SPACE):
        with np.errstate(over="ignore"):
            grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
            for k in range(n):
                grams += words[k : len(words) - n + 1 + k] * weights[k] if len(grams) else 0
            grams = tb.mix(grams)
            sets = []
            for i in range(last - first):
                a, b = at[i], at[i + 1]
                if b - a >= n:
                    s = np.sort(grams[a : b - n + 1])
                    sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
                elif b > a:
                    sets.append(tb.mix((words[a:b] * weights[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
                else:
                    sets.append(grams[:0])
        yield first, sets


def _needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of sets of n and m tokens that links them: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def _frequent(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT most frequent tokens that tasks have met twice, sorted, and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report():
            s = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            c = np.diff(np.append(first, len(s)))
            return pa.RecordBatch.from_arrays([pa.array(s[first][c > 1].view(np.int64)), pa.array(c[c > 1].astype(np.int64))], ["token", "c"])

        for batch in batches:
            for _, sets in set_slices(batch.column(0), n):
                held += sets
                size += sum(map(len, sets))
                if size >= 1 << 20:
                    yield report()
                    held, size = [], 0
        yield report()

    top = texts.select("text").mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()
    tokens, counts = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], np.minimum(counts[order], 2**31 - 1).astype(np.int32)


def _set_id(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return (np.array([s.sum(), tb.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64) + np.uint64(len(s))).tobytes()


def width(n: np.ndarray | int) -> np.ndarray:
    """Bits of a bitmap for n tokens: a power of two from 2 n up, so linked sets differ by one doubling at most."""
    return np.left_shift(1, np.clip(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) + 1, *WIDTHS))


def _bitmap(s: np.ndarray) -> bytes:
    w = int(width(len(s)))
    bits = np.zeros(w, bool)
    bits[(s >> np.uint64(20)).astype(np.int64) & (w - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _bits(column: list[bytes], w: int) -> np.ndarray:
    """Bitmaps of w bits or twice that, as rows of 64-bit words; wider ones folded to w."""
    out = np.empty((len(column), w // 64), np.uint64)
    for i, x in enumerate(column):
        x = np.frombuffer(x, np.uint64)
        out[i] = x if len(x) == w // 64 else x[: w // 64] | x[w // 64 :]
    return out


def _most(n: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The greatest possible intersections of sets with sizes n, m and bitmaps a, b."""
    return np.minimum(n - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), m - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))


def _sketches(docs: DataFrame, n: int, percent: int, frequent, keyed: bool) -> DataFrame:
    """row (a key of its own), doc_id, n_shingles, set_id (16 bytes, null for no set), prefix (packed tokens), bitmap, text.

    keyed: row is the doc_id, and there is no text.
    """
    names = ["row", "doc_id", "n_shingles", "set_id", "prefix", "bitmap"] + ["text"] * (not keyed)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        maybe = np.zeros(1 << 22, bool)
        maybe[(tokens & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            for first, sets in set_slices(batch.column(1), n):
                out: list[list] = [[], [], [], []]
                for s in sets:
                    out[0].append(len(s))
                    if not len(s):
                        for o in out[1:]:
                            o.append(None)
                        continue
                    keep = len(s) - -(-percent * len(s) // 100) + 1
                    prefix = s
                    hit = np.flatnonzero(maybe[(s & np.uint64((1 << 22) - 1)).astype(np.int64)])
                    if len(hit):
                        at = np.minimum(np.searchsorted(tokens, s[hit]), len(tokens) - 1)
                        hit, at = hit[tokens[at] == s[hit]], at[tokens[at] == s[hit]]
                        rare = np.ones(len(s), bool)
                        rare[hit] = False
                        often = s[hit][np.lexsort((s[hit], counts[at]))]
                        prefix = np.concatenate([s[rare], often])
                    out[1].append(_set_id(s))
                    out[2].append(prefix[:keep].tobytes())
                    out[3].append(_bitmap(s))
                own = ids.slice(first, len(sets))
                rows = own if keyed else pa.array(np.arange(row, row + len(sets)))
                row += len(sets)
                texts = [] if keyed else [batch.column(1).slice(first, len(sets))]
                yield pa.RecordBatch.from_arrays([rows, own, pa.array(out[0], pa.int64()), *(pa.array(o, pa.binary()) for o in out[1:]), *texts], names)

    schema = "row long, doc_id long, n_shingles long, set_id binary, prefix binary, bitmap binary" + ", text string" * (not keyed)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketch, schema)


class Tree:
    """Sets ordered by size in leaves of LEAF, with a level of nodes over every LEAF nodes: size ranges, OR-combined bitmaps."""

    def __init__(self, n: np.ndarray, bits: np.ndarray):
        self.order = np.lexsort((bits[:, 0], n))
        self.n, self.bits = n[self.order], bits[self.order]
        self.levels = []
        low = high = self.n
        join = self.bits
        while len(low) > LEAF:
            cut = np.arange(0, len(low), LEAF)
            low, high, join = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.bitwise_or.reduceat(join, cut, axis=0)
            self.levels.append((low, high, join))

    def near(self, n: int, bits: np.ndarray, open_: np.ndarray, percent: int) -> np.ndarray:
        """Positions (in order) of open sets whose overlap with the given set may be enough."""
        at = None
        for low, high, join in reversed(self.levels):
            at = np.arange(len(low)) if at is None else (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < len(low)]
            at = at[(100 * high[at] >= percent * n) & (100 * n >= percent * low[at])]
            missing = np.bitwise_count(bits & ~join[at]).sum(1, dtype=np.int64)
            at = at[n - missing >= _needed(n, np.maximum(low[at], -(-percent * n // 100)), percent)]
        at = np.arange(len(self.n)) if at is None else (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.n)]
        at = at[open_[at]]
        at = at[(100 * np.minimum(self.n[at], n) >= percent * np.maximum(self.n[at], n))]
        return at[_most(n, bits, self.n[at], self.bits[at]) >= _needed(n, self.n[at], percent)]


def connect(n: np.ndarray, bits: np.ndarray, percent: int, sets: list | None = None, group: np.ndarray | None = None, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect the given sets as their links do.

    Without sets: as the pairs whose bitmaps allow a link do. With sets: by exact counts. group: sets of one group are
    connected already. left: only pairs with at least one set so marked are wanted.
    """
    tree, out = Tree(n, bits), []
    order = tree.order
    n, bits = tree.n, tree.bits
    group = np.arange(len(n)) if group is None else np.unique(group, return_inverse=True)[1][order]
    left = np.ones(len(n), bool) if left is None else left[order]
    if sets is not None:
        sets = [sets[i] for i in order]
        sizes = np.array([len(s) for s in sets])
        flat, cut = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    label = group.copy()
    waits = np.ones(len(n), bool)  # sets that haven't been held against all others
    stack: list[int] = []
    while True:
        if not stack:
            rest = np.flatnonzero(waits & left)
            if not len(rest):
                return out
            stack.append(int(rest[0]))
        f = stack.pop()
        if not (waits[f] and left[f]):
            continue
        waits[f] = False
        open_ = (label != label[f]) & waits
        if not open_.any():
            continue
        at = tree.near(int(n[f]), bits[f], open_, percent)
        if sets is not None and len(at):
            own = sets[f]
            where = np.concatenate([np.arange(cut[i], cut[i] + sizes[i]) for i in at]) if len(at) < len(n) else slice(None)
            values = flat[where]
            found = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
            inter = np.add.reduceat(found.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[at])[:-1]]))
            at = at[100 * inter >= percent * (n[f] + n[at] - inter)]
        for i in at:
            if label[i] != label[f]:
                label[label == label[i]] = label[f]
                out.append((int(order[f]), int(order[i])))
                stack.append(int(i))


def connect_all(n: np.ndarray, bitmaps: list[bytes], percent: int, sets: list | None = None, group: np.ndarray | None = None, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """connect() for sets of all sizes: a tree for every width of bitmaps, which also holds the next width, folded."""
    wide, out = width(n), []
    for w in np.unique(wide):
        at = np.flatnonzero((wide == w) | (wide == 2 * w))
        own = wide[at] == w
        if len(at) > 1:
            edges = connect(n[at], _bits([bitmaps[i] for i in at], int(w)), percent, None if sets is None else [sets[i] for i in at], None if group is None else group[at], own if left is None else left[at])
            out += [(int(at[a]), int(at[b])) for a, b in edges]
    return out


def _runs(keys: str, work, out: pa.Schema):
    """A mapInArrow function for batches sorted by keys: work(table of one run) gives a list of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        held: list[pa.Table] = []
        rows: list[tuple] = []

        def flush():
            return pa.RecordBatch.from_pylist([dict(zip(out.names, r, strict=True)) for r in rows], schema=out)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            key = table.column(keys).combine_chunks()
            new = np.concatenate([[True], pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)])
            cuts = [*np.flatnonzero(new), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                value = key[int(a)].as_py()
                if held and value != last:
                    rows += work(pa.concat_tables(held))
                    held = []
                held.append(table.slice(a, b - a))
                last = value
            if len(rows) >= 10_000:
                yield flush()
                rows = []
        if held:
            rows += work(pa.concat_tables(held))
        if rows:
            yield flush()

    return run


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


_SHARED = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, owner) sorted by token, the tokens that stand in several rows.

    Tokens with up to FEW rows give their pairs of owners (token null), the others a row (token, owner, null) for each
    owner; what a task has given for the same owners within its last RUN such rows isn't repeated. Most tokens stand in
    one row, and go first.
    """
    rows: list[np.ndarray] = []
    several: list[np.ndarray] = []
    size, kept, cut_run = 0, 0, False  # cut_run: rows begin inside a run that was given in part

    def members(token, owner):
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(owner), pa.nulls(len(token), pa.int64())], schema=_SHARED)

    def sift(token, owner, ends_inside):
        """The rows of whole runs of several, and those of runs that are cut."""
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(start, len(token)))
        whole = np.ones(len(start), bool)
        whole[0] = not cut_run
        whole[-1] &= not ends_inside
        more, part = np.repeat(whole & (count > 1), count), np.repeat(~whole, count)
        return np.stack([token[more], owner[more]]), np.stack([token[part], owner[part]])

    def give():
        token, owner = np.concatenate(several, axis=1)
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(start, len(token)))
        with np.errstate(over="ignore"):
            mixed = tb.mix(owner.view(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))  # mix(0) is 0, and a row may be 0
            key = np.stack([np.add.reduceat(mixed, start), np.add.reduceat(tb.mix(mixed), start)])
        once = np.zeros(len(start), bool)
        once[np.unique(key, axis=1, return_index=True)[1]] = True
        pairs = []
        for c in range(2, FEW + 1):
            at = start[once & (count == c)]
            i, j = np.triu_indices(c, 1)
            pairs.append(np.stack([owner[(at[:, None] + i).ravel()], owner[(at[:, None] + j).ravel()]]))
        pairs = np.concatenate(pairs, axis=1)
        pairs = np.unique(np.sort(pairs, axis=0), axis=1) if pairs.size else pairs
        if pairs.size:
            yield pa.RecordBatch.from_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(pairs[0]), pa.array(pairs[1])], schema=_SHARED)
        many = np.repeat((count > FEW) & once, count)
        if many.any():
            yield members(token[many], owner[many])

    def blocks():
        """(tokens, owners, ends_inside) of at least RUN rows, cut before the last run if there are others."""
        nonlocal rows, size, cut_run
        for batch in batches:
            if not batch.num_rows:
                continue
            rows.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            size += batch.num_rows
            if size < RUN:
                continue
            token, owner = np.concatenate(rows, axis=1)
            cut = int(np.searchsorted(token, token[-1]))
            if cut:
                yield token[:cut], owner[:cut], False
                rows, size, cut_run = [np.stack([token[cut:], owner[cut:]])], len(token) - cut, False
            else:
                yield token, owner, True
                rows, size, cut_run = [], 0, True
        if rows:
            yield *np.concatenate(rows, axis=1), False

    for block in blocks():
        more, part = sift(*block)
        if part.size:
            yield members(*part)
        if more.size:
            several.append(more)
            kept += more.shape[1]
        if kept >= RUN:
            yield from give()
            several, kept = [], 0
    if several:
        yield from give()


def _pair_edges(percent: int):
    """Of pairs with sizes and bitmaps (n, m, x, y), the edges (a, b) that these allow."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            w = np.minimum(width(n), width(m))
            fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            keep = np.zeros(len(n), bool)
            x, y = batch.column("x"), batch.column("y")
            for v in np.unique(w[fits]):
                rows = np.flatnonzero(fits & (w == v))
                for a in range(0, len(rows), 1 << 22 >> int(v).bit_length()):
                    at = rows[a : a + (1 << 22 >> int(v).bit_length())]
                    most = _most(n[at], _bits(x.take(pa.array(at)).to_pylist(), int(v)), m[at], _bits(y.take(pa.array(at)).to_pylist(), int(v)))
                    keep[at] = most >= _needed(n[at], m[at], percent)
            if keep.any():
                keep = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], schema=_EDGE)

    return work


def _distinct(run: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A run with one row of each owner, and the owners."""
    owners, first = np.unique(run.column("owner").to_numpy(), return_index=True)
    return run.take(pa.array(first)), owners


def _bucket_edges(percent: int):
    def work(run: pa.Table) -> list[tuple[int, int]]:
        run, ids = _distinct(run)
        if len(ids) < 2:
            return []
        return [(int(ids[a]), int(ids[b])) for a, b in connect_all(run.column("n").to_numpy(), run.column("bitmap").to_pylist(), percent)]

    return work


def _chunk_edges(n: int, percent: int):
    def work(run: pa.Table) -> list[tuple[int, int]]:
        run, ids = _distinct(run)
        if len(ids) < 2:
            return []
        if "text" in run.column_names:
            sets = [s for _, some in set_slices(run.column("text"), n) for s in some]
        else:
            sets = [np.frombuffer(x, np.uint64) for x in run.column("tokens").to_pylist()]
        group = left = None
        if "group" in run.column_names:
            group, left = run.column("group").to_numpy(), run.column("left").to_numpy()
        edges = connect_all(np.array([len(s) for s in sets]), [_bitmap(s) for s in sets], percent, sets, group, left)
        return [(int(ids[a]), int(ids[b])) for a, b in edges]

    return work


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    Words are runs of non-space bytes of the text with A-Z lower-cased. A document's set holds its distinct n-word
    shingles, or its whole sequence if it has fewer words; it is empty without words or text. Documents link when
    100 * intersection >= percent * union; component_id is the least doc_id reachable by links, itself included.
    A document with an empty set links with nothing. Repeated rows are documents of their own, one result each. A row
    without doc_id counts for the links of others and has component_id null if no row it reaches has an id.
    Other columns of docs take no part. Empty input gives an empty result.

    keyed: docs is a written table, and its doc_ids are distinct, not null and count up from a few numbers; its texts are
    read again then, not copied. Tables that the result doesn't read are deleted on the way.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    small_batches(spark)
    sketches, sketches_at = stored(_sketches(docs, n, percent, _frequent(docs, n), keyed), "jaccard-sketches")
    ids = written(sketches.select("row", "doc_id", "n_shingles", "set_id"), "jaccard-ids")
    # a class is known by the least row that has its set, whatever ids the rows have
    classes = ids.where("set_id is not null").groupBy("set_id").agg(F.min("row").alias("owner"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "jaccard-classes")
    owners = rows_among(sketches.drop("text").withColumnRenamed("row", "owner"), "owner", classes)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = batch.column(1).to_pylist()
            for a in range(0, len(prefixes), 2000):
                part = prefixes[a : a + 2000]
                tokens = np.frombuffer(b"".join(part), np.int64)
                at = np.repeat(np.arange(len(part)), [len(p) // 8 for p in part])
                yield pa.RecordBatch.from_arrays([pa.array(tokens), batch.column(0).slice(a, len(part)).take(pa.array(at))], ["token", "owner"])

    tokens = owners.select("owner", "prefix").mapInArrow(unpack, "token long, owner long")
    shared = tokens.repartition("token").sortWithinPartitions("token").mapInArrow(_shared_tokens, "token long, a long, b long")
    shared, shared_at = stored(shared, "jaccard-tokens")
    small = owners.select("owner", F.col("n_shingles").alias("n"), "bitmap")
    # sizes first: most pairs that share a rare token differ too much in them, and go before bitmaps are dealt
    pairs = shared.where("token is null").select("a", "b").distinct().join(small.select(F.col("owner").alias("a"), "n"), "a").join(small.select(F.col("owner").alias("b"), F.col("n").alias("m"), F.col("bitmap").alias("y")), "b")
    pairs = pairs.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).join(small.select(F.col("owner").alias("a"), F.col("bitmap").alias("x")), "a")
    pairs = stars_made(pairs, _pair_edges(percent))
    members = shared.where("token is not null").select("token", F.col("a").alias("owner"))
    # a bucket beyond a chunk becomes part of one block as it is; its block's chunks go through their trees below
    large = bounded_broadcast(members.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("owner").alias("head")).where(F.col("c") > CHUNK).select("token", "head"), 24)
    joined = members.join(large, "token").select(F.col("owner").alias("a"), F.col("head").alias("b"))
    buckets = members.join(large, "token", "left_anti").join(small, "owner").select("token", "owner", "n", "bitmap")
    maybe = pairs.unionByName(stars_made(buckets.repartition("token").sortWithinPartitions("token"), _runs("token", _bucket_edges(percent), _EDGE))).unionByName(stars(joined))
    blocks = written(components(maybe, "jaccard-blocks").select(F.col("node").alias("owner"), F.col("component").alias("block")), "jaccard-blocks")
    drop(spark, shared_at)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, sets in set_slices(batch.column(1), n):
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["owner", "tokens"])

    wide = blocks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")).where("chunks > 1")
    several_blocks = not wide.isEmpty()
    sized = blocks.join(bounded_broadcast(wide, 24), "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("owner"), F.col("chunks")))
    texts = docs.select(F.col("doc_id").alias("owner"), "text") if keyed else sketches.select(F.col("row").alias("owner"), "text")
    # every chunk of a block with the block's first class in it
    first = sized.where("owner = block and chunks > 1").select("owner", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    rows = sized.select("owner", "block", "chunk").unionByName(first).select(F.xxhash64("block", "chunk").alias("key"), "owner")
    rows = rows_among(texts, "owner", blocks).join(bounded_broadcast(rows, 24), "owner").select("key", "owner", "text")
    edges = stars_made(rows.repartition("key").sortWithinPartitions("key"), _runs("key", _chunk_edges(n, percent), _EDGE))
    found = components(edges, "jaccard-groups")
    if several_blocks:  # what isn't in a block's largest group meets every chunk
        several = sized.where("chunks > 1").join(found.withColumnRenamed("node", "owner"), "owner", "left").withColumn("group", F.coalesce("component", "owner"))
        several = written(several, "jaccard-several")
        sets, sets_at = stored(rows_among(texts, "owner", several).mapInArrow(exact, "owner long, tokens binary"), "jaccard-sets")
        sizes = several.groupBy("block", "group").agg(F.count(F.lit(1)).alias("c"))
        main = sizes.groupBy("block").agg(F.max_by("group", F.struct("c", "group")).alias("main"))
        several = several.join(bounded_broadcast(main, 24), "block").withColumn("left", F.col("group") != F.col("main"))
        counts = several.where("left").groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
        part = several.join(bounded_broadcast(counts, 24), "block")
        slots = part.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).select("owner", "block", "group", "part", "chunk", F.lit(False).alias("left"))
        lefts = part.where("left").withColumn("part", F.pmod(F.xxhash64("owner", F.lit(7)), F.col("parts"))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).select("owner", "block", "group", "part", "chunk", "left")
        both = lefts.unionByName(slots).groupBy("owner", "block", "group", "part", "chunk").agg(F.max("left").alias("left"))
        both = both.join(sets, "owner").select(F.xxhash64("block", "part", "chunk").alias("key"), "owner", "tokens", "group", "left")
        more = stars_made(both.repartition("key").sortWithinPartitions("key"), _runs("key", _chunk_edges(n, percent), _EDGE))
        found = components(stars(found.select(F.col("node").alias("a"), F.col("component").alias("b"))).unionByName(more), "jaccard-components")
        drop(spark, sets_at)
    drop(spark, sketches_at)
    top = classes.join(found.withColumnRenamed("node", "owner"), "owner", "left").withColumn("component", F.coalesce("component", "owner")).where("copies > 1 or component <> owner or least is null")
    top = written(top.unionByName(classes.join(found.select(F.col("component").alias("owner")).distinct(), "owner").withColumn("component", F.col("owner"))).dropDuplicates(["owner"]).select("set_id", "least", "component"), "jaccard-result")
    least = top.groupBy("component").agg(F.min("least").alias("component_id"))
    final = top.join(bounded_broadcast(least, 24), "component").select("set_id", "component_id", F.lit(True).alias("linked"))
    out = ids.select("doc_id", "n_shingles", "set_id").join(bounded_broadcast(final, 64), "set_id", "left")
    # a row whose set no other row has or is linked with stands for itself
    return out.select("doc_id", "n_shingles", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
