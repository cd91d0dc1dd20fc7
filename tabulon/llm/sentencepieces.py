"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into units where no piece of the vocabulary can reach across, so that a text's pieces are those of its
units. Every distinct unit is a small lattice: its substrings of bounded length are exploded and equi-joined to the
piece table, the edges are grouped by unit, and a fold with Spark's higher-order aggregate picks the path: Viterbi's
best path for a unigram model, the merges in order of score for a BPE model (whose pieces are no best path: the fold
removes one inner boundary a step). Characters without a piece fall back to bytes.

Documents are dealt to blocks of about BLOCK bytes. A unit is encoded once for the whole corpus and its ids go once to
every block that needs it; a block's documents are then put together from its units. No row is made for a
word's occurrence, and a task holds one block's distinct units and a few megabytes of text at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import textbytes as tb
from tabulon.llm.tables import small_batches

#: Bytes of text in a block; longer units (in bytes) are encoded where they stand, as a fold's cost grows with the square.
BLOCK, LONG = 64 << 20, 60
#: Bytes of text for a part of the units, and most parts (the units grow far slower than the text).
PART, PARTS = 4 << 20, 10_000
_MARK = "▁"
_GROUP = 62  # blocks in a bit mask


@lru_cache(maxsize=4)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class Pieces:
    """The piece table of a SentencePiece model file, with spaces for its space marks."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        if model.decode(model.encode("  a b ")) != "  a b ":
            raise ValueError("models that change white space aren't supported")
        control = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = model.unk_id()
        self.fallback = all(model.is_byte(i) for i in self.byte)
        normal = [i for i in range(n) if i not in control and not model.is_byte(i)]
        self.rows = [(self.names[i].replace(_MARK, " "), i, float(model.get_score(i))) for i in normal]
        self.longest = max(len(p) for p, _, _ in self.rows)
        probe = "".join(p for p, _, _ in sorted(self.rows, key=lambda r: -len(r[0]))[:40])
        self.bpe = model.encode(probe) == _merge_ids(self, probe)
        #: For bytes before and after a boundary of characters: whether some piece has them inside.
        self.inside = np.zeros((256, 256), bool)
        for p, _, _ in self.rows:
            chars = [c.encode() for c in p]
            for a, b in zip(chars[:-1], chars[1:], strict=True):
                self.inside[a[-1], b[0]] = True
        self.inside[:, 0x80:0xC0] = True  # inside a character


def _merge_ids(pieces: Pieces, text: str) -> list[int]:
    """BPE by plain merging, to tell the two kinds of models apart."""
    ids = {p: (-s, i) for p, i, s in pieces.rows}
    parts = [*(" " + text)]
    while True:
        best = min(((ids[parts[k] + parts[k + 1]][0], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in ids), default=None)
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [i for p in parts for i in ([ids[p][1]] if p in ids else [pieces.byte[b] for b in p.encode()] if pieces.fallback else [pieces.unknown])]


def _prefixed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with a space in front (not of empty ones) and spaces for space marks."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), _MARK, " ")
    return tb.buffers(pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string()))))


def _unit_slices(column: pa.Array, inside: np.ndarray):
    """For each slice: first text, last text, bytes, starts, ends, first unit of each text and end, hashes."""
    for first, last in tb.slices(tb.buffers(column)[1]):
        part, own = _prefixed(column.slice(first, last - first))
        cut = np.zeros(len(part) + 1, bool)
        if len(part):
            cut[1:-1] = ~inside[part[:-1], part[1:]]
            cut[own[:-1][own[:-1] < len(part)]] = True
        starts = np.flatnonzero(cut[:-1]) if len(part) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(part)) if len(starts) else starts
        yield first, last, part, starts, ends, np.searchsorted(starts, own), tb.hashes(part, starts, ends)


def _strings(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = part[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _units(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """unit, g and mask (the blocks that need it) for every distinct short unit that a task meets, of docs (block, text)."""
    inside = pieces.inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def merged():
            key, g, mask = (np.concatenate([h[i] for h in held]) for i in range(3))
            text = pa.concat_arrays([h[3] for h in held])
            order = np.lexsort((g, key))
            new = np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (g[order][1:] != g[order][:-1])]))
            at = order[new]
            return key[at], g[at], np.bitwise_or.reduceat(mask[order], new), text.take(pa.array(at))

        def batch_of(key, g, mask, text):
            return pa.RecordBatch.from_arrays([text, pa.array(g), pa.array(mask)], ["unit", "g", "mask"])

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for first, last, part, starts, ends, at, hashed in _unit_slices(batch.column(1), inside):
                block = np.repeat(blocks[first:last], np.diff(at))
                short = ends - starts <= LONG
                hashed, starts, ends, block = hashed[short], starts[short], ends[short], block[short]
                if not len(hashed):
                    continue
                g, bit = block // _GROUP, np.left_shift(np.int64(1), block % _GROUP)
                order = np.lexsort((g, hashed)) if g.any() else np.argsort(hashed)
                h, gs = hashed[order], g[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (gs[1:] != gs[:-1])]))
                one = order[new]
                held.append((h[new], gs[new], np.bitwise_or.reduceat(bit[order], new), _strings(part, starts[one], ends[one])))
                size += len(new)
                if size > 400_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 350_000:
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield batch_of(*merged())

    return docs.select("block", "text").mapInArrow(run, "unit string, g long, mask long")


def _literal(numbers) -> str:
    """A constant array in SQL, which the optimizer folds; as a column it would be copied into every row."""
    return f"cast(split('{','.join(map(str, numbers))}', ',') as array<int>)"


def _spread(units: DataFrame, least: int, longest: int) -> DataFrame:
    """A row for every substring of a unit, of least to longest characters."""
    spread = units.withColumn("n", F.length("unit")).withColumn("start", F.explode_outer(F.expr(f"if(n < {least}, null, sequence(0, n - {least}))")))
    spread = spread.withColumn("size", F.explode_outer(F.expr(f"if(start is null, null, sequence({least}, least({longest}, n - start)))")))
    return spread.withColumn("piece", F.expr("substring(unit, start + 1, size)"))


def _piece_table(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """A few ten thousand rows of a model file, whatever the corpus. As Arrow data they start no Python workers, which would stay a while."""
    return spark.createDataFrame(pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(columns.items())}))


def _bpe_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """The merges of every unit, as a fold over its edges in order of (score, start); the state is a bit mask of boundaries.

    An edge merges if both its ends are boundaries and one boundary is left inside. In one pass over the edges that is
    the greedy order, unless an edge whose turn is over gets mergeable later; only pieces with a part that scores worse
    can, and a unit where that might happen is folded again, with the first mergeable edge in every step.
    """
    scores = {p: s for p, _, s in pieces.rows}
    rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}

    def late(p: str) -> bool:
        parts = ((p[:k], p[k:]) for k in range(1, len(p)))
        return any(x in scores and len(x) > 1 and scores[x] <= scores[p] for pair in parts for x in pair)

    joined = [(p, rank[s], i << 1 | late(p)) for p, i, s in pieces.rows if len(p) > 1]
    table = _piece_table(units.sparkSession, joined, piece=pa.string(), rank=pa.int64(), id=pa.int64())
    edges = _spread(units, 2, pieces.longest).join(F.broadcast(table), "piece", "left").where("id is not null or start is null or (start = 0 and size = 2)")
    edge = F.expr("""if(id is null, null, struct(((rank * 64 + start) << 21) + id as o,
        shiftleft(1L, start) | shiftleft(1L, start + size) as ends, shiftleft(1L, start + size) - shiftleft(2L, start) as inside))""")
    others = [c for c in units.columns if c != "unit"]
    lattice = edges.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"), *[F.first(c).alias(c) for c in others]).withColumn("n", F.length("unit"))
    once = F.expr(f"""aggregate(edges, shiftleft(2L, n) - 1, (b, e) -> if((b & e.ends) <> e.ends, b,
        if(bit_count(b & e.inside) = 1, b & ~e.inside, if(e.o & 1 = 1, b | {1 << 62}L, b))))""")
    again = F.expr("""if(shiftright(b, 62) = 0, b, aggregate(sequence(1, n), shiftleft(2L, n) - 1, (b, _) -> transform(
        array(get(filter(edges, e -> (b & e.ends) = e.ends and bit_count(b & e.inside) = 1), 0)), e -> if(e is null, b, b & ~e.inside))[0]))""")
    chars = {ord(p): i for p, i, _ in pieces.rows if len(p) == 1}
    table = np.full(max(chars) + 2, -1)
    table[[*chars]] = [*chars.values()]
    if pieces.fallback:
        missing = "transform(filter(split(hex(encode(substring(unit, i + 1, 1), 'utf-8')), '(?<=\\\\G..)'), h -> h <> ''), (h, j) -> i * 4294967296L + j * 16777216L + get(" + _literal(pieces.byte) + ", cast(conv(h, 16, 10) as int)))"
    else:
        missing = f"array(i * 4294967296L + {pieces.unknown})"
    single = f"""flatten(transform(filter(sequence(0, n - 1), i -> shiftright(b, i) & 3 = 3), i -> transform(array(coalesce(get({_literal(table)}, ascii(substring(unit, i + 1, 1))), -1)),
        c -> if(c >= 0, array(i * 4294967296L + c), {missing}))[0]))"""
    several = "transform(filter(edges, e -> (b & e.ends) = e.ends and (b & e.inside) = 0), e -> (shiftright(e.o, 21) & 63) * 4294967296L + (shiftright(e.o, 1) & 1048575))"
    ids = F.expr(f"transform(array_sort(concat({several}, {single})), x -> cast(x & 16777215 as int))")
    lattice = lattice.withColumn("b", once).withColumn("b", again)
    return lattice.select("unit", ids.alias("ids"), *others)


def _unigram_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """The path with the best sum of scores through every unit's lattice; a character without a piece costs more than any piece."""
    low = min(s for _, _, s in pieces.rows) - 10
    table = _piece_table(units.sparkSession, pieces.rows, piece=pa.string(), id=pa.int32(), score=pa.float64())
    edges = _spread(units, 1, pieces.longest).join(F.broadcast(table), "piece", "left").where("id is not null or (start = 0 and size = 1)")
    edge = F.expr("if(id is null, null, struct(start as a, start + size as z, id as id, score as s))")
    others = [c for c in units.columns if c != "unit"]
    lattice = edges.groupBy("unit").agg(F.collect_list(edge).alias("edges"), *[F.first(c).alias(c) for c in others]).withColumn("n", F.length("unit"))
    path = F.expr(f"""aggregate(sequence(1, n), array(struct(cast(0 as double) as s, cast(array() as array<struct<a:int,id:int>>) as p)), (best, j) -> concat(best, array(
        transform(array(array_max(concat(array(struct(best[j - 1].s + {low}D as s, 1 - j as f, -1 as id)),
            transform(filter(edges, e -> e.z = j), e -> struct(best[e.a].s + e.s as s, -e.a as f, e.id as id))))),
        m -> struct(m.s as s, concat(best[-m.f].p, array(struct(-m.f as a, m.id as id))) as p))[0])), best -> best[n].p)""")
    byte = "transform(filter(split(hex(encode(substring(unit, x.a + 1, 1), 'utf-8')), '(?<=\\\\G..)'), h -> h <> ''), h -> get(" + _literal(pieces.byte) + ", cast(conv(h, 16, 10) as int)))"
    ids = F.expr(f"flatten(transform(p, x -> if(x.id >= 0, array(x.id), {byte if pieces.fallback else f'array({pieces.unknown})'})))")
    return lattice.withColumn("p", path).select("unit", ids.alias("ids"), *others)


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """units (distinct, not empty, up to 60 characters) with ids: the lattice and its fold. Keeps a partitioning by unit."""
    return (_bpe_units if pieces.bpe else _unigram_units)(units, pieces)


def encode(docs: DataFrame, model: str, block: int = BLOCK, decoded: str | None = None) -> DataFrame:
    """docs with ids (array of int), which replaces a column of that name: the model's piece ids of each whole text.

    They equal SentencePiece's own. Null and empty texts have no ids. Repeated rows are encoded alike; an empty table
    gives an empty result. decoded names a column for the text of the ids, which equals decode()'s: the workers that put
    the ids together make it, where decode() over encode() keeps a second worker for every task.
    """
    docs = docs.drop("ids", *([decoded] if decoded else []))
    small_batches(docs.sparkSession)
    pieces = pieces_of(model)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block))
    names = docs.columns
    at = names.index("text")
    # by place, not by content: copies of a text spread over the blocks. A row that a repeated read gives another place
    # finds a unit missing in its block, which is then encoded in place
    block_of = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("long").alias("__block")
    units = _units(docs.select(block_of, "text").withColumnRenamed("__block", "block"), pieces)
    # a unit has some thirty edges: parts are small, whatever the planner thinks of the bytes shuffled
    units = units.repartition(int(min(PARTS, max(1, total // PART))), "unit").groupBy("unit", "g").agg(F.bit_or("mask").alias("mask"))
    units = units.groupBy("unit").agg(F.collect_list(F.struct("g", "mask")).alias("needs"))
    low = f"filter(sequence(0, {_GROUP - 1}), b -> (shiftright(x.mask, b) & 1) = 1)"
    needs = F.expr(f"flatten(transform(needs, x -> transform({low}, b -> x.g * {_GROUP} + b)))")
    coded = encode_units(units, pieces).select("unit", "ids", needs.alias("blocks")).mapInArrow(_dictionary, _BUNDLE)
    schema = docs.select("*", F.lit(None).cast("array<int>").alias("ids"), *([F.lit("").alias(decoded)] if decoded else [])).schema
    texts = _texts(pieces) if decoded else None
    both = coded.unionByName(docs.select(block_of, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(_bundles, _BUNDLE))
    inside, path = pieces.inside, model

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library, current, fresh = None, None, True
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        key = ids = size = start = None
        for batch in batches:
            for block, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block != current:
                    current, held, fresh = block, [], True
                part = tb.opened(payload)
                if kind == 0:
                    held.append((part.column(0).to_numpy().view(np.uint64), part.column(1).flatten().to_numpy(), part.column(1).value_lengths().to_numpy()))
                    fresh = True
                    continue
                if fresh:
                    key = np.concatenate([np.zeros(0, np.uint64), *(h[0] for h in held)])
                    ids = np.concatenate([np.zeros(0, np.int32), *(h[1] for h in held)])
                    size = np.concatenate([np.zeros(0, np.int64), *(h[2] for h in held)]).astype(np.int64)
                    start = np.cumsum(size) - size
                    order = np.argsort(key)
                    key, start, size = key[order], start[order], size[order]
                    held, fresh = [], False
                for first, last, data, starts, ends, at_unit, hashed in _unit_slices(part.column(at), inside):
                    where = np.minimum(np.searchsorted(key, hashed), max(0, len(key) - 1))
                    long = np.flatnonzero((ends - starts > LONG) | (key[where] != hashed)) if len(key) else np.arange(len(hashed))
                    here, begin, flat = (size[where].copy(), start[where].copy(), ids) if len(key) else (np.zeros(len(hashed), np.int64), np.zeros(len(hashed), np.int64), ids)
                    if len(long):
                        library = library or sentencepiece.SentencePieceProcessor(model_file=path)
                        own = [_library_ids(library, bytes(data[starts[i] : ends[i]]).decode()) for i in long]
                        begin[long] = len(flat) + np.cumsum([0, *map(len, own)])[:-1]
                        here[long] = [len(x) for x in own]
                        flat = np.concatenate([flat, *(np.array(x, np.int32) for x in own)])
                    total = np.concatenate([[0], np.cumsum(here)])
                    out = flat[np.repeat(begin - total[:-1], here) + np.arange(total[-1])]
                    rows = pa.ListArray.from_arrays(pa.array(total[at_unit].astype(np.int32)), pa.array(out.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*(part.column(i).slice(first, last - first) for i in range(len(names))), rows, *([texts(rows)] if texts else [])], names=schema.names)
        held = key = ids = size = start = part = None
        tb.trim(0)

    parts = int(min(PARTS, blocks))  # by number: hashes of a few blocks would put several into one task
    return both.repartitionById(parts, F.pmod("__block", F.lit(parts)).cast("int")).sortWithinPartitions("__block", "__kind").mapInArrow(assemble, schema)


_BUNDLE = "__block long, __kind int, payload binary"


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a block in front as compressed bundles of a block, of about a megabyte or one row."""
    held: dict[int, list[pa.RecordBatch]] = {}
    size: dict[int, int] = {}

    def bundle(block):
        table = pa.Table.from_batches(held.pop(block)).combine_chunks()
        size.pop(block)
        for b in table.to_batches():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([1], pa.int32()), pa.array([tb.closed(b)], pa.binary())], ["__block", "__kind", "payload"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        rest = batch.drop_columns([batch.schema.names[0]])
        step = max(1, int(batch.num_rows * (1 << 22) / max(1, batch.nbytes)))
        for a in range(0, batch.num_rows, step):
            own = blocks[a : a + step]
            for block in np.unique(own):
                part = rest.take(pa.array(a + np.flatnonzero(own == block)))
                held.setdefault(int(block), []).append(part)
                size[int(block)] = size.get(int(block), 0) + part.nbytes
                if size[int(block)] > 1 << 20:
                    yield from bundle(int(block))
        while sum(size.values()) > 16 << 20:  # many blocks: the largest go first
            yield from bundle(max(size, key=size.get))
    for block in [*held]:
        yield from bundle(block)


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of units with ids and the blocks that need them: for every block a compressed table of unit hashes and ids."""
    for batch in batches:
        data, offsets = tb.buffers(pc.replace_substring(batch.column(0).cast(pa.large_string()), _MARK, " "))
        keys = np.concatenate([np.zeros(0, np.uint64), *(tb.hashes(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a]) for a, b in tb.slices(offsets))])
        blocks = batch.column(2)
        unit = np.repeat(np.arange(batch.num_rows), blocks.value_lengths().to_numpy())
        block = blocks.flatten().to_numpy()
        ids = batch.column(1).cast(pa.list_(pa.int32()))
        for k in np.unique(block):
            rows = unit[block == k]
            rows = rows[np.argsort(keys[rows])]
            part = pa.RecordBatch.from_arrays([pa.array(keys[rows].view(np.int64)), ids.take(pa.array(rows))], ["key", "ids"])
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int64()), pa.array([0], pa.int32()), pa.array([tb.closed(part)], pa.binary())], ["__block", "__kind", "payload"])


def _library_ids(library, unit: str) -> list[int]:
    """The ids of one unit: behind a mark that forms a unit of its own, as no piece has a line end."""
    head = library.encode("\n")
    if unit.startswith(" "):
        return library.encode(unit[1:]) if unit[1:2] != "" else library.encode("\n" + unit)[len(head) :]
    return library.encode("\n" + unit)[len(head) :]


def _texts(pieces: Pieces) -> Callable[[pa.ListArray], pa.Array]:
    """What makes the texts of a column of ids."""
    byte = {i: b for b, i in enumerate(pieces.byte)} if pieces.fallback else {}
    normal = {i: p for p, i, _ in pieces.rows}
    table = [bytes([byte[i]]) if i in byte else normal.get(i, "").encode() for i in range(len(pieces.names))]
    size = np.array([len(x) for x in table])
    start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(table), np.uint8)

    def texts(column: pa.ListArray) -> pa.Array:
        out = []
        for x in column:
            if x.values is None:
                out.append(None)
                continue
            x = x.values.to_numpy()
            parts = []
            for a in range(0, len(x), 1 << 18):
                y = x[a : a + (1 << 18)]
                n = size[y]
                parts.append(flat[np.repeat(start[y] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
            out.append(b"".join(parts).decode("utf-8", "replace").removeprefix(" "))
        return pa.array(out, pa.string())

    return texts


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of its ids: the pieces' bytes joined, marks as spaces, without the first space.

    Null ids decode to null, none to the empty text; control pieces have no text, bytes that are no UTF-8 become
    replacement characters.
    """
    texts = _texts(pieces_of(model))
    small_batches(df.sparkSession)
    df = df.drop(out)
    schema = df.select("*", F.lit("").alias(out)).schema
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, texts(batch.column(at))], names=schema.names)

    return df.mapInArrow(run, schema)
