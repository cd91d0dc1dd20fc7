"""Byte-level text kernels shared by the operators.

All of them work on the UTF-8 bytes of an Arrow string column with numpy, a slice of some hundred kilobytes at a time,
so memory doesn't depend on the number of rows of a batch. A text longer than a slice is a slice of its own: a task
needs some dozen times the bytes of its longest text. A null text counts as empty.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Workers stay between tasks: they should give freed memory back rather than keep it.
pa.set_memory_pool(pa.system_memory_pool())
trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)

SLICE, LONG_SPAN = 1 << 18, 256
#: The first k bytes of a little-endian word.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(ranges: list[tuple[int, int]], inside: bool = True) -> np.ndarray:
    """A table of 256 flags: the bytes in the (first, last) ranges, or all others."""
    table = np.full(256, not inside)
    for first, last in ranges:
        table[first : last + 1] = inside
    return table


#: Words `[^\x20\x09-\x0D]+`.
NOT_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)], inside=False)
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALNUM = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE):
    """(first, last) ranges of texts that hold at most limit bytes, or one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last
    trim(0)


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of the table's bytes, none across two texts, and each text's first run (n + 1)."""
    inside = table[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.empty(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0], edge[-1] = inside[0], inside[-1]
    at = offsets[1:-1]
    at = at[(at > 0) & (at < len(inside))]
    at = at[inside[at] & inside[at - 1]]
    marks = np.flatnonzero(edge)
    if len(at):  # a run goes on over the end of a text: cut it there
        at = np.unique(at)
        marks = np.sort(np.concatenate([marks, at, at]))
    starts, ends = marks[::2], marks[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h.copy()
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


_LENGTHS = mix(np.arange(1, LONG_SPAN + 3, dtype=np.uint64) << np.uint64(20))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans: eight bytes at a time are mixed into a state that begins with the length.

    The chain isn't linear in the bytes, so texts of a regular build (as repeated or self-similar ones) collide no more
    often than others. Spans over LONG_SPAN bytes are digested by BLAKE2b.
    """
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    h = _LENGTHS[np.minimum(size, LONG_SPAN + 1)]
    h ^= words[starts] & _MASKS[np.minimum(size, 8)]
    h = _stir(h)
    active = np.flatnonzero(size > 8)
    at, left = starts[active] + 8, size[active] - 8
    if len(active):
        short = size[active] <= LONG_SPAN
        active, at, left = active[short], at[short], left[short]
    while len(active):
        h[active] = _stir(h[active] ^ (words[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_SPAN):
        h[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), np.uint64)[0]
    return h


def _stir(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def word_slices(column: pa.Array, table: np.ndarray, lower: bool = True, limit: int = SLICE):
    """For each slice: (first text, last text, bytes, starts, ends, first word of each text and end, hashes)."""
    data, offsets = buffers(column)
    for first, last in slices(offsets, limit):
        part = data[offsets[first] : offsets[last]]
        if lower:
            part = LOWER[part]
        own = offsets[first : last + 1] - offsets[first]
        starts, ends, at = spans(part, own, table)
        yield first, last, part, starts, ends, at, hashes(part, starts, ends)


def closed(batch: pa.RecordBatch) -> bytes:
    """A batch as a compressed stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(payload: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload.as_buffer()).read_next_batch()
