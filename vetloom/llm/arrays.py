"""Vectorised text helpers shared by the operators: they run inside Arrow tasks.

A *text buffer* is the UTF-8 bytes of many texts, one behind the other, with
``offsets[i]:offsets[i + 1]`` the bytes of text ``i``.  Words are the maximal
runs of bytes outside ``\\x20 \\x09-\\x0D``, which is what the pattern
``[^\\x20\\x09-\\x0D]+`` finds, because no byte of a longer UTF-8 sequence is
one of those.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# Odd multipliers of the rolling hashes and the finaliser.
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_MIX_1, _MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
#: Bytes that one pass of the byte-level hash handles; bounds its temporary arrays.
PASS_BYTES = 1 << 20
_NOTHING, _BLANK = pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary())


def release() -> None:
    """Gives memory that is not in use back to the system; a worker that waits would keep it from others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of batches, with unused memory released at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of a group."""

    def tidied(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    return tidied


def tidy_groups(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups."""

    def tidied(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            release()

    return tidied


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text its first word's number (one more at the end)."""
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def normal_words(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, each with one space behind it; their spans; each text's first word."""
    spaced = pc.binary_join_element_wise(pc.fill_null(column.cast(pa.large_binary()), b""), _NOTHING, _BLANK)
    data, offsets = text_buffer(spaced)
    solid = ~SPACE[data]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    norm = data[keep]
    norm[SPACE[norm]] = 0x20
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    ends = np.flatnonzero(norm == 0x20)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1]) if len(ends) else ends
    return norm, starts, ends, np.searchsorted(starts, kept[offsets])


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> U64(33))
    h = h * U64(_MIX_1)
    h ^= h >> U64(33)
    h *= U64(_MIX_2)
    h ^= h >> U64(33)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 12)
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of bytes, which must be in order and apart."""
    out = np.empty(len(starts), U64)
    done = 0
    while done < len(starts):
        base = int(starts[done])
        stop = max(done + 1, int(np.searchsorted(ends, base + PASS_BYTES, side="right")))
        s, e = starts[done:stop] - base, ends[done:stop] - base
        n = int(e[-1])
        up, down = _BYTES.get(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum((data[base : base + n].astype(U64) + U64(1)) * up[:n], out=total[1:])
        out[done:stop] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))
        done = stop
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` consecutive values of ``words``."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    up, down = _WORDS.get(len(words) + 1)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[n:] - total[:count]) * down[:count])


def run_hashes(words: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hashes of the runs ``words[first:first + count]``."""
    up, down = _WORDS.get(len(words) + 1)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[first + count] - total[first]) * down[first] + count.astype(U64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    span, low = 1, values
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def concat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``starts[i] .. starts[i] + lengths[i] - 1``, one behind the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    at = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - at, lengths)


def ranges_equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each i, whether the ``lengths[i]`` bytes at ``a[i]`` and ``b[i]`` are the same."""
    out = np.ones(len(a), bool)
    done = 0
    ends = np.cumsum(lengths)
    while done < len(a):
        before = int(ends[done - 1]) if done else 0
        stop = max(done + 1, int(np.searchsorted(ends, before + PASS_BYTES, side="right")))
        n = lengths[done:stop]
        same = data[concat_ranges(a[done:stop], n)] == data[concat_ranges(b[done:stop], n)]
        bad = np.flatnonzero(~same)
        out[done + np.searchsorted(np.cumsum(n), bad, side="right")] = False
        done = stop
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in the smallest unsigned type that holds them all."""
    most = int(values.max(initial=0))
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed string."""
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64).tobytes()
    kinds = "".join(f"{x.dtype.str:<4}" for x in arrays).encode()
    return zstandard.ZstdCompressor(level=3).compress(head + kinds + b"".join(x.tobytes() for x in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of :func:`pack`."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at, out = 8 * (n + 1), []
    kinds = [raw[at + 4 * i : at + 4 * i + 4].decode().strip() for i in range(n)]
    at += 4 * n
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        kind = np.dtype(kind)
        out.append(np.frombuffer(raw, kind, size // kind.itemsize, at))
        at += size
    return out


def steps(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes each, one row at least."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        yield start, stop
        start = stop


def text_steps(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a text column that hold about ``size`` bytes each."""
    return steps(text_buffer(column)[1], size)


def blobs(items: list[bytes]) -> pa.Array:
    """A binary column."""
    return pa.array(items, pa.binary())
