"""Numpy kernels over a batch of texts: word and line spans, span hashes, per-text sums.

The texts of a batch lie end to end in one byte array, as Arrow stores them, so
a step costs a few array operations per byte and none per text or word.  Words
are the maximal runs of bytes other than 0x20 and 0x09-0x0D; UTF-8 never uses
those bytes inside a character.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SEPARATOR = np.isin(np.arange(256), SEPARATORS)
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that multiplying by it loses nothing modulo 2^64
_SHORT = 64  # longest span, in bytes, that is hashed and compared by blocks
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)  # the first n bytes of a block


def slices(batch: pa.RecordBatch, text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` with at most ``limit`` bytes of text, or a single longer row."""
    ends = text_offsets(batch.column(text))[1:]
    at = done = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def text_offsets(col: pa.Array) -> np.ndarray:
    """Offsets of the texts of an Arrow string column in :func:`flat`'s bytes; a null is an empty text."""
    lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of an Arrow string column; text i is ``bytes[offsets[i]:offsets[i + 1]]``."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separates: np.ndarray = IS_SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, first)``: byte spans of all words, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = separates[data]
    edge = np.empty(n, bool)
    edge[0], edge[1:] = True, gap[:-1]
    edge[offsets[offsets < n]] = True
    start = np.flatnonzero(edge & ~gap)
    edge[-1], edge[:-1] = True, gap[1:]
    edge[offsets[offsets > 0] - 1] = True
    end = np.flatnonzero(edge & ~gap) + 1
    return start, end, np.searchsorted(start, offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines of all texts (split at newlines; an empty text has one empty line)."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    end = np.sort(np.concatenate((offsets[1:], breaks)), kind="stable")
    return start, end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all (in place)."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def join_hashes(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash per position of several, in order."""
    out = parts[0].astype(_U, copy=True)
    for p in parts[1:]:
        out *= _U(_BASE)
        out += p.astype(_U, copy=False)
        mix(out)
    return out


def _blocks(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number (zeros beyond the end)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span: its blocks of 8 bytes mixed in turn, or XXH64 beyond 64 bytes.

    A place of a block is a step over all spans that reach it, so the steps don't grow with the spans.
    """
    length = end - start
    out = mix(length.astype(_U) * _U(_BASE) + _U(_BASE))
    blocks = _blocks(data)
    some = np.flatnonzero((length > 0) & (length <= _SHORT))
    for at in range(0, _SHORT, 8):
        some = some[length[some] > at]
        if not len(some):
            break
        block = blocks[start[some] + at] & _KEEP[np.minimum(length[some] - at, 8)]
        out[some] = mix((out[some] ^ block) * _U(_BASE) + _U(at + 1))
    for i in np.flatnonzero(length > _SHORT):
        out[i] = xxhash.xxh64_intdigest(data[start[i]:end[i]].tobytes(), 0x5EED)
    return out


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the bytes of span ``i[k]`` equal those of span ``j[k]``, for every k; compared block by block."""
    length = end[i] - start[i]
    same = length == end[j] - start[j]
    blocks = _blocks(data)
    some = np.flatnonzero(same & (length <= _SHORT))
    for at in range(0, _SHORT, 8):
        some = some[length[some] > at]
        if not len(some):
            break
        differ = blocks[start[i[some]] + at] ^ blocks[start[j[some]] + at]
        same[some[differ & _KEEP[np.minimum(length[some] - at, 8)] != 0]] = False
    for k in np.flatnonzero(same & (length > _SHORT)):
        same[k] = np.array_equal(data[start[i[k]]:end[i[k]]], data[start[j[k]]:end[j[k]]])
    return same


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for every i, empty ones included."""
    out = np.zeros(len(bounds) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some], dtype=out.dtype)
    return out


def first_equal(keys: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each position the first one that equals it.

    ``keys`` are hashes: equal things have equal keys, and ``same(i, j)`` says which of the pairs ``i[k], j[k]`` are
    equal indeed.  Different things with one key are told apart one by one.
    """
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(keys) else np.zeros(0, np.int64)
    first = np.empty(len(keys), np.int64)
    first[order] = np.repeat(order[heads], np.diff(np.append(heads, len(keys))))
    moved = np.flatnonzero(first != np.arange(len(keys)))
    wrong = moved[~same(moved, first[moved])]
    for key in np.unique(keys[wrong]):
        leaders: list[int] = []
        for i in np.flatnonzero(keys == key):
            equal = [j for j in leaders if same(np.array([i]), np.array([j]))[0]]
            first[i] = equal[0] if equal else i
            if not equal:
                leaders.append(i)
    return first
