"""Vectorised text kernels on Arrow string buffers, shared by the operators.

A word is a run of bytes other than space and 0x09 to 0x0D. Everything works on
whole texts; ``pieces`` only bounds how many of them are in memory at a time.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PAD = 8
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Freed memory goes back to the system; glibc and Arrow would keep it, and a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; before each and after the last, what is free by then goes back to the system."""
    for batch in batches:
        give_back()
        yield batch
        del batch
    give_back()


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text each (a longer text comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def buffers(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column, nulls as empty, with PAD spaces at the end."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    out = np.full(off[-1] - off[0] + PAD, 32, np.uint8)
    if off[-1] > off[0]:
        part = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
        out[:-PAD] = LOWER[part] if lower else part
    return out, off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all words, and each row's range of word numbers (rows + 1)."""
    n = int(off[-1])
    solid = ~SPACE[data[:n]]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    some = off[:-1][off[:-1] < off[1:]]
    first[some] = solid[some]
    ends = off[1:][off[:-1] < off[1:]] - 1
    last[ends] = solid[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes a step."""
    view = np.ndarray(len(data) - PAD + 1, "<u8", data.data, strides=(1,))
    h = mix(lengths.astype(np.uint64) + np.uint64(seed) * _C1)
    todo, k = np.arange(len(starts)), 0
    while len(todo):
        left = lengths[todo] - k
        h[todo] = mix((h[todo] ^ (view[starts[todo] + k] & _MASK[np.minimum(left, 8)])) * _C1 + _C2)
        k += 8
        todo = todo[left > 8]
    return h


def strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Byte ranges as an Arrow string array."""
    ends = np.cumsum(lengths)
    index = np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[index].tobytes()))


def unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, where each first stands, and each row's number among them."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    inverse = np.empty(len(s), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return s[new], order[new], inverse


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values over ranges off[i]:off[i + 1]."""
    total = np.concatenate([np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]
