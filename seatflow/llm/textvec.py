"""Arrow text columns as byte arrays: spans and span hashes without a Python
step per word.

Texts of a batch lie end to end in one byte buffer.  A span's hash is its
polynomial in 64-bit arithmetic, taken from running sums, so any span costs
one subtraction and one product.  Work goes in slices of a few MB whatever the
batch holds; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so every power has an inverse


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def process_memory() -> dict:
    """What a Python worker keeps between tasks.  Functions travel to workers
    by value, so module variables start afresh with every task; this does not."""
    import sys
    import types

    name = "_seatflow_process_memory"
    return vars(sys.modules.setdefault(name, types.ModuleType(name)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and its inverse for i < n or more."""
    held = process_memory()
    if len(held.get("powers", ((),))[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        step = np.full(n, np.uint64(_BASE))
        back = np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)))
        step[0] = back[0] = 1
        held["powers"] = np.multiply.accumulate(step), np.multiply.accumulate(back)
    return held["powers"]


class Spans:
    """Hashes of byte spans of one buffer (after an optional byte mapping)."""

    def __init__(self, buf: np.ndarray, table: np.ndarray = _BYTE):
        p, self.q = _powers(len(buf) + 1)
        self.run = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(table[buf] * p[:len(buf)], out=self.run[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.run[end] - self.run[start]) * self.q[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    col = pc.fill_null(col, "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    buf = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    return buf[off[0]:off[-1]], off - off[0]


def slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about
    ``most`` bytes; a single row may be longer."""
    buf, off = text_buffer(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, buf[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode("latin-1"))] = True
    return out


SPACE = _flags(" \t\n\x0b\x0c\r")


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true bytes; runs stop at text borders."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[off] = True
    if len(inside) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end


def per_text(start: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Index of the first span of each text, and the number of spans at the end."""
    return np.searchsorted(start, off, "left")


def gather(pool: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[at[0]:at[0]+length[0]], then the next, end to end."""
    total = int(length.sum())
    if total == 0:
        return pool[:0]
    ends = np.cumsum(length)
    shift = np.repeat(at - (ends - length), length)
    return pool[shift + np.arange(total)]
