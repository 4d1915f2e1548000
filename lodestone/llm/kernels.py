"""Vectorised work on Arrow text columns, shared by the operators of this subpackage.

Texts of a batch lie one after the other in one byte buffer. Words, lines and
windows are found and hashed over the whole buffer at once, without a Python
object for each word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_P = U64(0xD6E8FEB86659FD93)
_P_INV = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
CHUNK_BYTES = 1 << 18


def release() -> None:
    """Give freed memory back to the machine; a worker lives through many tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * _GOLDEN)


_BYTE = seeded(7, 256)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
BYTE_LOWER = _BYTE[_LOWER]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 2 * len(have)), _P if kind == "up" else _P_INV, U64)
            steps[0] = 1
            have = np.cumprod(steps, dtype=U64)
        _powers[kind] = have
    return have[:n]


class SpanHash:
    """Hashes of spans of a sequence in constant time each, from one pass over it."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, U64)
            np.cumsum(values * _power("up", n), out=self.sums[1:])
        self.down = _power("down", n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64) * _GOLDEN)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) for runs of rows of about most bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end
    release()


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of inside, cut at the rows' borders, and the number of runs before each row."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (first[:n] | ~before))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (first[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = BYTE_LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space; A-Z as a-z), and how many lie before each row."""
    starts, ends, at = spans(~SPACE[raw], offsets)
    return SpanHash(table[raw])(starts, ends), at


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n word hashes; of the whole sequence where it is shorter."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    m = len(h) - n + 1
    with np.errstate(over="ignore"):
        out = np.full(m, n, U64) * _GOLDEN
        for i in range(n):
            out = (out ^ h[i : i + m]) * _P + (out >> U64(29))
    return mix(out)


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the lists' lengths."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of a partition sorted by integer keys: tables of whole groups, and the groups' borders in them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        new = np.zeros(len(batch), bool)
        for k in keys:
            x = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
            if held:
                new[0] |= held[-1].column(k)[-1].as_py() != x[0]
        at = np.flatnonzero(new)
        if len(at):
            last = int(at[-1])
            whole = [*held, batch.slice(0, last)]
            if sum(map(len, whole)):
                yield _bordered(whole, keys)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield _bordered(held, keys)


def _bordered(batches: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches([b for b in batches if len(b)]).combine_chunks()
    new = np.zeros(len(t), bool)
    new[:1] = True
    for k in keys:
        x = t[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return t, np.append(np.flatnonzero(new), len(t))
