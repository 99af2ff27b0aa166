"""Vectorised word splitting and hashing over Arrow text columns.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09``-``\\x0d``.  UTF-8
never uses those bytes inside a character, so everything works on bytes.  Texts
are handled in pieces of about ``PIECE`` bytes cut at separators, which bounds
the temporary arrays for texts of any length.

Nulls count as empty texts; empty batches give empty arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 17

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW_BASE = np.uint64(0x9E3779B97F4A7C15)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE[SEPARATOR] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[LOWER]
Q = np.uint64(0xD6E8FEB86659FD93)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = powers(_POW_BASE, 4096)
_INDEX = np.arange(PIECE + 4096, dtype=np.int32)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its offsets, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


@dataclass
class Words:
    """hash[i]: of word i; first[d]: index of document d's first word (len d+1);
    start/end: byte ranges in the batch's bytes."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _piece(raw: np.ndarray, cut: np.ndarray, table: np.ndarray, separator: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of raw; cut: positions (bool, len raw) where a document begins."""
    global _POW
    sep = (raw == 32) | ((raw - np.uint8(9)) < 5) if separator is None else separator.take(raw)
    begin = ~sep
    fin = begin.copy()
    begin[1:] &= sep[:-1] | cut[1:]
    fin[:-1] &= sep[1:] | cut[1:]
    start = np.flatnonzero(begin)
    if not len(start):
        return np.zeros(0, np.uint64), start, start
    end = np.flatnonzero(fin) + 1
    longest = int((end - start).max())
    if longest > len(_POW):
        _POW = powers(_POW_BASE, 2 * longest)
    # separators weigh nothing, so each word may run to the next one's start
    gap = np.diff(start, append=len(raw))
    place = _INDEX[: len(raw) - start[0]] if len(raw) <= len(_INDEX) else np.arange(len(raw) - start[0], dtype=np.int32)
    place = place - np.repeat((start - start[0]).astype(np.int32), gap)
    value = table.take(raw[start[0] :])
    value *= _POW.take(place, mode="clip")
    return mix(np.add.reduceat(value, start - start[0])), start, end


def split_words(raw: np.ndarray, off: np.ndarray, lower: bool, cut: np.ndarray | None = None, separator: np.ndarray | None = None) -> Words:
    """The words of texts at off; cut: more places (len raw + 1) where a word
    ends, which is written to; separator: which of the 256 bytes part words, if
    not white space alone."""
    table = _BYTE_LOWER if lower else _BYTE
    if separator is not None:
        table = np.where(separator, np.uint64(0), table)
    n = len(raw)
    if cut is None:
        cut = np.zeros(n + 1, bool)
    cut[off] = True
    hashes, starts, ends = [], [], []
    a = 0
    while a < n:
        b = min(n, a + PIECE)
        while b < n:  # move the cut to a separator or a document's start
            near = np.flatnonzero((SEPARATOR if separator is None else separator)[raw[b : b + 512]] | cut[b : min(n, b + 512)])
            if len(near):
                b += int(near[0])
                break
            b = min(n, b + 512)
        h, s, e = _piece(raw[a:b], cut[a:b], table, separator)
        hashes.append(h)
        starts.append(s + a)
        ends.append(e + a)
        a = b
    if not hashes:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(off), np.int64), z, z)
    start = np.concatenate(starts)
    return Words(np.concatenate(hashes), np.searchsorted(start, off), start, np.concatenate(ends))


def strings_at(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> pa.Array:
    """The bytes from each start to its end as an Arrow string column."""
    size = end - start
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    data = raw[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    data = LOWER.take(data) if lower else data
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.string())


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring hashes, by doubling.

    Document borders are not looked at; the caller keeps the starts it may use.
    """
    if len(h) < size:
        return np.zeros(0, np.uint64)
    done, total, acc, step, length = 0, None, h, Q, 1
    shift = np.uint64(1)
    while True:
        if size & length:
            part = acc[done : done + len(h) - size + 1]
            total = part * shift if total is None else total + part * shift
            with np.errstate(over="ignore"):
                shift = shift * step
            done += length
        length <<= 1
        if length > size:
            break
        acc = acc[:-(length >> 1)] + acc[length >> 1 :] * step
        with np.errstate(over="ignore"):
            step = step * step
    return mix(total)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about ``most`` bytes of text each, so that
    temporary arrays stay small whatever Arrow's batch size is."""
    n = batch.num_rows
    if not n:
        return
    column = batch.column(batch.schema.get_field_index(text))
    size = np.array(pc.binary_length(column).fill_null(0)).astype(np.int64)
    part = np.cumsum(size) // most
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n]):
        yield batch.slice(a, b - a)
