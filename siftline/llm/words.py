"""Vectorised word splitting and hashing of whole text columns.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return (``[^\\x20\\x09-\\x0D]+``).  All work is numpy over the Arrow buffers of a batch: no Python loop
touches single words.  Word hashes are 64-bit polynomials with a random value per byte; they are the same
in every process.  Temporary arrays of hashing are bounded by ``PIECE`` bytes of text; longer words are taken in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
CHUNK = 1 << 20
_U = np.uint64
_MUL = 0x9E3779B97F4A7C15 | 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit values from a fixed seed."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + _U(seed * 7919)) * _U(0x9E3779B97F4A7C15)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return out


def _tables(lower: bool) -> np.ndarray:
    t = _splitmix(256, 11) | _U(1)
    if lower:
        t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1]
    t[_space()] = 0
    return t


_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """``PIECE`` powers of an odd multiplier and of its inverse modulo 2**64."""
    if len(_POWERS.get("p", ())) < PIECE + 1:
        size = PIECE + 1
        for key, base in (("p", _MUL), ("i", pow(_MUL, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            done, step = 1, base
            while done < size:
                take = min(done, size - done)
                out[done : done + take] = out[:take] * _U(step)
                done += take
                step = step * step % (1 << 64)
            _POWERS[key] = out
    return _POWERS["p"], _POWERS["i"]


def text_chunks(column: pa.Array, limit: int = CHUNK):
    """Yield (first row, row after the last, bytes, offsets) of slices of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a chunk, and words per document."""
    n = len(off) - 1
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(n, np.int64)
    inside = ~_space()[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    full = off[:-1] < off[1:]
    at = off[:-1][full]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = off[1:][full] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, off))


def _long_hash(buf: np.ndarray, a: int, b: int, table: np.ndarray) -> int:
    """The polynomial of one long word, ``PIECE`` bytes at a time."""
    p, total, scale = _powers()[0], 0, 1
    for at in range(a, b, PIECE):
        vals = table[buf[at : min(at + PIECE, b)]]
        total += int((vals * p[: len(vals)]).sum(dtype=np.uint64)) * scale
        scale = scale * pow(_MUL, PIECE, 1 << 64) % (1 << 64)
    return total % (1 << 64)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    table, i = _tables(lower), 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + PIECE, "right"))
        if j <= i:
            out[i] = _long_hash(buf, int(starts[i]), int(ends[i]), table)
            i += 1
            continue
        a, b = int(starts[i]), int(ends[j - 1])
        p, q = _powers()
        vals = table[buf[a:b]]
        vals *= p[: b - a]
        rel = starts[i:j] - a
        out[i:j] = np.add.reduceat(vals, rel) * q[rel]
        i = j
    return mix(out ^ ((ends - starts).astype(np.uint64) << _U(48)))


def windows(h: np.ndarray, counts: np.ndarray, size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows inside documents, their word index, and windows per document."""
    per = np.maximum(counts - size + 1, 0)
    total = len(h) - size + 1
    if total <= 0 or not per.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), per
    mul = _splitmix(size, seed) | _U(1)
    acc = np.zeros(total, np.uint64)
    for k in range(size):
        acc += h[k : k + total] * mul[k]
    begin = np.cumsum(counts) - counts
    at = np.repeat(begin - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    return mix(acc[at]), at, per
