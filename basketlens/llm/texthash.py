"""Words of many texts as 64-bit hashes, computed on the bytes of an Arrow column.

A word is a run of bytes other than space and 0x09 to 0x0D; A-Z count as
a-z. The hash of a word is a polynomial of its bytes modulo 2**64, taken as a
difference of running sums, then mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20    # bytes worked on at a time (a longer text: whole)
_U = np.uint64
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same in every process."""
    return np.random.default_rng(seed).integers(1, 1 << 62, n, dtype=np.uint64) * _U(2) + _U(1)


_BYTE = constants(256, 1)
_BASE = int(constants(1, 2)[0])
_POWERS: dict[str, np.ndarray] = {}


class Chunk(NamedTuple):
    """Some consecutive texts: their bytes and offsets, and their words
    (first byte, byte after the last, hash); the words of text k are
    edges[k] to edges[k + 1]."""

    raw: np.ndarray
    offsets: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    edges: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multipliers: fixed values of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, _U(base), dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_chunks(column: pa.Array, separators: np.ndarray = _WHITE, byte: np.ndarray = _BYTE) -> Iterator[Chunk]:
    """The texts of a string column (null: empty), chunk by chunk. Other
    ``separators`` (a flag for each byte) cut other words; other ``byte``
    values give other hashes."""
    if column.null_count:
        column = column.fill_null("")
    column = column if pa.types.is_large_string(column.type) else column.cast(pa.large_string())
    n, (_, ends, data) = len(column), column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1))
        yield _chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], separators, byte)
        at = to


def _chunk(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray, byte: np.ndarray) -> Chunk:
    n = len(raw)
    inside = ~separators[raw]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    starts[first] = inside[first]  # the end of a text ends a word
    ends[last] = inside[last]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(byte[_LOWER[raw]] * up[:n], out=total[1:])
    hashes = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return Chunk(raw, offsets, begin, end, hashes, np.searchsorted(begin, offsets))
