"""Words, n-grams and their 64-bit hashes over Arrow text columns, by whole-buffer numpy operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MULTIPLIER = U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_CODE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _CODE.copy()
_FOLDED[65:91] = _CODE[97:123]
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
#: Bytes of text that are hashed at once; longer texts make a chunk of their own.
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, CHUNK)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a text column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) in chunks of about CHUNK bytes."""
    raw, at = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(raw: np.ndarray, at: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, first and end byte of each word, and the n + 1 word bounds of the texts. fold: A-Z as a-z."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, U), empty, empty, np.zeros(len(at), np.int64)
    space = _IS_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    before, after = np.empty(len(raw), bool), np.empty(len(raw), bool)
    before[0], after[-1] = True, True
    before[1:], after[:-1] = space[:-1], space[1:]
    first = np.flatnonzero(~space & (before | cut[:-1]))
    end = np.flatnonzero(~space & (after | cut[1:])) + 1
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, U)
    np.cumsum((_FOLDED if fold else _CODE)[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[first]) * down[first]), first, end, np.searchsorted(first, at)


def grams(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they lie in one text; both as long as h."""
    n = len(h)
    out, ok = np.zeros(n, U), np.zeros(n, bool)
    if n >= k:
        acc = h[: n - k + 1].copy()
        for j in range(1, k):
            acc = acc * MULTIPLIER + h[j : n - k + 1 + j]
        out[: n - k + 1] = mix(acc + U(k))
    ends = np.repeat(bounds[1:], np.diff(bounds))
    ok[:] = np.arange(n) + k <= ends
    return out, ok
