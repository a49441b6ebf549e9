"""Word-shingle hashes of texts in numpy, for use inside tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Bytes hashed at a time: bounds what a task holds beside the texts themselves.
_STEP = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (two rounds of xor-shift and multiply)."""
    h = (h ^ (h >> _U(31))) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def odd_numbers(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit multipliers that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + _U(seed) * _U(1_000_003)) | _U(1)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15 * 2 + 1 & (1 << 64) - 1


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether a byte is white; a random number per byte, the same for A-Z as for a-z; powers of _BASE and of its inverse."""
    white = np.zeros(256, bool)
    white[[0x20, *range(0x09, 0x0E)]] = True
    number = mix(np.arange(256, dtype=np.uint64) + _U(4242))
    number[65:91] = number[97:123]
    return white, number, powers(_BASE, _STEP), powers(pow(_BASE, -1, 1 << 64), _STEP)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of some texts (binary or string; null: none), and where each text's words begin (and the last's end).

    Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.
    """
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    white, number, powers, inverse = _constants()
    _, where, held = texts.buffers()
    offsets = np.frombuffer(where, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.empty(0, np.uint8)
    offsets -= offsets[0]
    solid = ~white.take(data)
    edge = np.ones(len(data) + 1, bool)  # where no word goes on: after white, and at a text's first byte
    edge[1:-1] = ~solid[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(solid & edge[:-1])
    edge[:-1] |= ~solid
    ends = np.flatnonzero(solid & edge[1:]) + 1
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        begin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + _STEP, "right")))
        size = int(ends[last - 1] - begin)
        up, down = (powers, inverse) if size <= _STEP else (powers(_BASE, size), powers(pow(_BASE, -1, 1 << 64), size))
        upto = np.zeros(size + 1, np.uint64)
        np.cumsum(number.take(data[begin : begin + size]) * up[:size], out=upto[1:])
        a, b = starts[first:last] - begin, ends[first:last] - begin
        out[first:last] = (upto[b] - upto[a]) * down[a]
        first = last
    return mix(out), np.searchsorted(starts, offsets)


def row_shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of every text, in order, and where each text's begin (and the last's end).

    A shorter text is one shingle, a text without words has none.
    """
    h, at = word_hashes(texts)
    words = np.diff(at)
    count = np.where(words >= k, words - k + 1, (words > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(count)])
    whole = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i, m in enumerate(odd_numbers(3, k)):
        whole += h[i : len(whole) + i] * m
    whole = mix(whole)
    out = np.empty(bounds[-1], np.uint64)
    long = words >= k
    each = np.repeat(at[:-1][long] - bounds[:-1][long], count[long])
    target = np.flatnonzero(np.repeat(long, count))
    out[target] = whole[each + target]
    for i in np.flatnonzero((words > 0) & ~long):
        n = int(words[i])
        out[bounds[i]] = mix((h[at[i] : at[i + 1]] * odd_numbers(7 + n, n)).sum(dtype=np.uint64, keepdims=True) + _U(n))[0]
    return out, bounds
