"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A 64-bit number for each byte, from a fixed seed.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
#: Bytes handled at once; a text that is longer is a piece of its own.
PIECE = 1 << 19


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        up, down = np.full(size, _STEP, np.uint64), np.full(size, _UNDO, np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums S so that ``hashes(S, a, b)`` identifies the bytes a to b wherever they stand."""
    up, _ = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    return sums


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string column, and where each starts; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def pieces(starts: np.ndarray):
    """Runs of texts of about ``PIECE`` bytes: (first text, text after the last)."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + PIECE, "right")) - 1)
        yield first, last
        first = last


def words(column: pa.Array, lower: bool):
    """For runs of texts: the first text's number, per word its text (from that), hash, first byte and end, the bytes and starts."""
    data, starts = text_bytes(column)
    for first, last in pieces(starts):
        part = data[starts[first] : starts[last]]
        at = starts[first : last + 1] - starts[first]
        low = _LOWER[part] if lower else part
        inside = np.zeros(len(part) + 1, bool)
        inside[:-1] = ~_SPACE[part]
        begin = inside[:-1].copy()
        begin[1:] &= ~inside[:-2]
        finish = inside[:-1] & ~inside[1:]
        # a text's first byte starts a word and its last byte ends one, whatever the next text begins with
        filled = at[:-1] < at[1:]
        heads, tails = at[:-1][filled], at[1:][filled] - 1
        begin[heads] |= inside[heads]
        finish[tails] |= inside[tails]
        start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        owner = np.searchsorted(at, start, "right") - 1
        sums = prefix_sums(low)
        yield first, owner, hashes(sums, start, end), start, end, low, at


def windows(owner: np.ndarray, word: np.ndarray, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """First word's place and hash of each run of ``size`` words inside one text."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.flatnonzero(owner[:n] == owner[size - 1 :])
    value = np.zeros(len(place), np.uint64)
    for k in range(size):
        value = mix(value * np.uint64(0xD6E8FEB86659FD93) + word[place + k] + np.uint64(k + 1))
    return place, value
