"""Words and word shingles of Arrow text columns as numpy arrays of 64-bit hashes.

A batch is cut into slices of bounded size; everything below works on the UTF-8 bytes of a
slice at once. Words are maximal runs without ASCII white space (0x20, 0x09-0x0D); A-Z are
lower-cased first. A word's hash is a polynomial over its bytes (through a table of random
64-bit values) taken from one running sum, then mixed; a shingle's hash mixes its words' hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
SHINGLE_WORDS = 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64) | _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_PLACE = np.random.default_rng(20240301).integers(1, 1 << 64, SHINGLE_WORDS, dtype=np.uint64) | _U(1)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` or more powers of the base and of its inverse; one table serves a whole worker."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            a = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
            a[0] = 1
            _powers[i] = np.cumprod(a, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts, and where each text's words begin and end.

    ``bounds`` holds n+1 byte offsets into ``data``; the result's second array holds n+1 word offsets.
    ``between`` marks the bytes that no word holds.
    """
    n = len(data)
    inside = np.empty(n + 1, dtype=bool)
    np.logical_not(between[data], out=inside[:n])
    inside[n] = False
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    after = np.empty(n + 1, dtype=bool)  # the byte before is no word byte of the same text
    after[0] = True
    np.logical_not(inside[:n], out=after[1:])
    after |= first
    starts = np.flatnonzero(inside & after)
    # a word ends where the next byte is white space or begins another text
    ends = np.flatnonzero(inside[:n] & (~inside[1:] | first[1:])) + 1
    power, inverse = powers_to(n + 1)
    running = np.empty(n + 1, dtype=np.uint64)
    running[0] = 0
    np.cumsum(_BYTE[data] * power[:n], out=running[1:])
    words = mixed((running[ends] - running[starts]) * inverse[starts])
    return words, np.searchsorted(starts, bounds)


def text_slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, byte array, byte bounds) of runs of rows of at most ``most`` bytes, or of one longer row."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        end = min(end, n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def shingle_sets(column: pa.Array):
    """For each text of the column its distinct shingles as a sorted array; a null text has none.

    A text of fewer than five words (but at least one) has its whole sequence as its one shingle.
    """
    for _, data, bounds in text_slices(column):
        words, at = word_hashes(data, bounds)
        if len(words) >= SHINGLE_WORDS:
            m = len(words) - SHINGLE_WORDS + 1
            grams = words[:m] * _PLACE[0]
            for k in range(1, SHINGLE_WORDS):
                grams += words[k : k + m] * _PLACE[k]
            grams = mixed(grams)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= SHINGLE_WORDS:
                s = np.sort(grams[a : b - SHINGLE_WORDS + 1])
                keep = np.empty(len(s), dtype=bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif b > a:
                whole = np.sum(words[a:b] * _PLACE[: b - a], dtype=np.uint64) + _U(b - a)
                yield mixed(np.array([whole], dtype=np.uint64))
            else:
                yield words[:0]


def set_hash(s: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted set; equal sets have equal hashes."""
    if not len(s):
        return 0
    h = np.sum(mixed(s ^ _U(0xA5A5A5A55A5A5A5A)), dtype=np.uint64) + _U(len(s))
    return int(mixed(np.array([h], dtype=np.uint64)).view(np.int64)[0])
