"""Vectorised scans over the UTF-8 bytes of an Arrow text column.

Everything works on blocks of whole documents (``text_blocks``), about ``BLOCK`` bytes each, so that
the scratch arrays stay small however long the Arrow batch is. A single longer document is cut
further where the unit that is hashed (word or line) allows it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
_RADIX = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(577215664)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
#: Byte values for hashing with A-Z taken as a-z.
FOLDED = _VALUE[_FOLD]
EXACT = _VALUE
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64, for positions below n."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(21, int(n - 1).bit_length())
        up = np.full(size, _RADIX, np.uint64)
        down = np.full(size, pow(_RADIX, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Final avalanche of 64-bit values."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


def text_blocks(column, limit: int = BLOCK):
    """Yields (first row, end row, bytes, offsets of the rows and the end) with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each span of bytes; empty spans have the hash of their length 0."""
    up, down = _tables(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(values[b] * up[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))


def word_spans(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without the bytes 0x20, 0x09-0x0D, none across documents."""
    n = len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[b]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | cut[1:n]
    last[:-1] &= ~word[1:] | cut[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(b: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and, for each document and the end, the number of words before it."""
    if len(offsets) == 2 and len(b) > 2 * BLOCK:
        parts, at = [], 0
        while at < len(b):
            end = min(at + BLOCK, len(b))
            while end < len(b):  # back to a space, or else on to the next
                space = np.flatnonzero(SPACE[b[at:end]])
                if len(space):
                    end = at + int(space[-1]) + 1
                    break
                end = min(end + BLOCK, len(b))
            piece = b[at:end]
            starts, ends = word_spans(piece, np.array([0, len(piece)]))
            parts.append(span_hashes(piece, starts, ends, values))
            at = end
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])
    starts, ends = word_spans(b, offsets)
    return span_hashes(b, starts, ends, values), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of that many words; window i starts at word i."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    h = words[: len(words) - width + 1].copy()
    for k in range(1, width):
        h = h * _U(_RADIX) + words[k : len(words) - width + 1 + k]
    return mix(h)


def whole(words: np.ndarray) -> np.ndarray:
    """One hash for a sequence that is shorter than a window."""
    h = np.uint64(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            h = h * _U(_RADIX) + w
    return mix(np.array([h], np.uint64))


def lists(values: list[np.ndarray], kind=None) -> pa.Array:
    """An Arrow list column of those arrays."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind or pa.int64()))
