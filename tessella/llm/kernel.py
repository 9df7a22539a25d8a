"""Array kernels over the bytes of many texts at once.

Every function works on one buffer that holds a run of texts end to end, so a
whole Arrow batch is tokenised and hashed with a handful of numpy passes and
no per-row Python.  Runs are cut at ``CHUNK`` bytes; one text longer than that
forms a run of its own, so memory follows the longest text, not the batch.

A *word* is a maximal run of letters, digits and combining marks by Unicode's
categories, folded to lower case where that takes as many bytes.  Punctuation,
symbols and white space part words and have no other effect.  Bytes that are no
valid UTF-8 count as letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
SHINGLE = 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_JOIN = _U(0xD6E8FEB86659FD93)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, CHUNK + 4096)
            up = np.full(n, _BASE, dtype=np.uint64)
            down = np.full(n, _BASE_INV, dtype=np.uint64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.up, cls.down


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return buf, offs


def runs(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of rows: (first row, end row, bytes, offsets from 0)."""
    buf, offs = string_buffers(column)
    n, at = len(column), 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def _lower(cp: int) -> int:
    """The lower case of a character if it is one character of as many bytes, else the character."""
    low = chr(cp).lower()
    return ord(low) if len(low) == 1 and len(low.encode()) == len(chr(cp).encode()) else cp


def _is_word(cp: int) -> bool:
    return unicodedata.category(chr(cp))[0] in "LNM"


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """(lower case, whether of a word) of the characters of at most three bytes."""
    low, inside = np.arange(1 << 16, dtype=np.int64), np.ones(1 << 16, dtype=bool)
    for cp in [*range(0x80, 0xD800), *range(0xE000, 1 << 16)]:
        low[cp], inside[cp] = _lower(cp), _is_word(cp)
    return low, inside


def fold(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in lower case, and whether each lies in a word."""
    out = _FOLD[buf]
    inside = _WORD[out]
    if not (buf >= 0xC2).any():
        return out, inside
    table, letters = _characters()
    for size, first, after in ((2, 0xC2, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF5)):
        at = np.flatnonzero((buf[: len(buf) - size + 1] >= first) & (buf[: len(buf) - size + 1] < after)) if len(buf) >= size else buf[:0].astype(np.int64)
        for k in range(1, size):
            at = at[(buf[at + k] & 0xC0) == 0x80]
        if not len(at):
            continue
        cp = buf[at].astype(np.int64) & (0xFF >> (size + 1))
        for k in range(1, size):
            cp = cp << 6 | (buf[at + k] & 0x3F)
        valid = (cp >= (0, 0, 0x80, 0x800, 0x10000)[size]) & (cp < 0x110000)
        at, cp = at[valid], cp[valid]
        if size < 4:
            low, word = table[cp], letters[cp]
        else:
            each, back = np.unique(cp, return_inverse=True)
            low = np.array([_lower(x) for x in each.tolist()], dtype=np.int64)[back]
            word = np.array([_is_word(x) for x in each.tolist()], dtype=bool)[back]
        for k in range(size):
            inside[at[~word] + k] = False
        changed = low != cp
        at, low = at[changed], low[changed]
        for k in range(size - 1, 0, -1):
            out[at + k] = 0x80 | low & 0x3F
            low = low >> 6
        out[at] = (0xF00 >> size) & 0xFF | low
    return out, inside


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Sums S with S[e] - S[s] a polynomial in the bytes s..e-1."""
    up, _ = _Powers.upto(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + _U(1)) * up[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span; equal bytes give equal hashes wherever they lie."""
    _, down = _Powers.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


@dataclass
class Words:
    """Words of a run of texts: byte spans, hashes, and the first word of each text."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len = texts + 1
    sums: np.ndarray


def words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    low, inside = fold(buf)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(buf)]
    begin[edges] = inside[edges]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stop[last] = inside[last]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    sums = prefix_hash(low)
    return Words(low, offsets, start, end, span_hash(sums, start, end), np.searchsorted(start, offsets), sums)


def grams(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and whether they lie in one text."""
    n = len(w.hash)
    if n < size:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    m = n - size + 1
    acc = w.hash[:m].copy()
    for k in range(1, size):
        acc *= _JOIN
        acc += w.hash[k : k + m]
    ok = np.ones(m, dtype=bool)
    for back in range(1, size):
        cut = w.first[1:-1] - back
        ok[cut[(cut >= 0) & (cut < m)]] = False
    return mix(acc), ok


def gram_of(hashes: np.ndarray) -> np.uint64:
    """The same hash for one whole sequence of word hashes."""
    acc = hashes[:1].copy()
    for h in hashes[1:]:
        acc *= _JOIN
        acc += h
    return mix(acc)[0]


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and the offsets of each text's shingles.

    A text of 1 to ``size - 1`` words has one shingle, made of all its words;
    a text without words has none.
    """
    h, ok = grams(w, size)
    at = np.flatnonzero(ok)
    counts = np.diff(w.first)
    per = np.maximum(counts - size + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < size))
    offs = np.zeros(len(counts) + 1, dtype=np.int64)
    if not len(short):
        np.cumsum(per, out=offs[1:])
        return h[at], offs
    per[short] = 1
    np.cumsum(per, out=offs[1:])
    out = np.zeros(offs[-1], dtype=np.uint64)
    hole = np.zeros(offs[-1], dtype=bool)
    hole[offs[short]] = True
    out[~hole] = h[at]
    out[offs[short]] = [gram_of(w.hash[w.first[i] : w.first[i + 1]]) for i in short]
    return out, offs


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
