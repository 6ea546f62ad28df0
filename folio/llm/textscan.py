"""Vectorised word scanning over Arrow string columns.

A batch's texts already lie in one contiguous UTF-8 buffer, so words are found
with a 256-entry byte class table and hashed eight bytes at a time; no Python
string is made for a word.  Every function works on a slice of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: The low k bytes of a block.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Words(NamedTuple):
    """Words of a slice: hash, byte start and end, and each document's first word."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


class Slice(NamedTuple):
    """Rows lo..hi of a batch; offsets are relative to data and have hi-lo+1 entries."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def byte_class(delimiters: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, dtype=bool)
    table[list(delimiters)] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACE_WORDS = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM_WORDS = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply and xor-shift rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string or binary column into runs of rows of about `limit` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, buf = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool, seed: int = 0) -> Words:
    """Find and hash the words of each document; none crosses a document's end."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64))
    if fold:
        data = FOLD[data]
    inside = table[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before[cuts] = False
    after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(span_hash(data, start, end, seed), start, end, np.searchsorted(start, offsets))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each span; different seeds give independent hashes.

    Blocks of eight bytes are mixed with their place in the span before they are
    added up, so no regular pattern of letters cancels out.  Spans of at most
    eight bytes and one length never collide.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    blocks = np.maximum((size + 7) >> 3, 1)
    first = np.cumsum(blocks) - blocks
    place = np.arange(first[-1] + blocks[-1]) - np.repeat(first, blocks)
    at = np.repeat(start, blocks) + 8 * place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    every = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        value = every[at] & _LOW[np.clip(np.repeat(end, blocks) - at, 0, 8)]
        value = mix64(value ^ mix64((place.astype(np.uint64) + np.uint64(1)) * _GOLD + np.uint64(seed)))
        return mix64(np.add.reduceat(value, first) + size.astype(np.uint64) * _STEP)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every k consecutive words (of the whole slice, documents' ends included)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for i in range(1, k):
            out ^= out >> np.uint64(29)  # a step is not linear, so regular sequences of words do not cancel out
            out *= _STEP
            out += hashes[i : i + n]
    return mix64(out)


def grams_at(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """What grams() gives at these places alone."""
    with np.errstate(over="ignore"):
        out = hashes[starts]
        for i in range(1, k):
            out ^= out >> np.uint64(29)
            out *= _STEP
            out += hashes[starts + i]
    return mix64(out)


def gram_mask(first: np.ndarray, total: int, k: int) -> np.ndarray:
    """True where k consecutive words lie in one document."""
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    inside = np.ones(n, dtype=bool)
    ends = first[1:]
    for i in range(1, k):  # a gram that starts less than k words before a document's end runs over it
        at = ends - i
        inside[at[(at >= 0) & (at < n)]] = False
    return inside


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
