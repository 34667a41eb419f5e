"""Vectorised word kernels over the UTF-8 buffers of Arrow string columns.

White space is ASCII, so words are found on bytes without decoding. All arrays are bounded by
``max_bytes`` of text per slice (one document at least), whatever the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Word bytes: everything but \x20 and \x09-\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE_1, BASE_2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
#: Masks of a block's first 0 to 8 bytes.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
STEP_1, STEP_2 = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


def slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray, keep: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document (and the end) the index of its first word."""
    if not buf.size:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    on = keep[buf]
    begin, end = on.copy(), on.copy()
    begin[1:] &= ~on[:-1]
    end[:-1] &= ~on[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begin[first], end[last] = on[first], on[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def _bytes_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = ends - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    return first, pos, pos + np.repeat(starts, lens)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, *keys: np.uint64) -> list[np.ndarray]:
    """A 64-bit hash of each word's bytes for each key.

    A word's blocks of eight bytes are mixed with the key and their place, and summed. Words of up to eight bytes don't
    collide; longer ones that do can't be found without the key.
    """
    if not len(starts):
        return [np.empty(0, U64) for _ in keys]
    lens = ends - starts
    blocks = (lens + 7) >> 3
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    raw = np.lib.stride_tricks.sliding_window_view(padded, 8)[np.repeat(starts, blocks) + 8 * place]
    code = np.ascontiguousarray(raw).view("<u8").ravel() & _KEEP[np.minimum(np.repeat(lens, blocks) - 8 * place, 8)]
    out = []
    for key in keys:
        salt = mix(np.arange(1, int(place.max()) + 2, dtype=U64) * BASE_1 + key)
        out.append(mix(np.add.reduceat(mix(code ^ salt[place]), first) + lens.astype(U64)))
    return out


def windows(hashes: np.ndarray, size: int, step: np.uint64, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``size`` words from each position (or from those in ``at``)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    out = hashes[:n].copy() if at is None else hashes[at]
    for k in range(1, size):
        out *= step
        out += hashes[k : k + n] if at is None else hashes[at + k]
    return mix(out)


def whole(first: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Whether the ``size`` words from each position lie in one document."""
    n = n_words - size + 1
    if n <= 0:
        return np.empty(0, bool)
    ok = np.ones(n_words, bool)
    for k in range(1, size):
        at = first[1:] - k
        ok[at[at >= 0]] = False
    return ok[:n]


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each starts."""
    if not len(starts):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    _, pos, at = _bytes_of(starts, ends)
    lens = ends - starts
    begin = np.cumsum(lens + 1) - (lens + 1)
    out = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
    out[pos + np.repeat(begin, lens)] = buf[at]
    return out, begin
