"""Vectorised text kernels over Arrow string buffers (numpy, no per-word Python objects)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; longer buffers are cut at white space.
SEGMENT = 1 << 20
#: Places in a word whose terms are kept in a table.
PLACES = 64
_TABLE: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _term(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A random-looking number for a byte at a place of its word."""
    with np.errstate(over="ignore"):
        return mix64((place.astype(np.uint64) * np.uint64(256) + byte.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))


def _terms(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_term(np.repeat(np.arange(PLACES), 256), np.tile(np.arange(256), PLACES)))
    out = _TABLE[0][np.minimum(place, PLACES - 1) * 256 + byte]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        out[far] = _term(place[far], byte[far])
    return out


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has length 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]] if n else data[:0], offs - offs[0]


def ascii_lower(b: np.ndarray) -> np.ndarray:
    return b + (((b >= 65) & (b <= 90)).astype(np.uint8) << np.uint8(5))


def _is_space(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.

    A word's hash mixes the sum of terms of its bytes at their places, so no pattern of bytes makes two words collide
    more often than chance does. Returns (hashes of all words in order, index of each document's first word with a closing
    total). Words never cross a document's border.
    """
    n = len(data)
    hashes, starts_all = [], []
    border = np.zeros(n + 1, bool)
    border[offs] = True
    pos = 0
    while pos < n:
        end = min(n, pos + SEGMENT)
        if end < n:
            ok = np.flatnonzero(_is_space(data[pos:end]) | border[pos:end])
            ok = ok[ok > 0]
            if len(ok):
                end = pos + int(ok[-1])
            else:  # one word longer than a segment
                while end < n:
                    stop = min(n, end + SEGMENT)
                    ok = np.flatnonzero(_is_space(data[end:stop]) | border[end:stop])
                    end = end + int(ok[0]) if len(ok) else stop
                    if len(ok):
                        break
        b = ascii_lower(data[pos:end])
        gap = _is_space(b)
        edge = border[pos:end]
        prev = np.concatenate([[True], gap[:-1]])
        s = np.flatnonzero(~gap & (prev | edge))
        nxt = np.concatenate([gap[1:] | edge[1:], [True]])
        e = np.flatnonzero(~gap & nxt) + 1
        if len(s):
            length = e - s
            first = np.cumsum(length) - length
            place = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
            with np.errstate(over="ignore"):
                h = np.add.reduceat(_terms(place, b[~gap].astype(np.int64)), first) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            hashes.append(mix64(h))
            starts_all.append(s + pos)
        pos = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    starts = np.concatenate(starts_all)
    return np.concatenate(hashes), np.searchsorted(starts, offs, side="left")


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 2) -> Iterator[np.ndarray]:
    """Per document, the sorted distinct hashes of its k-word shingles.

    Fewer than k words: the whole sequence as one shingle. No word: empty.
    """
    h, first = word_hashes(data, offs)
    with np.errstate(over="ignore"):
        for i in range(len(offs) - 1):
            w = h[first[i] : first[i + 1]]
            if len(w) == 0:
                yield w
                continue
            m = min(k, len(w))
            acc = w[: len(w) - m + 1]
            for j in range(1, m):
                acc = mix64(acc * np.uint64(0x9FB21C651E98DF25) + w[j : len(w) - m + 1 + j])
            yield np.unique(acc + np.uint64(m))
