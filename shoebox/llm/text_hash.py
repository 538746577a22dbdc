"""Hashes of words and word shingles over Arrow string columns, in numpy over whole UTF-8 buffers.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A word's hash comes from differences of one
cumulative polynomial over the buffer, so there is no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that are worked on at a time; a longer document is a piece of its own.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser known from MurmurHash3)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.arange(256, dtype=np.uint8)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
_VALUE = mix((_LOWER.astype(np.uint64) + U(1)) * U(0xD1342543DE82EF95))
#: Odd multipliers of the places in a shingle.
_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, 2 * PIECE + 1)
        _powers[0] = tuple(np.cumprod(np.concatenate([[U(1)], np.full(size - 1, b, dtype=np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
    return _powers[0]


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them); null rows are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        end = min(end, len(texts))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of at most 2 * PIECE bytes; words end at edges too."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[edges] = True
    before = np.concatenate([[True], space[:-1]]) | edge[:-1]
    after = np.concatenate([space[1:], [True]]) | edge[1:]
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    up, down = _power_tables(len(data) + 1)
    total = np.concatenate([[U(0)], np.cumsum(_VALUE[data] * up[: len(data)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def _long_word(data: np.ndarray) -> np.ndarray:
    """The hash of one word of any length, summed a piece at a time."""
    total = 0
    for at in range(0, len(data), PIECE):
        own = data[at : at + PIECE]
        total += int((_VALUE[own] * _power_tables(PIECE + 1)[0][: len(own)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return mix(np.array([(total + len(data)) & 0xFFFFFFFFFFFFFFFF], np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in order, and for each row where its words begin (one more entry at the end).

    Long data is worked on a piece at a time, cut at white space or where rows end, so only the hashes grow with it.
    """
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        end = min(at + 2 * PIECE, len(data))
        if end < len(data):
            ends = np.flatnonzero(_SPACE[data[at:end]])
            row = int(offsets[np.searchsorted(offsets, end, side="right") - 1])
            last = max(at + int(ends[-1]) + 1 if len(ends) else at, row)
            if last > at:
                end = last
            else:  # a word that goes on: to where it ends
                row = int(offsets[np.searchsorted(offsets, at, side="right")])
                while end < row and not (ends := np.flatnonzero(_SPACE[data[end : end + PIECE]])).size:
                    end += PIECE
                end = min(end + int(ends[0]) if end < row else row, row)
                hashes.append(_long_word(data[at:end]))
                starts.append(np.array([at]))
                at = end
                continue
        edges = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, side="right")] - at
        own, first = _words(data[at:end], edges)
        hashes.append(own)
        starts.append(first + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles (all its words as one if they are fewer)."""
    words, first = word_hashes(data, offsets)
    if len(words) >= n:
        every = words[: len(words) - n + 1] * _PLACE[0]
        for k in range(1, n):
            every = every + words[k : len(words) - n + 1 + k] * _PLACE[k]
        every = mix(every)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(every[a : b - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            out.append(mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + U(b - a) * _PLACE[63]))
        else:
            out.append(np.empty(0, np.uint64))
    return out
