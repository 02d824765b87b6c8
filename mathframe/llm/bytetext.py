"""Whole-text processing of Arrow string columns as flat byte arrays.

Texts are concatenated into *pieces* of a few megabytes, so that one numpy call
handles many documents and memory stays bounded by the piece, not by the batch.
A text longer than a piece is cut into segments at word starts; each segment
carries ``overlap`` further words, so that a run of ``overlap + 1`` words starts
in exactly one segment.  Nothing is left out: the segments of a text cover it all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .xxh64 import hash_ranges

PIECE_BYTES = 1 << 21

#: Separator bytes of ``[^\x20\x09-\x0D]+`` words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Separator bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` words, after A-Z became a-z.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Piece:
    """``data[offsets[i]:offsets[i + 1]]`` is a segment of the text in row ``rows[i]``.

    Words that start at ``own`` or later belong to the next piece of the same text.
    """

    data: np.ndarray
    offsets: np.ndarray
    rows: np.ndarray
    own: int


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def pieces(column: pa.Array, blank: np.ndarray, overlap: int = 0, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a column into pieces of about ``limit`` bytes (one word may be longer)."""
    data, offsets = column_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        if j > i:
            lo = offsets[i]
            yield Piece(data[lo : offsets[j]], offsets[i : j + 1] - lo, np.arange(i, j), int(offsets[j] - lo))
            i = j
            continue
        for a, cut, b in segments(data[offsets[i] : offsets[i + 1]], blank, overlap, limit):
            part = data[offsets[i] + a : offsets[i] + b]
            yield Piece(part, np.array([0, len(part)]), np.array([i]), cut - a)
        i += 1


def segments(text: np.ndarray, blank: np.ndarray, overlap: int, limit: int) -> Iterator[tuple[int, int, int]]:
    """(start, end of its own words, end) of ranges that cover a long text, cut at word starts, each with ``overlap`` words of the next."""
    start, n = 0, len(text)
    while start < n:
        cut = _word_start(text, blank, start + limit)
        end = cut
        for _ in range(overlap):
            if end >= n:
                break
            end = _word_start(text, blank, end + 1)
        yield start, cut, end
        start = cut


def _word_start(text: np.ndarray, blank: np.ndarray, at: int) -> int:
    """The first word start at or after ``at``, or the end of the text."""
    n, step = len(text), 4096
    while at < n:
        window = blank[LOWER[text[at - 1 : at + step]]]
        found = np.flatnonzero(window[:-1] & ~window[1:])
        if len(found):
            return at + int(found[0])
        at += step
    return n


def words(piece: Piece, blank: np.ndarray, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and segment numbers of the words; words never cross segments."""
    data = piece.data if data is None else data
    n = len(data)
    is_word = ~blank[data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = is_word[1:] != is_word[:-1]
    if n:
        edge[0], edge[n] = is_word[0], is_word[-1]
    marks = np.flatnonzero(edge)
    starts, ends = marks[0::2], marks[1::2]
    inner = piece.offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    inner = np.unique(inner[is_word[inner] & is_word[inner - 1]]) if len(inner) else inner
    if len(inner):
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    segment = np.searchsorted(piece.offsets, starts, side="right") - 1
    return starts, ends, segment


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of the byte ranges of a piece, mixed once more."""
    return mix(hash_ranges(data.tobytes(), starts, ends, 29))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
