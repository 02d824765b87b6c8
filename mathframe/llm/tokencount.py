"""Token counts of whole texts, without keeping any token.

Texts are split at safe boundaries: before a white space byte that follows a byte which is
surely not white space, and before a mark of ``MARKS`` that follows an ASCII letter.  The
tokenizer's own pre-splitting never joins what stands on both sides of such a place, and
no special token holds white space or marks, so the count of a text is the sum of
the counts of its segments.  Segments are then encoded in batches balanced by bytes, each
distinct segment once; only lengths are kept.

The tokenizer file must split this way (byte-level BPE, no normalizer, no stripping special
tokens); other files are refused.

Defined results: null and empty texts have no tokens; special strings inside a text are
what the library makes of them by default.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import append_columns
from .bytetext import BLANK, byte_hashes, column_bytes

#: Texts are taken in pieces of so many bytes; a longer text is cut at safe boundaries.
PIECE_BYTES = 1 << 21
#: Bytes given to the library at once.
BATCH_BYTES = 1 << 16
#: Distinct segments whose counts a task remembers; beyond that it starts anew.
REMEMBERED = 2_000_000
#: Longer segments are never remembered.
LONG_SEGMENT = 1 << 12

MARKS = ".,;:!?"

_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

#: Bytes that end a character which is not white space, whatever stands before them.
_SOLID = ~BLANK
_SOLID[[*range(0x1C, 0x20), *range(0x80, 0x100)]] = False


def _boundaries(data: np.ndarray) -> np.ndarray:
    """For each byte but the first: may a text be split before it."""
    return (BLANK[data[1:]] & _SOLID[data[:-1]]) | (_MARK[data[1:]] & _LETTER[data[:-1]])


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def check_file(text: str) -> None:
    """Refuse a tokenizer whose texts can't be split at white space."""
    spec = json.loads(text)
    pre = spec.get("pre_tokenizer") or {}
    stripping = [x["content"] for x in spec.get("added_tokens", []) if x["lstrip"] or x["rstrip"] or re.search(rf"[\s{MARKS}]", x["content"])]
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or stripping:
        raise ValueError("the tokenizer isn't a plain byte-level BPE; its texts have no safe boundaries")


class Counter:
    """Counts tokens of segments, and remembers those of distinct ones."""

    def __init__(self, tokenizer, piece_bytes: int = PIECE_BYTES):
        self.tokenizer, self.piece_bytes = tokenizer, piece_bytes
        self.known = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = column_bytes(column)
        n = len(offsets) - 1
        total = np.zeros(n, np.int64)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + self.piece_bytes, side="right")) - 1)
            lo, end = int(offsets[i]), int(offsets[j])
            while lo < end or lo == offsets[i]:
                hi = end if end - lo <= self.piece_bytes else self._safe(data, lo, lo + self.piece_bytes, end)
                inner = offsets[i:j][(offsets[i:j] >= lo) & (offsets[i:j] < hi)] - lo
                starts, counts = self.piece(data[lo:hi], inner)
                row = np.searchsorted(offsets[i : j + 1], starts + lo, side="right") - 1 + i
                total += np.bincount(row, weights=counts, minlength=n).astype(np.int64)[:n]
                if hi >= end:
                    break
                lo = hi
            i = j
        return np.diff(offsets), total

    @staticmethod
    def _safe(data: np.ndarray, lo: int, at: int, end: int) -> int:
        """The last safe boundary in (lo, at], or the first after it."""
        for a, b, pick in [(lo + 1, at + 1, -1)] + [(x, min(x + 65536, end), 0) for x in range(at + 1, end, 65536)]:
            found = np.flatnonzero(_boundaries(data[a - 1 : b]))
            if len(found):
                return a + int(found[pick])
        return end

    def piece(self, data: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and token counts of a piece's segments."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.zeros(len(data), bool)
        cut[1:] = _boundaries(data)
        cut[0] = True
        cut[text_starts[text_starts < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        hashes = byte_hashes(data, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        seen = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        counts[seen] = self.counts[at[seen]]
        new = np.flatnonzero(~seen)
        raw = data.tobytes()
        a, b = starts[first[new]], ends[first[new]]
        counts[new] = self._encode([raw[x:y].decode() for x, y in zip(a.tolist(), b.tolist())], b - a)
        keep = new[(b - a) <= LONG_SEGMENT]
        if len(self.known) + len(keep) > REMEMBERED:
            self.known, self.counts = self.known[:0], self.counts[:0]
        known = np.concatenate([self.known, distinct[keep]])
        order = np.argsort(known, kind="stable")
        self.known, self.counts = known[order], np.concatenate([self.counts, counts[keep]])[order]
        return starts, counts[which]

    def _encode(self, texts: list[str], sizes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        ends = np.cumsum(sizes)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + BATCH_BYTES, side="right")))
            out[i:j] = [len(e) for e in self.tokenizer.encode_batch_fast(texts[i:j], add_special_tokens=False)]
            i = j
        return out


_WORKER: dict[str, Counter] = {}


def _worker_counter(text: str) -> Counter:
    """The counter of this Python worker: tasks that follow one another share what it remembers."""
    if text not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _WORKER.clear()
        _WORKER[text] = Counter(Tokenizer.from_str(text))
    return _WORKER[text]


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text_column: str = "text", limit: int = 1024) -> DataFrame:
    """Append ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    The file at ``tokenizer_path`` is read on the driver and sent with the tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        text = file.read()
    check_file(text)
    shared = docs.sparkSession.sparkContext.broadcast(text)

    def make():
        counter = _worker_counter(shared.value)

        def run(column: pa.Array) -> list[pa.Array]:
            n_bytes, n_tokens = counter.column(column)
            return [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())]

        return run

    out = append_columns(docs, text_column, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())], make)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
