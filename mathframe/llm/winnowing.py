"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item (an item with fewer
words is one window).  Items and documents are both fingerprinted by winnowing:
of every ``WINDOW - GRAM + 1`` consecutive k-gram hashes the smallest is kept, so
two texts that share a window share a kept hash.  Documents probe the kept hashes of
the items; each match is extended to all windows around it, and a window
counts once its words' hashes equal a window of an item.

A benchmark of at most ``BLOCK_WORDS`` words is one broadcast table: every document is held against it and
nothing is shuffled.  A larger one is never gathered: its fingerprints and windows stay distributed, documents emit the
fingerprints that a bitmap of fixed size lets through, and both are joined, first on fingerprints and then, extended,
on windows.  There a document is named by two 64-bit hashes of its text, so copies share their rows.
A document's matches are counted by distinct window before they are
paired with items, so a passage that repeats within a text costs no more than once.

Defined results: a null or empty text has no words and no hits; an item without words
never occurs; items with one id count once, repeated documents each by themselves, and a
null item id is the empty string.  Texts of any length are taken whole; other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import append_columns, free_name, quoted
from .bytetext import LOWER, NOT_ALNUM, byte_hashes, mix, pieces, words
from .shipping import ship_package
from .storage import Scratch

WINDOW = 8
GRAM = 5
#: Words of a benchmark that is broadcast (about 60 bytes each).
BLOCK_WORDS = 500_000

_FILTER_BITS = 20
#: Bits of the bitmap of fingerprints of a larger benchmark (8 MB).
_MAP_BITS = 26


def _gram_hash(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = max(0, len(word_hash) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + word_hash[j : j + n]
    return mix(out)


def _winnow(gram: np.ndarray, span: int) -> np.ndarray:
    """True where a hash is the smallest of some ``span`` consecutive hashes."""
    n = len(gram) - span + 1
    kept = np.zeros(len(gram), bool)
    if n > 0:
        least = gram[:n]
        for j in range(1, span):
            least = np.minimum(least, gram[j : j + n])
        for j in range(span):
            kept[j : j + n] |= gram[j : j + n] == least
    return kept


def _spans_one(segment: np.ndarray, k: int) -> np.ndarray:
    """True where k consecutive words are of one segment."""
    n = max(0, len(segment) - k + 1)
    return segment[:n] == segment[k - 1 : k - 1 + n]


def _contains(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``values`` in a sorted ``table``, and whether they are there."""
    at = np.minimum(np.searchsorted(table, values), max(0, len(table) - 1))
    return at, (table[at] == values if len(table) else np.zeros(len(values), bool))


@dataclass
class Block:
    """The windows of some items, by length, and the winnowed hashes that lead to them."""

    prints: np.ndarray  # sorted kept k-gram hashes of items with WINDOW words or more
    windows: dict[int, np.ndarray]  # length: sorted hashes of distinct windows
    first: dict[int, np.ndarray]  # length: where a window's items start in ``owners``
    owners: dict[int, np.ndarray]  # length: item numbers, by window
    items: list[str]

    def __post_init__(self):
        self.filters = {k: self._bits(t) for k, t in [("prints", self.prints), *self.windows.items()]}

    @staticmethod
    def _bits(table: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[table >> np.uint64(64 - _FILTER_BITS)] = True
        return bits

    def maybe(self, key, values: np.ndarray) -> np.ndarray:
        """Positions of values that may be in a table."""
        return np.flatnonzero(self.filters[key][values >> np.uint64(64 - _FILTER_BITS)])

    def wanted(self, k: int, window: int, values: np.ndarray) -> np.ndarray:
        """Positions of values that may be a window of ``k`` words or, where that is the full length, that are kept hashes."""
        at = self.maybe("prints" if k == window else k, values)
        return at[_contains(self.prints, values[at])[1]] if k == window else at


def _item_hashes(text: str | None, window: int, gram: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Length of an item's windows (0: no words), their hashes, its fingerprints."""
    hashes = np.concatenate([h for h, _, _, _ in _hashed(pa.array([text], pa.string()), 0)] or [np.zeros(0, np.uint64)])
    k = min(window, len(hashes))
    if k < window:
        value = _gram_hash(hashes, k) if k else hashes
        return k, value, value
    grams = _gram_hash(hashes, gram)
    return k, _gram_hash(hashes, k), grams[_winnow(grams, window - gram + 1)]


def build_block(item_ids: list, texts: list[str | None], window: int = WINDOW, gram: int = GRAM) -> Block:
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    prints = [np.zeros(0, np.uint64)]
    for number, text in enumerate(texts):
        k, value, kept = _item_hashes(text, window, gram)
        if k:
            found.setdefault(k, []).append((value, number))
        if k == window:
            prints.append(kept)
    windows, first, owners = {}, {}, {}
    for k, parts in found.items():
        value = np.concatenate([h for h, _ in parts])
        owner = np.concatenate([np.full(len(h), number, np.int64) for h, number in parts])
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        once = np.ones(len(value), bool)
        once[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[once], owner[once]
        windows[k], start = np.unique(value, return_index=True)
        first[k], owners[k] = np.append(start, len(value)), owner
    return Block(np.unique(np.concatenate(prints)), windows, first, owners, ["" if i is None else str(i) for i in item_ids])


def _hashed(column: pa.Array, overlap: int):
    """(word hashes, row of each word, is the word the piece's own, piece) of each piece."""
    for piece in pieces(column, NOT_ALNUM, overlap):
        data = LOWER[piece.data]
        starts, ends, segment = words(piece, NOT_ALNUM, data)
        yield byte_hashes(data, starts, ends), piece.rows[segment], starts < piece.own, piece


def _candidates(hashes: np.ndarray, inside: np.ndarray, own: np.ndarray, k: int, window: int, gram: int, wanted) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``k`` words that a wanted fingerprint leads to, and that fingerprint.

    ``wanted`` gives positions of wanted hashes.  A window of fewer words than ``window`` is its own fingerprint.
    """
    if len(hashes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if k < window:
        value = _gram_hash(hashes, k)
        at = wanted(value)
        at = at[inside[at] & own[at]]
        return at, value[at]
    grams = _gram_hash(hashes, gram)
    lead = np.flatnonzero(_winnow(grams, window - gram + 1))
    lead = lead[wanted(grams[lead])]
    at, led = (lead[:, None] - np.arange(window - gram + 1)).ravel(), np.repeat(grams[lead], window - gram + 1)
    fits = (at >= 0) & (at < len(inside))
    at, led = at[fits], led[fits]
    return at[inside[at]], led[inside[at]]


def scan(column: pa.Array, block: Block, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of each text; its hit word ranges (start, end); numbers of the items with occurring windows."""
    n = len(column)
    n_words = np.zeros(n, np.int64)
    hit_row, hit_start, hit_end, item_row, item_number = [], [], [], [], []
    for hashes, row, own, _ in _hashed(column, window - 1):
        before = n_words[row]  # words of this text in earlier pieces
        position = np.arange(len(row)) - np.searchsorted(row, row) + before
        for k, table in block.windows.items():
            at, _ = _candidates(hashes, _spans_one(row, k), own, k, window, gram, lambda v, k=k: block.wanted(k, window, v))
            at = np.unique(at)
            value = _window_hash(hashes, at, k)
            slot, ok = _contains(table, value)
            at, slot = at[ok], slot[ok]
            if not len(at):
                continue
            hit_row.append(row[at])
            hit_start.append(position[at])
            hit_end.append(position[at] + k)
            pair = np.unique(row[at] * np.int64(len(table)) + slot)
            pair_row, pair_slot = pair // len(table), pair % len(table)
            count = block.first[k][pair_slot + 1] - block.first[k][pair_slot]
            index = np.repeat(block.first[k][pair_slot] - np.cumsum(count) + count, count) + np.arange(count.sum())
            item_row.append(np.repeat(pair_row, count))
            item_number.append(block.owners[k][index])
        n_words += np.bincount(row[own], minlength=n)
    return n_words, _ranges(n, hit_row, hit_start, hit_end), _by_row(n, item_row, item_number)


def _window_hash(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[at + j]
    return mix(out)


def _ranges(n: int, rows: list, starts: list, ends: list) -> list[np.ndarray]:
    """Merged ranges of each row, as (m, 2) arrays."""
    out = [np.zeros((0, 2), np.int64)] * n
    if not rows:
        return out
    row, start, end = (np.concatenate(x) for x in (rows, starts, ends))
    order = np.lexsort((end, start, row))
    row, start, end = row[order], start[order], end[order]
    for a, b in _groups(row):
        s, reach = start[a:b], np.maximum.accumulate(end[a:b])
        new = np.ones(b - a, bool)
        new[1:] = s[1:] > reach[:-1]
        last = np.append(np.flatnonzero(new)[1:] - 1, b - a - 1)
        out[row[a]] = np.stack([s[new], reach[last]], 1)
    return out


def _by_row(n: int, rows: list, values: list) -> list[np.ndarray]:
    out = [np.zeros(0, np.int64)] * n
    if rows:
        row, value = np.concatenate(rows), np.concatenate(values)
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
        for a, b in _groups(row):
            out[row[a]] = np.unique(value[a:b])
    return out


def _groups(row: np.ndarray):
    edges = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    return zip(edges, np.append(edges[1:], len(row)))


_RANGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_SCAN = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(_RANGE)), T.StructField("items", T.ArrayType(T.StringType()))])


def find_contamination(docs: DataFrame, items: DataFrame, *, text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Append ``n_words``, ``hit_ranges`` (merged word ranges) and ``hit_items`` (sorted item ids).

    ``docs`` keeps its rows and columns; columns of these names are replaced.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must be from 1 to window")
    out = docs.drop("n_words", "hit_ranges", "hit_items")
    chosen = items.select(quoted(item_id_column).cast("string").alias("id"), quoted(item_text_column).alias("text"))
    # A word takes two bytes at least with its separator, so bytes / 2 bounds the words.
    n_bytes = chosen.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    if n_bytes <= 2 * block_words:
        rows = chosen.collect()
        return _scanned(out, text_column, build_block([r.id for r in rows], [r.text for r in rows], window, gram), window, gram)
    counted = _scanned(out, text_column, build_block([], [], window, gram), window, gram)
    t1, t2, ranges, names = free_name(counted, "t1", "t2", "ranges", "names")
    found = _joined(out.select(quoted(text_column).alias("text")), chosen, window, gram).toDF(t1, t2, ranges, names)
    joined = counted.join(found, (F.xxhash64(quoted(text_column)) == F.col(t1)) & (F.xxhash64(F.lit(1), quoted(text_column)) == F.col(t2)), "left")
    joined = joined.withColumns({"hit_ranges": F.coalesce(ranges, "hit_ranges"), "hit_items": F.coalesce(names, "hit_items")})
    return joined.drop(t1, t2, ranges, names)


def _scanned(docs: DataFrame, text_column: str, block: Block, window: int, gram: int) -> DataFrame:
    """``docs`` with the matches of a block that is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    [name] = free_name(docs, "scan")

    def make():
        block = shared.value

        def run(column: pa.Array) -> list[pa.Array]:
            n_words, ranges, numbers = scan(column, block, window, gram)
            hits = [[{"start": int(a), "end": int(b)} for a, b in r] for r in ranges]
            names = [[block.items[i] for i in x] for x in numbers]
            return [pa.array([{"n_words": int(w), "hits": h, "items": i} for w, h, i in zip(n_words, hits, names)], _ARROW)]

        return run

    out = append_columns(docs, text_column, [T.StructField(name, _SCAN)], make)
    items_of = F.array_sort(F.array_distinct(f"{name}.items"))
    return out.withColumns({"n_words": F.col(f"{name}.n_words"), "hit_ranges": F.col(f"{name}.hits"), "hit_items": items_of}).drop(name)


def _joined(texts: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """(t1, t2, ranges, names) of the texts with windows of items, from distributed tables of both."""
    spark = texts.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k, value, kept = _item_hashes(text, window, gram)
                value, kept = np.unique(value), np.unique(kept)
                yield _record(k=np.full(len(value) + len(kept), k, np.int32), hash=np.append(value, kept).view(np.int64), print=np.arange(len(value) + len(kept)) >= len(value), item=pa.array([name or ""] * (len(value) + len(kept)), pa.string()))

    theirs = scratch.write(items.mapInArrow(of_items, "k int, hash bigint, print boolean, item string"), "items")
    prints = theirs.where("print").select("k", F.col("hash").alias("lead")).distinct()
    windows = theirs.where("not print").select("k", F.col("hash").alias("win"), "item").distinct()
    # At most 2 ** (_MAP_BITS - 6) rows reach the driver, however large the benchmark is.
    place = F.shiftrightunsigned("lead", 64 - _MAP_BITS)
    words_of = prints.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(lead, {64 - _MAP_BITS}) & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (_MAP_BITS - 6), np.uint64)
    bitmap[words_of["word"].to_numpy()] = words_of["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast((bitmap, sorted(r.k for r in prints.select("k").distinct().collect())))

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = shared.value

        def wanted(value: np.ndarray) -> np.ndarray:
            at = value >> np.uint64(64 - _MAP_BITS)
            return np.flatnonzero((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))

        for batch in batches:
            t1, t2 = (batch.column(i).to_numpy() for i in (1, 2))
            n_words = np.zeros(len(t1), np.int64)
            for hashes, row, own, _ in _hashed(batch.column(0), window - 1):
                position = np.arange(len(row)) - np.searchsorted(row, row) + n_words[row]
                for k in sizes:
                    at, lead = _candidates(hashes, _spans_one(row, k), own, k, window, gram, wanted)
                    yield _record(t1=t1[row[at]], t2=t2[row[at]], k=np.full(len(at), k, np.int32), lead=lead.view(np.int64), start=position[at], win=_window_hash(hashes, at, k).view(np.int64))
                n_words += np.bincount(row[own], minlength=len(n_words))

    named = texts.where("text <> ''").select("text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    ours = named.mapInArrow(of_texts, "t1 bigint, t2 bigint, k int, lead bigint, start bigint, win bigint")
    met = ours.distinct().join(prints, ["k", "lead"], "left_semi").select("t1", "t2", "k", "start", "win").distinct()
    hits = scratch.write(met.join(windows.select("k", "win").distinct(), ["k", "win"], "left_semi"), "hits")
    names = hits.select("t1", "t2", "k", "win").distinct().join(windows, ["k", "win"]).groupBy("t1", "t2").agg(F.array_sort(F.collect_set("item")).alias("names"))
    of_text = Window.partitionBy("t1", "t2").orderBy("start", "end")
    ends = hits.select("t1", "t2", "start", (F.col("start") + F.col("k")).alias("end")).distinct()
    ends = ends.withColumn("reach", F.max("end").over(of_text.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("run", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(of_text))
    runs = ends.groupBy("t1", "t2", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    ranges = runs.groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    return ranges.join(names, ["t1", "t2"]).select("t1", "t2", "ranges", "names")


def _record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: pa.array(values) for name, values in columns.items()})


_ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def hit_words():
    """Number of hit words, from ``hit_ranges``."""
    return F.aggregate("hit_ranges", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])


def items_digest():
    """SHA-256 of the sorted, comma-joined ids in ``hit_items``."""
    return F.sha2(F.concat_ws(",", "hit_items"), 256)


def decontaminate(docs: DataFrame, items: DataFrame, *, least_items: int = 2, **options) -> DataFrame:
    """Rows of ``docs`` whose texts hold windows of fewer than ``least_items`` items."""
    found = find_contamination(docs, items, **options)
    return found.where(F.size("hit_items") < least_items).select(*map(quoted, docs.columns))


def reference_digest(ids: list[str]) -> str:
    """The digest that ``items_digest`` gives, for tests."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
