"""SimHash near-duplicates found by a byte-position inverted index with count filtering.

Fingerprints have 64 bits.  Two that differ in at most ``MAX_BITS`` = 4 bits share
at least 8 - 4 = 4 of their 8 positional bytes, so a pair is retained if it reaches that
count of shared (position, byte) entries, and is then verified bit by bit.

Postings of single bytes would have 2048 keys for any number of fingerprints, and so tally
a share of all pairs.  The postings are therefore keyed by three positional bytes at once:
20 triples of positions are chosen so that every four positions hold one of them, hence
every pair with four shared bytes meets in a posting, with 2^24 keys for each triple.

Only distinct fingerprints are indexed; copies hang on their fingerprint.  A posting of
more than ``BLOCK`` fingerprints is split into blocks, and each pair of blocks is a group
of its own, which returns links that connect what its pairs connect (a forest)
instead of the pairs.  No posting meets in one task and no pair is lost.

Defined results: null and empty texts and texts of blanks have fingerprint zero, which links
like any other; repeated rows share a fingerprint; rows with a null id belong to the component
of their fingerprint but never name it (the component is null if no row has an id).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import append_columns, free_name, quoted
from .bytetext import BLANK, LOWER, Piece, pieces, words
from .components import connected_components
from .shipping import ship_package
from .storage import Scratch
from .xxh64 import hash_ranges

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BLOCK = 512


def _position_triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 byte positions such that any four positions hold one of them.

    The positions are dealt to three cyclic classes; a triple is taken if it lies in one
    class, or has two positions in a class and one in the next.
    """
    classes = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for triple in combinations(range(8), 3):
        of = sorted(classes[i] for i in triple)
        if len(set(of)) == 1 or any(of.count(c) == 2 and of.count((c + 1) % 3) == 1 for c in range(3)):
            out.append(triple)
    if not all(any(set(t) <= set(four) for t in out) for four in combinations(range(8), 4)):
        raise AssertionError("the triples of positions don't cover all fours")
    return out


def text_fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text: majority bits of XXH64 over its word shingles, repeats included."""
    n = len(column)
    counts, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    n_words = np.zeros(n, np.int64)
    for piece in pieces(column, BLANK, shingle - 1):
        joined, starts, ends, segment = _joined(piece)
        row = piece.rows[segment]
        n_words += np.bincount(row, minlength=n)
        at = np.arange(max(0, len(row) - shingle + 1))
        at = at[row[at] == row[at + shingle - 1]]
        if len(at):
            of = row[at]
            _tally(hash_ranges(joined, starts[at], ends[at + shingle - 1], SEED), of, counts)
            total += np.bincount(of, minlength=n)
    for i in np.flatnonzero((total == 0) & (n_words > 0)).tolist():  # fewer words than a shingle has
        data, starts, ends, _ = _joined(next(pieces(column[i : i + 1], BLANK, 0, max(1, column[i].as_buffer().size))))
        _tally(hash_ranges(data, starts[:1], ends[-1:], SEED), np.array([i]), counts)
        total[i] = 1
    bits = (2 * counts > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _joined(piece: Piece) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The piece's words in lower case, one blank between two, with their starts, ends and segments."""
    data = LOWER[piece.data]
    starts, ends, segment = words(piece, BLANK, data)
    keep = ~BLANK[data]
    after = ends[ends < len(data)]
    after = after[BLANK[data[after]]]
    keep[after], data[after] = True, 0x20
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return data[keep].tobytes(), place[starts], place[ends], segment


#: Bits of each byte value, to turn counts of byte values into counts of bits.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _tally(hashes: np.ndarray, of: np.ndarray, counts: np.ndarray) -> None:
    """Add to counts[row] how often each bit is set in the hashes of the row; ``of`` is sorted."""
    values = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    edges = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    for x, y in zip(edges.tolist(), np.append(edges[1:], len(of)).tolist()):
        seen = np.bincount(values[x:y].ravel(), minlength=2048).reshape(8, 256)
        counts[of[x]] += (seen @ _BITS).ravel()


def with_fingerprint(docs: DataFrame, text_column: str = "text", name: str = "simhash") -> DataFrame:
    """Append the fingerprint as a signed long."""

    def make():
        return lambda column: [pa.array(text_fingerprints(column).view(np.int64), pa.int64())]

    return append_columns(docs, text_column, [T.StructField(name, T.LongType())], make)


def candidate_keys():
    """The postings of a fingerprint: one key for each triple of byte positions."""
    value = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    keys = []
    for number, (a, b, c) in enumerate(_position_triples()):
        of_bytes = F.shiftleft(value(a), 16).bitwiseOR(F.shiftleft(value(b), 8)).bitwiseOR(value(c))
        keys.append(F.lit(number << 24).cast("bigint").bitwiseOR(of_bytes))
    return F.array(*keys)


def _links_of_block(group: Iterator[pa.Table] | pa.Table, max_bits: int) -> pa.Table:
    """Links that connect what the pairs of one group connect: those of left rows with all rows.

    Rows have side 0 (the block itself) or 1 (a later block of the posting).
    """
    fp = group["fp"].to_numpy().view(np.uint64)
    node = group["node"].to_numpy()
    left = np.flatnonzero(group["side"].to_numpy() == 0)
    right = np.flatnonzero(group["side"].to_numpy() == 1)
    others = right if len(right) else left
    root = np.arange(len(fp))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i in left.tolist():
        differ = fp[others] ^ fp[i]
        shared = ((differ.view(np.uint8).reshape(-1, 8)) == 0).sum(axis=1)
        kept = others[shared >= 8 - max_bits]
        kept = kept[np.bitwise_count(fp[kept] ^ fp[i]) <= max_bits]
        for j in kept.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})


def fingerprint_links(prints: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints differ in ``max_bits`` bits or fewer.

    ``prints`` has one row for each distinct fingerprint: fp and node (longs).  The links
    connect exactly what all such pairs connect.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the postings guarantee pairs of up to 4 differing bits")
    posted = prints.select("fp", "node", F.explode(candidate_keys()).alias("key"))
    sizes = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posted = scratch.write(posted.join(sizes, "key"), "postings")
    small = posted.where(F.col("n") <= block).select("key", "fp", "node")
    other = small.select("key", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    differ = F.col("fp").bitwiseXOR(F.col("fp2"))
    shared = sum((F.shiftrightunsigned(differ, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(8))
    pairs = small.join(other, "key").where("fp < fp2").where(shared >= 8 - max_bits).where(F.bit_count(differ) <= max_bits)
    links = pairs.select(F.col("node").alias("a"), F.col("node2").alias("b"))
    large = posted.where(F.col("n") > block)
    if large.limit(1).count():
        links = links.union(_block_links(large, max_bits, block))
    return links


def _block_links(large: DataFrame, max_bits: int, block: int) -> DataFrame:
    """Links of large postings: each pair of blocks of a posting is one group."""
    ship_package(large.sparkSession)
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = large.select("key", "fp", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("mine"))
    paired = dealt.select("key", "fp", "node", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    groups = paired.select(
        "key", "fp", "node",
        F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"),
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    return groups.groupBy("key", "first", "second").applyInArrow(lambda t: _links_of_block(t, max_bits), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs``: its id, ``simhash`` (signed long) and ``component_id``.

    ``component_id`` is the smallest id that links reach.
    """
    scratch = Scratch(docs.sparkSession)
    doc = docs.select(quoted(id_column).alias("id"), quoted(text_column).alias("text"))
    prints = scratch.write(with_fingerprint(doc, "text", "fp").select("id", "fp"), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("node"))
    links = fingerprint_links(nodes.where("node is not null"), scratch, max_bits)
    parts = connected_components(links, scratch)
    classes = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp").select(F.col("id").alias(id_column), F.col("fp").alias("simhash"), "component_id")


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stand for their component: of each component the row with the
    smallest id (of repeated rows with this id, one).  Rows without an id are kept."""
    found = near_duplicates(docs, id_column=id_column, text_column=text_column, max_bits=max_bits)
    [name] = free_name(docs, "gone")
    same = quoted(id_column) == F.col(name)
    gone = found.where(quoted(id_column) != F.col("component_id")).select(quoted(id_column).alias(name)).distinct()
    kept = docs.join(gone, same, "left_anti")
    repeated = docs.where(quoted(id_column).isNotNull()).groupBy(quoted(id_column).alias(name)).count().where("count > 1").select(name)
    if repeated.limit(1).count():
        first = kept.join(repeated, same, "left_semi").dropDuplicates([id_column])
        kept = kept.join(repeated, same, "left_anti").union(first)
    return kept
