"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the words to take in proportion to its weight, up to ``max_epochs``
times its own words; what is above the caps is shared again by weight until no
source is above its cap.  With sources sorted by cap over weight this is a prefix of capped
sources, found with running sums over one row per source.

A source's target is then taken as whole repetitions of all its texts plus one seeded
fraction: its texts in the order of a seeded hash, up to the text whose middle passes the
rest of the target.  The place of that cut is found by counting words in 4096
ranges of the hash, then in 4096 ranges of the one that holds the cut, and by sorting only what
is left (a sixteen-millionth of a source), so a source of any size is never gathered or sorted.

Defined results: a null text has no words; a source without words has target 0; null sources
are one source, after all others; texts with equal ids share a hash and are taken
together; texts of any length are taken whole; columns other than the new ones may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import append_columns, free_name, quoted
from .bytetext import BLANK, pieces, words
from .storage import Scratch

_HASH_BITS = 52
_STEP_BITS = 12


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in each text."""
    total = np.zeros(len(column), np.int64)
    for piece in pieces(column, BLANK):
        total += np.bincount(piece.rows[words(piece, BLANK)[2]], minlength=len(total))
    return total


def seeded_hash(ids: Column, seed: int) -> Column:
    """A number of 52 bits from MD5 of the seed and the id (null: empty)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, _HASH_BITS // 4), 16, 10).cast("bigint")


def fill(sources: DataFrame, weights: Sequence[int], share: tuple[int, int] = (3, 2), max_epochs: int = 2) -> DataFrame:
    """Targets of sources: adds weight, target and full (whole repetitions) to (missing, source, source_size).

    ``share`` is the fraction of all words to take, as numerator and denominator.  One row per
    source; the two windows over all sources hold no texts.
    """
    num, den = share
    if num > den * max_epochs:
        raise ValueError("the share can't be reached with so few epochs")
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    order = W.orderBy("missing", "source")
    big = lambda c: c.cast("decimal(38,0)")
    ranked = sources.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    everything = W.partitionBy()
    before = W.orderBy(F.col("source_size") / F.col("weight"), "missing", "source").rowsBetween(W.unboundedPreceding, -1)
    summed = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * num).alias("pot"),  # words to take, times den
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    cap = F.col("source_size") * max_epochs
    left = big(F.col("pot")) - big(F.col("size_before") * (max_epochs * den))
    capped = summed.withColumn("capped", big(cap * den) * big(F.col("all_weight") - F.col("weight_before")) < left * big(F.col("weight")))
    size_capped = F.sum(F.when(F.col("capped"), F.col("source_size")).otherwise(0)).over(everything)
    weight_capped = F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(everything)
    rest = F.col("pot") - size_capped * (max_epochs * den)
    level = (F.col("weight") * rest).cast("double") / (F.lit(den) * (F.col("all_weight") - weight_capped)).cast("double")
    target = F.when(F.col("capped") | (F.col("source_size") == 0), cap.cast("double")).otherwise(F.least(level, cap.cast("double")))
    out = capped.withColumn("target", target)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    return out.select("missing", "source", "source_size", "weight", "target", full.alias("full"))


def _cut(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds cut to the sources: texts with a hash up to it are taken once more."""
    keys = ["missing", "source"]
    rest = F.col("target") - F.col("full") * F.col("source_size")
    at = sources.select(*keys, rest.alias("rest"), F.lit(0).cast("bigint").alias("base"), F.lit(-1).cast("bigint").alias("prefix"))
    rows = sized
    for bits in (_HASH_BITS - _STEP_BITS, _HASH_BITS - 2 * _STEP_BITS):
        part = F.shiftright("hash", bits)
        counted = rows.groupBy(*keys, part.alias("part")).agg(F.sum("size").alias("words"))
        running = F.sum("words").over(W.partitionBy(*keys).orderBy("part")) - F.col("words")
        placed = counted.withColumn("running", running).join(at, keys).withColumn("upto", F.col("base") + F.col("running"))
        at = placed.where((F.col("upto") < F.col("rest")) & (F.col("upto") + F.col("words") >= F.col("rest"))).select(*keys, "rest", F.col("upto").alias("base"), F.col("part").alias("prefix"))
        rows = sized.join(at.select(*keys, "prefix"), keys).where(F.shiftright("hash", bits) == F.col("prefix")).drop("prefix")
    counted = rows.groupBy(*keys, "hash").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(W.partitionBy(*keys).orderBy("hash")) - F.col("words")
    units = counted.withColumn("running", running).join(at, keys)
    low = F.shiftleft("prefix", _HASH_BITS - 2 * _STEP_BITS) - 1
    passed = 2 * (F.col("base") + F.col("running")) + F.col("words") < 2 * F.col("rest")
    cuts = units.groupBy(*keys).agg(F.max(F.when(passed, F.col("hash")).otherwise(low)).alias("cut"))
    return sources.join(cuts, keys, "left").withColumn("cut", F.coalesce("cut", F.lit(-1).cast("bigint")))


def mix(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), max_epochs: int = 2, seed: int = 17, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """Append size, source_size, target, repeats (how often the mix takes the text) and taken (words).

    Sources in code point order (null last) have the weights in turn, again and again.
    Columns of these names are replaced.  All rows stay; rows with repeats 0 aren't in the mix.
    """
    new = ["size", "source_size", "target", "repeats", "taken"]
    kept = docs.select(*(quoted(c) for c in docs.columns if c.lower() not in new))
    missing, of, full, cut = free_name(kept, "missing", "of", "full", "cut")
    scratch = Scratch(docs.sparkSession)
    sized = append_columns(
        kept.select(quoted(id_column).alias("id"), quoted(source_column).alias("source"), quoted(text_column).alias("text")), "text",
        [T.StructField("size", T.LongType())], lambda: lambda column: [pa.array(word_counts(column))],
    )
    sized = scratch.write(sized.select(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("source"), seeded_hash(F.col("id"), seed).alias("hash"), "size"), "sizes")
    sources = sized.groupBy("missing", "source").agg(F.sum("size").alias("source_size"))
    sources = scratch.write(fill(sources, weights, share, max_epochs), "sources")
    plan = scratch.write(_cut(sized, sources), "plan").select(
        F.col("missing").alias(missing), F.col("source").alias(of), "source_size", "target", F.col("full").alias(full), F.col("cut").alias(cut)
    )
    counted = append_columns(kept, text_column, [T.StructField("size", T.LongType())], lambda: lambda column: [pa.array(word_counts(column))])
    source = quoted(source_column)
    joined = counted.join(plan, (F.coalesce(source, F.lit("")) == F.col(of)) & (source.isNull() == F.col(missing)))
    repeats = F.col(full) + (seeded_hash(quoted(id_column), seed) <= F.col(cut)).cast("bigint")
    return joined.withColumn("repeats", repeats).withColumn("taken", F.col("repeats") * F.col("size")).select(*map(quoted, kept.columns), *new)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its number in ``copy`` (from 1)."""
    taken = mix(docs, **options).where("repeats > 0")
    return taken.select("*", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("copy"))
