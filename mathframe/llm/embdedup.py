"""Embedding near-duplicates by lattice hashing.

Each of ``TABLES`` hash tables projects the unit vectors on ``2 * 8`` random orthogonal directions,
scales and shifts them, and decodes each eight to its nearest E8 lattice point; the two points are a
vector's cell.  A vector also probes three neighbouring cells (the next lattice point of either
eight, and of both).  Vectors that meet in a cell are verified by their cosine in double
precision.

Equal vectors are one class and are counted, not paired.  Cells of few classes give pairs.  In
fuller cells the classes are split into blocks, and each pair of blocks is a group which returns how many
links each class has there and links that connect them, never the pairs; a pair is counted
in the first such cell where it meets.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components,
and rows without an id, link with nothing (0 links, their own component); vectors of different dimensions don't link;
repeated rows are equal vectors, and one id may have several vectors; other columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import append_columns, quoted
from .bytetext import mix
from .components import connected_components
from .lattice import nearest, neighbours
from .shipping import ship_package
from .storage import Scratch

TABLES = 8
SCALE = 1.5
COSINE = 0.95
#: Lengths that vectors may have; those of different lengths never link.
MOST_DIMENSIONS = 32
#: Cells of more members than this are compared in blocks.
FULL = 64
BLOCK = 512


class Hasher:
    """Cells of unit vectors; the same for the same dimension and seed."""

    def __init__(self, dim: int, tables: int = TABLES, scale: float = SCALE, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tables = tables
        need, parts = tables * 16, []
        while sum(p.shape[1] for p in parts) < need:
            parts.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : max(8, dim - dim % 8)])
        self.turn = np.concatenate(parts, axis=1)[:, :need] * np.sqrt(dim / 8) * scale
        self.shift = rng.uniform(0, 1, need)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cell (n, tables) and probed cells (n, tables, 3), as 64-bit names."""
        at = unit @ self.turn + self.shift
        own, probes = [], []
        for t in range(self.tables):
            names = []
            for half in range(2):
                x = at[:, 16 * t + 8 * half : 16 * t + 8 * half + 8]
                point = nearest(x)
                names.append((_name(point, 2 * t + half), _name(neighbours(x, point, 1)[:, 0], 2 * t + half)))
            (a, a2), (b, b2) = names
            own.append(_cell(a, b, t))
            probes.append(np.stack([_cell(a2, b, t), _cell(a, b2, t), _cell(a2, b2, t)], axis=1))
        return np.stack(own, axis=1), np.stack(probes, axis=1)


def _name(points: np.ndarray, salt: int) -> np.ndarray:
    twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
    out = np.full(len(points), salt + 1, np.uint64)
    for k in range(8):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + twice[:, k])
    return out


def _cell(a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
    return mix(a * np.uint64(3) + mix(b + np.uint64(table))).view(np.int64)


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision (0 where a vector can't link), and whether they can."""
    n = len(column)
    out = np.zeros((n, dim))
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    whole = lengths == dim
    flat = column.filter(pa.array(whole)).flatten().cast(pa.float64())
    out[whole] = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    ok = whole & np.isfinite(out).all(axis=1) & (out != 0).any(axis=1)
    out[~ok] = 0
    # Brought to a largest component of about one first, so that no square is too large or too small.
    out[ok] = np.ldexp(out[ok], -np.frexp(np.abs(out[ok]).max(axis=1))[1][:, None])
    out[ok] /= np.sqrt((out[ok] * out[ok]).sum(axis=1))[:, None]
    return out, ok


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a binary column of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _cosine_of_pairs(x: pa.Array, y: pa.Array) -> pa.Array:
    n = len(x)
    if not n:
        return pa.array([], pa.float64())
    dim = len(x[0].as_py()) // 8
    return pa.array((_matrix(x, dim) * _matrix(y, dim)).sum(axis=1))


def _block_links(group: pa.Table, cosine: float) -> pa.Table:
    """Links of one pair of blocks of a full cell.

    Returns rows (node, other, links): for each class how many vectors it links with in
    this group, and for some pairs other is set: these connect what the pairs connect.
    """
    key = group["key"][0].as_py()
    node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
    side, own_here = group["side"].to_numpy(), group["owner"].to_numpy(zero_copy_only=False)
    raw = group["vector"].to_pylist()
    vectors = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    owned, probed = group["owned"].to_pylist(), group["probed"].to_pylist()
    earlier = {k: i for i, k in enumerate(sorted({k for ks in (*owned, *probed) for k in ks if k < key}))}
    is_own, is_probe = np.zeros((len(node), len(earlier)), np.float32), np.zeros((len(node), len(earlier)), np.float32)
    for table, rows in ((is_own, owned), (is_probe, probed)):
        for i, ks in enumerate(rows):
            table[i, [earlier[k] for k in ks if k in earlier]] = 1
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    inner = not len(right)
    right = left if inner else right
    near = vectors[left] @ vectors[right].T >= cosine - 1e-9
    a, b = np.nonzero(near & (own_here[left][:, None] | own_here[right][None, :]))
    a, b = left[a], right[b]
    if inner:
        a, b = a[a < b], b[a < b]
    exact = (vectors[a] * vectors[b]).sum(axis=1) >= cosine
    a, b = a[exact], b[exact]
    links = np.zeros(len(node), np.int64)
    root, joined = np.arange(len(node)), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for lo in range(0, len(a), 1 << 16):
        i, j = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
        met = ((is_own[i] * (is_own[j] + is_probe[j])).sum(axis=1) + (is_own[j] * is_probe[i]).sum(axis=1)) > 0
        np.add.at(links, i[~met], copies[j[~met]])
        np.add.at(links, j[~met], copies[i[~met]])
        for p, q in zip(i.tolist(), j.tolist()):
            x, y = find(p), find(q)
            if x != y:
                root[max(x, y)] = min(x, y)
                joined.append((p, q))
    some = np.flatnonzero(links)
    pairs = np.array(joined, np.int64).reshape(-1, 2)
    other = pa.array(np.append(np.zeros(len(some), np.int64), node[pairs[:, 1]]), mask=np.append(np.ones(len(some), bool), np.zeros(len(pairs), bool)))
    return pa.table({"node": np.append(node[some], node[pairs[:, 0]]), "other": other, "links": np.append(links[some], np.zeros(len(pairs), np.int64))})


def near_duplicates(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE, tables: int = TABLES, full: int = FULL, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``vectors``: its id, n_links, component_id and kept."""
    given = vectors.select(quoted(id_column).alias("id"), quoted(vector_column).cast("array<double>").alias("v"))
    dims = [r[0] for r in given.where("size(v) > 0").select(F.size("v").alias("dim")).distinct().limit(MOST_DIMENSIONS + 1).collect()]
    if len(dims) > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions of vectors")
    if len(dims) <= 1:
        return _of_dimension(given, dims[0] if dims else 1, id_column, cosine, tables, full, block)
    parts = [given.where(F.size("v") == dim) for dim in dims] + [given.where("v is null or size(v) <= 0")]
    found = [_of_dimension(part, dim, id_column, cosine, tables, full, block) for part, dim in zip(parts, [*dims, 1])]
    return reduce(DataFrame.union, found)


def _of_dimension(given: DataFrame, dim: int, id_column: str, cosine: float, tables: int, full: int, block: int) -> DataFrame:
    """Near-duplicates of vectors (id, v) of one dimension."""
    spark = given.sparkSession
    scratch = Scratch(spark)

    def make_unit():
        def run(column: pa.Array) -> list[pa.Array]:
            unit, ok = unit_vectors(column, dim)
            return [pa.array([u.tobytes() if o else None for u, o in zip(unit, ok)], pa.binary())]

        return run

    rows = append_columns(given, "v", [T.StructField("vector", T.BinaryType())], make_unit).select("id", "vector")
    rows = rows.withColumn("vector", F.when(F.col("id").isNotNull(), F.col("vector")))
    rows = scratch.write(rows.select("id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")), "rows")
    usable = rows.where("vector is not null")
    # A class is named by the hash of its vector, so that one id may have several vectors.
    classes = usable.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = scratch.write(classes.withColumn("node", F.xxhash64("h1", "h2")), "classes")

    def make_cells():
        hasher = Hasher(dim, tables)

        def run(column: pa.Array) -> list[pa.Array]:
            own, probes = hasher.cells(_matrix(column, dim)) if len(column) else (np.zeros((0, tables), np.int64), np.zeros((0, tables, 3), np.int64))
            return [pa.array(list(own), pa.list_(pa.int64())), pa.array(list(probes.reshape(len(own), -1)), pa.list_(pa.int64()))]

        return run

    cells = [T.StructField("own", T.ArrayType(T.LongType())), T.StructField("probes", T.ArrayType(T.LongType()))]
    each = usable.join(classes, ["h1", "h2"]).where("id = least").dropDuplicates(["node"]).select("node", "copies", "vector")
    each = scratch.write(append_columns(each, "vector", cells, make_cells), "cells")
    member = F.explode(F.concat(
        F.transform("own", lambda k: F.struct(k.alias("key"), F.lit(True).alias("owner"))),
        F.transform("probes", lambda k: F.struct(k.alias("key"), F.lit(False).alias("owner"))),
    )).alias("m")
    members = each.select("node", "copies", member).select("node", "copies", "m.key", "m.owner").distinct()
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.max("owner").alias("owned")).where("size > 1 and owned")
    members = scratch.write(members.join(sizes.select("key", "size"), "key"), "members")
    few, many = members.where(F.col("size") <= full), members.where(F.col("size") > full)

    # Cells of few classes: pairs, verified.
    other = few.select("key", F.col("node").alias("node2"), F.col("owner").alias("owner2"))
    pairs = few.join(other, "key").where("node < node2 and (owner or owner2)").select("node", "node2").distinct()
    left = each.select("node", "copies", F.col("vector").alias("x"))
    right = each.select(F.col("node").alias("node2"), F.col("copies").alias("copies2"), F.col("vector").alias("y"))
    both = pairs.join(left, "node").join(right, "node2")
    linked = _with_cosine(both).where(F.col("cosine") >= cosine).select("node", "node2", "copies", "copies2")
    linked = scratch.write(linked, "linked")
    links = linked.select(F.col("node").alias("a"), F.col("node2").alias("b"))
    counts = linked

    if many.limit(1).count():
        # Full cells: counts and connecting links of each pair of blocks.
        held = many.groupBy("node").agg(
            F.collect_set(F.when(F.col("owner"), F.col("key"))).alias("owned"),
            F.collect_set(F.when(~F.col("owner"), F.col("key"))).alias("probed"),
        )
        held = scratch.write(held, "held")
        blocks = F.ceil(F.col("size") / block).cast("int")
        dealt = many.select("key", "node", "copies", "owner", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("mine"))
        paired = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("theirs"))
        paired = paired.join(each.select("node", "vector"), "node").join(held, "node")
        groups = paired.select(
            "key", "node", "copies", "owner", "vector", "owned", "probed",
            F.least("mine", "theirs").alias("first"), F.greatest("mine", "theirs").alias("second"),
            F.when(F.col("mine") <= F.col("theirs"), 0).otherwise(1).alias("side"),
        )
        ship_package(spark)
        found = groups.groupBy("key", "first", "second").applyInArrow(lambda t: _block_links(t, cosine), "node bigint, other bigint, links bigint")
        found = scratch.write(found, "full-cells")
        links = links.union(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
        # A pair that also meets in a full cell was counted there.
        l1 = held.select("node", F.col("owned").alias("o1"), F.col("probed").alias("p1"))
        l2 = held.select(F.col("node").alias("node2"), F.col("owned").alias("o2"), F.col("probed").alias("p2"))
        meet = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
        counts = linked.join(l1, "node", "left").join(l2, "node2", "left").where(~(meet("o1", "o2") | meet("o1", "p2") | meet("p1", "o2"))).select("node", "node2", "copies", "copies2")
    totals = counts.select(F.explode(F.array(
        F.struct(F.col("node").alias("node"), F.col("copies2").alias("links")), F.struct(F.col("node2").alias("node"), F.col("copies").alias("links")),
    )).alias("x")).select("x.*")
    if counts is not linked:
        totals = totals.union(found.where("other is null").select("node", "links"))
    totals = totals.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(links, scratch)
    named = classes.join(totals, "node", "left").join(parts, "node", "left")
    named = named.select("h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("whole"))
    named = scratch.write(named, "named")
    firsts = named.groupBy(F.struct("whole").alias("k")).agg(F.min("least").alias("part")).select("k.whole", "part")
    named = named.join(firsts, "whole").drop("whole", "least")
    tagged = rows.select("id", F.when(F.col("vector").isNotNull(), F.col("h1")).alias("h1"), F.when(F.col("vector").isNotNull(), F.col("h2")).alias("h2"))
    out = tagged.join(named, ["h1", "h2"], "left")
    part = F.coalesce("part", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), part.alias("component_id"), (F.col("id") == part).alias("kept"))


def _with_cosine(pairs: DataFrame) -> DataFrame:
    """Append the cosine of two columns of unit vectors."""
    schema = T.StructType([*pairs.select("node", "node2", "copies", "copies2").schema.fields, T.StructField("cosine", T.DoubleType())])

    def run(batches):
        for batch in batches:
            found = _cosine_of_pairs(batch.column("x"), batch.column("y"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "node2", "copies", "copies2")), found], names=schema.names)

    ship_package(pairs.sparkSession)
    return pairs.mapInArrow(run, schema)
