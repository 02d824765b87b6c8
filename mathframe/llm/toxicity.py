"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained in numpy from
texts confirmed as toxic and from unlabelled texts.  With a class prior p, the risk is

    p * E_P[loss(+)] + max(0, E_U[loss(-)] - p * E_P[loss(-)])

whose second term estimates the risk on clean texts without any clean example; where
it would turn negative, its gradient is reversed, so that it can't be overfitted.

Training uses at most ``positives`` + ``unlabelled`` texts, chosen by a hash of their ids;
their distinct features are gathered in bounded memory.  Scoring streams whole texts.

Defined results: null and empty texts have no features and get the score of the bias;
ties don't matter (a score depends on the text alone); texts of any length are taken whole; columns ``score`` and
``predicted`` are replaced, others may have any names; empty tables give no rows; without a confirmed example every text gets score 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import append_columns
from .sampling import sample_labelled, sample_rows
from .bytetext import LOWER, NOT_ALNUM, byte_hashes, pieces, words

#: Beginnings of words, in bytes, that are features beside whole words.
PREFIXES = (5, 6, 7, 8, 9)
HASH_BITS = 22
#: How far the border of the classes is moved at most, as a logit.
MOST_SHIFT = 1.5
#: Bounds of the training sample, in texts.
POSITIVES, UNLABELLED = 1500, 3000


def feature_hashes(column: pa.Array):
    """(row, feature) pairs, distinct within a piece; features are numbers of HASH_BITS bits."""
    for piece in pieces(column, NOT_ALNUM):
        data = LOWER[piece.data]
        starts, ends, segment = words(piece, NOT_ALNUM, data)
        row = piece.rows[segment]
        parts = [(row, _bits(byte_hashes(data, starts, ends)))]
        for n in PREFIXES:
            long = ends - starts > n
            parts.append((row[long], _bits(byte_hashes(data, starts[long], starts[long] + n) + np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))))
        yield np.concatenate([r for r, _ in parts]), np.concatenate([f for _, f in parts])


def _bits(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def distinct_features(column: pa.Array) -> list[np.ndarray]:
    """The distinct features of each text, sorted."""
    found: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for row, feature in feature_hashes(column):
        key = np.unique((row << HASH_BITS) | feature)
        edges = np.searchsorted(key >> HASH_BITS, np.arange(len(column) + 1))
        for i in np.unique(row).tolist():
            found[i].append(key[edges[i] : edges[i + 1]] & ((1 << HASH_BITS) - 1))
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in found]


@dataclass
class Model:
    weights: np.ndarray  # 2^HASH_BITS of float32, 0 where a feature isn't used
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Sum the weights of each text's distinct features."""
        n = len(column)
        rows, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, feature in feature_hashes(column):
            used = self.weights[feature] != 0
            key = np.unique((row[used] << HASH_BITS) | feature[used])
            rows.append(key >> HASH_BITS)
            features.append(key & ((1 << HASH_BITS) - 1))
        key = np.unique((np.concatenate(rows) << HASH_BITS) | np.concatenate(features))
        total = np.bincount(key >> HASH_BITS, weights=self.weights[key & ((1 << HASH_BITS) - 1)], minlength=n)[:n]
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def select_features(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Features that toxic texts hold clearly more often than unlabelled ones."""
    size = 1 << HASH_BITS
    in_p = np.bincount(np.concatenate([np.zeros(0, np.int64), *positive]), minlength=size)
    in_u = np.bincount(np.concatenate([np.zeros(0, np.int64), *unlabelled]), minlength=size)
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    share = (in_p + in_u) / (n_p + n_u)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    return np.flatnonzero((in_p >= 2) & (z > 3))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, steps: int = 400, rate: float = 0.05, decay: float = 1e-4, threshold: float = 0.7) -> Model:
    """Full-batch Adam on the non-negative risk with the sigmoid loss."""
    weights = np.zeros(1 << HASH_BITS, np.float32)
    if not positive:
        return Model(weights, -30.0)
    used = select_features(positive, unlabelled)
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[used] = np.arange(len(used))

    def matrix(texts):
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        columns = place[np.concatenate([np.zeros(0, np.int64), *texts])]
        return rows[columns >= 0], columns[columns >= 0]

    sets = [(*matrix(texts), max(1, len(texts)), len(texts)) for texts in (positive, unlabelled)]
    w, b = np.zeros(len(used)), -1.0
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        slopes, risks = [], []
        for rows, columns, _, n in sets:
            s = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=w[columns], minlength=n) + b, -30, 30)))
            risks.append(s)
            slopes.append(s * (1 - s))

        def gradient(k, sign):
            rows, columns, count, _ = sets[k]
            d = sign * slopes[k] / count
            return np.append(np.bincount(columns, weights=d[rows], minlength=len(used)), d.sum())

        clean_risk = risks[1].sum() / sets[1][2] - prior * risks[0].mean()
        on_clean = gradient(1, 1) - prior * gradient(0, 1)
        g = prior * gradient(0, -1) + on_clean if clean_risk >= 0 else -on_clean
        g[:-1] += decay * w
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weights[used] = w
    # The risk's border of the classes, at one half, is cautious.  It is moved to where the share of unlabelled
    # texts above it is the prior, by MOST_SHIFT at most, and then put at the given threshold.
    rows, columns, _, n = sets[1]
    logits = np.bincount(rows, weights=w[columns], minlength=n) + b
    border = float(np.clip(np.quantile(logits, 1 - prior), -MOST_SHIFT, 0)) if n else 0.0
    return Model(weights, float(b - border + np.log(threshold / (1 - threshold))))


def fit(docs: DataFrame, labels: DataFrame, *, learn_from: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, threshold: float = 0.7) -> Model:
    """Train from the rows for which ``learn_from`` (a condition on the id column) holds.

    Only the ids of confirmed examples and the class prior are taken from the labels.
    """
    known = labels.where(learn_from).where(F.col(label_column).isin(0, 1)).select(id_column, F.col(label_column).alias("label"))
    prior = known.agg(F.avg("label")).first()[0]
    wanted = sample_labelled(known.where("label = 1"), id_column, positives)
    examples = _gather(sample_rows(docs, wanted, id_column, positives).select(F.col(text_column).alias("text")))
    others = sample_labelled(docs.where(learn_from).select(id_column), id_column, unlabelled)
    background = _gather(sample_rows(docs, others, id_column, unlabelled).select(F.col(text_column).alias("text")))
    return train(examples, background, min(0.9, max(1e-3, prior or 0)), threshold=threshold)


def _gather(texts: DataFrame) -> list[np.ndarray]:
    """Distinct features of a bounded sample of texts."""

    def make():
        return lambda column: [pa.array([f.astype(np.int32).tobytes() for f in distinct_features(column)], pa.binary())]

    rows = append_columns(texts, "text", [T.StructField("features", T.BinaryType())], make).select("features").collect()
    return [np.frombuffer(x, np.int32).astype(np.int64) for x in sorted(bytes(r.features) for r in rows)]


def score_toxicity(docs: DataFrame, model: Model, *, text_column: str = "text", threshold: float = 0.7) -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` (1 if it reaches the threshold)."""
    used = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.bias))

    def make():
        used, values, bias = shared.value
        weights = np.zeros(1 << HASH_BITS, np.float32)
        weights[used] = values
        model = Model(weights, bias)
        return lambda column: [pa.array(model.score(column), pa.float64())]

    scored = append_columns(docs, text_column, [T.StructField("score", T.DoubleType())], make)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
