"""Quality classification by a byte-level convolutional network in numpy.

A text is covered by chunks of ``2 * STEP`` positions, each overlapping the next by half.
``FILTERS`` learned filters of ``WIDTH`` bytes slide over all positions; each filter's
greatest response in a chunk (max-pooling) is a feature of the chunk.  A small hidden layer
judges each chunk, the chunks' hidden values are averaged over the whole text, and a last
layer turns them into one probability.

Filters look bytes up in tables (a convolution over one-hot bytes).  For scoring, the tables of two
neighbouring bytes are added up beforehand, so a position takes WIDTH / 2 look-ups.

Training uses at most ``SAMPLE`` labelled texts of each class, chosen by a hash of their ids,
with all chunks of each; scoring covers the whole text, too.

Defined results: a null or empty text is one chunk of padding and gets that score; ties don't
matter (a score depends on the text alone); an empty table gives no rows; without labels
of both classes every text gets the share of good ones (1 without any label).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import append_columns
from .bytetext import column_bytes
from .sampling import sample_labelled, sample_rows

STEP = 128
WIDTH = 6
FILTERS = 16
HIDDEN = 12
SAMPLE = 800
#: Weight of the short texts that are cut from training texts, beside that of whole ones.
CROP_WEIGHT = 0.1
#: Positions handled at once while scoring.
SLAB = 1 << 15


@dataclass
class Network:
    """tables[j, byte, filter], a hidden layer for chunks and an output layer for texts."""

    tables: np.ndarray
    shift: np.ndarray
    hidden: np.ndarray
    hidden_shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.tables, self.shift, self.hidden, self.hidden_shift, self.out, self.out_shift]


def new_network(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return Network(
        normal(0.3, WIDTH, 256, FILTERS), np.zeros(FILTERS, np.float32), normal(0.4, FILTERS, HIDDEN),
        np.full(HIDDEN, 0.1, np.float32), normal(0.4, HIDDEN), np.zeros(1, np.float32),
    )


def padded_blocks(lengths: np.ndarray) -> np.ndarray:
    """Blocks of STEP positions for texts of these lengths."""
    return np.maximum(1, -(-lengths // STEP))


def block_maxima(net: Network, pairs: list[np.ndarray], column: pa.Array):
    """(row, blocks of the row so far, responses) slab by slab: the filters' maxima in each block.

    Each text is padded with zero bytes to whole blocks and one more, so that no filter
    ever sees two texts.
    """
    data, offsets = column_bytes(column)
    n_blocks = padded_blocks(np.diff(offsets)) + 1
    n, i = len(n_blocks), 0
    per_slab = SLAB // STEP
    while i < n:
        j = max(i + 1, int(np.searchsorted(np.cumsum(n_blocks[i:]), per_slab, side="right")) + i)
        if n_blocks[i] <= per_slab:
            starts = np.append(0, np.cumsum(n_blocks[i:j]))
            flat = np.zeros(starts[-1] * STEP, np.uint8)
            lo, hi = offsets[i], offsets[j]
            move = np.repeat(starts[:-1] * STEP - (offsets[i:j] - lo), np.diff(offsets[i : j + 1]))
            flat[np.arange(hi - lo) + move] = data[lo:hi]
            maxima = _maxima(net, pairs, flat)
            real = np.ones(len(maxima), bool)
            real[starts[1:] - 1] = False
            yield np.repeat(np.arange(i, j), n_blocks[i:j] - 1), maxima[real]
        else:
            for at in range(0, int(n_blocks[i] - 1), per_slab):
                count = min(per_slab, int(n_blocks[i]) - 1 - at)
                flat = np.zeros((count + 1) * STEP, np.uint8)
                part = data[offsets[i] + at * STEP : min(offsets[i + 1], offsets[i] + (at + count + 1) * STEP)]
                flat[: len(part)] = part
                yield np.full(count, i), _maxima(net, pairs, flat)[:-1]
        i = j


def _maxima(net: Network, pairs: list[np.ndarray], flat: np.ndarray) -> np.ndarray:
    """Filter maxima of each block of STEP positions; positions at the end see zero bytes."""
    ext = np.zeros(len(flat) + WIDTH, np.uint8)
    ext[: len(flat)] = flat
    codes = (ext[:-1].astype(np.intp) << 8) | ext[1:]
    response = pairs[0].take(codes[: len(flat)], axis=0)
    for k in range(1, len(pairs)):
        response += pairs[k].take(codes[2 * k : 2 * k + len(flat)], axis=0)
    return np.maximum(response.reshape(-1, STEP, FILTERS).max(axis=1) + net.shift, 0)


def pair_tables(net: Network) -> list[np.ndarray]:
    """For each two neighbouring bytes the sum of their tables, as rows of 256 * first + second."""
    return [(net.tables[j][:, None, :] + net.tables[j + 1][None, :, :]).reshape(65536, FILTERS).copy() for j in range(0, WIDTH, 2)]


def score_texts(net: Network, pairs: list[np.ndarray], column: pa.Array) -> np.ndarray:
    n = len(column)
    total, chunks = np.zeros((n, HIDDEN)), np.zeros(n, np.int64)
    last_row, last = -1, None
    for row, maxima in block_maxima(net, pairs, column):
        if last_row == row[0]:  # a long text goes on: its chunks overlap the slabs
            row, maxima = np.append(last_row, row), np.concatenate([last[None], maxima])
        elif last_row >= 0 and not chunks[last_row]:
            _add(net, np.array([last_row]), last[None], total, chunks)
        same = row[1:] == row[:-1]
        _add(net, row[1:][same], np.maximum(maxima[1:], maxima[:-1])[same], total, chunks)
        ends = np.append(row[1:] != row[:-1], False)
        alone = ends & (chunks[row] == 0)
        _add(net, row[alone], maxima[alone], total, chunks)
        last_row, last = int(row[-1]), maxima[-1]
    if last_row >= 0 and not chunks[last_row]:
        _add(net, np.array([last_row]), last[None], total, chunks)
    z = (total / np.maximum(1, chunks)[:, None]) @ net.out + net.out_shift[0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _add(net: Network, row: np.ndarray, pooled: np.ndarray, total: np.ndarray, chunks: np.ndarray) -> None:
    hidden = np.maximum(pooled @ net.hidden + net.hidden_shift, 0)
    np.add.at(total, row, hidden)
    np.add.at(chunks, row, 1)


def text_chunks(column: pa.Array) -> list[bytes]:
    """All chunks of each text, as padded bytes."""
    data, offsets = column_bytes(column)
    size = 2 * STEP + WIDTH - 1
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        chunks = max(1, int(padded_blocks(np.array([b - a]))[0]) - 1)
        flat = np.zeros((chunks + 1) * STEP + WIDTH - 1, np.uint8)
        flat[: b - a] = data[a : min(b, a + len(flat))]
        out.append(np.lib.stride_tricks.sliding_window_view(flat, size)[:: STEP].tobytes())
    return out


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, *, epochs: int = 12, batch: int = 48, rate: float = 0.01, seed: int = 3) -> Network:
    """Adam on the weighted log loss; gradients pass through each chunk's greatest responses."""
    net = new_network()
    rng = np.random.default_rng(seed)
    size = 2 * STEP + WIDTH - 1
    chunks = [np.frombuffer(t, np.uint8).reshape(-1, size) for t in texts]
    crops = [_crop(c, rng) for c in chunks]
    chunks, labels, weights = chunks + crops, np.tile(labels, 2), np.append(weights, CROP_WEIGHT * weights)
    arrays = net.arrays()
    first = [np.zeros_like(a) for a in arrays]
    second = [np.zeros_like(a) for a in arrays]
    step = 0
    steps = epochs * -(-len(chunks) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(chunks))
        for lo in range(0, len(order), batch):
            chosen = order[lo : lo + batch]
            grads = _gradients(net, [chunks[i] for i in chosen], labels[chosen], weights[chosen])
            step += 1
            pace = rate * (1 - step / (steps + 1))
            for a, g, m, v in zip(arrays, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


def _crop(chunks: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A short text made from one of a text's chunks, so that short texts are learned too."""
    out = np.zeros((1, chunks.shape[1]), np.uint8)
    chosen = chunks[rng.integers(len(chunks))]
    n = int(2 ** rng.uniform(2, np.log2(STEP / 2)))
    start = int(rng.integers(max(1, int((chosen != 0).sum()) - n)))
    out[0, :n] = chosen[start : start + n]
    return out


def _gradients(net: Network, chunks: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    flat = np.concatenate(chunks)
    text = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
    count = np.bincount(text, minlength=len(chunks)).astype(np.float32)
    span = 2 * STEP
    response = net.tables[0].take(flat[:, :span], axis=0)
    for j in range(1, WIDTH):
        response += net.tables[j].take(flat[:, j : j + span], axis=0)
    place = response.argmax(axis=1)
    raw = np.take_along_axis(response, place[:, None, :], axis=1)[:, 0, :] + net.shift
    pooled = np.maximum(raw, 0)
    before = pooled @ net.hidden + net.hidden_shift
    hidden = np.maximum(before, 0)
    mean = np.zeros((len(chunks), HIDDEN), np.float32)
    np.add.at(mean, text, hidden)
    mean /= count[:, None]
    score = 1 / (1 + np.exp(-np.clip(mean @ net.out + net.out_shift[0], -30, 30)))
    d_z = ((score - labels) * weights / weights.sum()).astype(np.float32)
    d_hidden = (d_z / count)[text][:, None] * net.out[None, :] * (before > 0)
    d_pooled = (d_hidden @ net.hidden.T) * (raw > 0)
    d_tables = np.zeros_like(net.tables)
    which = np.broadcast_to(np.arange(FILTERS), place.shape)
    for j in range(WIDTH):
        byte = np.take_along_axis(flat, place + j, axis=1)
        d_tables[j] = np.bincount((byte.astype(np.int64) * FILTERS + which).ravel(), weights=d_pooled.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
    d_tables += 2e-5 * net.tables
    return [d_tables, d_pooled.sum(axis=0), pooled.T @ d_hidden, d_hidden.sum(axis=0), mean.T @ d_z, np.array([d_z.sum()], np.float32)]


def constant_network(share: float) -> Network:
    """Gives every text the same score."""
    net = new_network()
    net.out[:] = 0
    net.out_shift[0] = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    return net


def fit(docs: DataFrame, labels: DataFrame, *, learn_from: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE) -> Network:
    """Train from labelled rows for which ``learn_from`` (a condition on the id column) holds."""
    known = labels.where(learn_from).where(F.col(label_column).isin(0, 1)).select(id_column, F.col(label_column).cast("int").alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    texts, truth = [], []
    for label in (0, 1):
        wanted = sample_labelled(known.where(F.col("label") == label), id_column, sample)
        rows = sample_rows(docs, wanted, id_column, sample).select(F.col(text_column).alias("text"))
        make = lambda: lambda column: [pa.array(text_chunks(column), pa.binary())]
        found = append_columns(rows, "text", [T.StructField("chunks", T.BinaryType())], make).select("chunks").collect()
        texts += sorted(bytes(r.chunks) for r in found)
        truth += [label] * len(found)
    truth = np.array(truth, np.float32)
    if not 0 < truth.sum() < len(truth):
        return constant_network(1.0 if share is None else share)
    return train(texts, truth, np.where(truth == 1, 0.5 / truth.mean(), 0.5 / (1 - truth.mean())).astype(np.float32))


def score_quality(docs: DataFrame, net: Network, *, text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` (1, good, if it reaches the threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(net.arrays())

    def make():
        net = Network(*shared.value)
        pairs = pair_tables(net)
        return lambda column: [pa.array(score_texts(net, pairs, column), pa.float64())]

    scored = append_columns(docs, text_column, [T.StructField("score", T.DoubleType())], make)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
