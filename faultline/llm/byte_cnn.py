"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import buffers

WIDTH, STRIDE, EMBED, FILTERS = 12, 2, 6, 24
#: Labelled rows the network is fitted on, at most.
TRAIN_ROWS = 3000
EPOCHS = 16
THRESHOLD = 0.7
#: Bytes convolved at once.
SEGMENT = 1 << 20


@dataclass
class Network:
    """embed[256, e], filters[width * e, f] with bias, weights[f] with bias: byte chunks to one probability."""

    embed: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(draw(256, EMBED, scale=0.5), draw(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5),
                   np.zeros(FILTERS, np.float32), draw(FILTERS, scale=0.3), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.filter_bias, self.weights, self.bias]


def _lay_out(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(padded bytes, first and end chunk of each text): each text starts on the stride and ends in zeros, and its
    chunks are those that begin in it, so they never reach the next text or depend on the text's place."""
    chunks = -(-np.maximum(lengths, 1) // STRIDE)
    starts = np.concatenate([[0], np.cumsum(chunks + WIDTH // STRIDE)])
    padded = np.zeros(int(starts[-1]) * STRIDE + WIDTH, np.uint8)
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    padded[np.arange(len(data)) + np.repeat(starts[:-1] * STRIDE - before, lengths)] = data
    return padded, starts[:-1], starts[:-1] + chunks


def _chunks(net: Network, padded: np.ndarray, first: int, last: int) -> np.ndarray:
    """Embedded chunks [first, last), one row each."""
    values = net.embed[padded[first * STRIDE: (last - 1) * STRIDE + WIDTH]].reshape(-1)
    return np.lib.stride_tricks.as_strided(
        values, (last - first, WIDTH * EMBED), (STRIDE * EMBED * 4, 4), writeable=False)


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each filter's largest response over all chunks of a text; long texts are convolved part by part."""
    out = np.zeros((len(offsets) - 1, FILTERS), np.float32)
    text = 0
    while text < len(out):
        last = max(text + 1, int(np.searchsorted(offsets, offsets[text] + SEGMENT, "right")) - 1)
        last = min(last, len(out))
        padded, starts, ends = _lay_out(data[offsets[text]: offsets[last]], np.diff(offsets[text: last + 1]))
        for first in range(0, int(ends[-1]), SEGMENT // STRIDE):
            end = min(first + SEGMENT // STRIDE, int(ends[-1]))
            response = _chunks(net, padded, first, end) @ net.filters
            held = np.flatnonzero((ends > first) & (starts < end))
            # from each text's first chunk to its end; what lies between texts is taken apart and left out
            bounds = np.stack([np.maximum(starts[held], first), np.minimum(ends[held], end)], axis=1).ravel() - first
            bounds = bounds[:-1] if bounds[-1] == end - first else bounds
            best = np.maximum.reduceat(response, bounds, axis=0)[::2] + net.filter_bias
            out[text + held] = np.maximum(out[text + held], best)
        text = last
    return out


def probability(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    z = pooled(net, data, offsets).astype(np.float64) @ net.weights.astype(np.float64) + float(net.bias[0])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on the logistic loss, classes weighted alike; the gradient passes through each filter's best chunk."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    if not len(texts) or labels.min() == labels.max():
        net.weights[:] = 0
        net.bias[:] = 0 if not len(texts) else (4 if labels[0] else -4)
        return net
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step, batch = 0, 64
    for epoch in range(epochs):
        rate = 0.01 * (0.1 ** (epoch / epochs))
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at: at + batch]
            data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
            padded, starts, ends = _lay_out(data, np.array([len(texts[i]) for i in rows]))
            chunks = _chunks(net, padded, 0, int(ends[-1]))
            response = chunks @ net.filters
            best = np.stack([s + response[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
            raw = np.take_along_axis(response, best, axis=0) + net.filter_bias
            pool = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(pool @ net.weights + net.bias[0], -30, 30)))
            dz = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            dpool = dz[:, None] * net.weights * (raw > 0)
            picked = chunks[best]                                                     # text, filter, width * e
            dchunk = dpool[:, :, None] * net.filters.T[None]
            grads = [np.zeros_like(net.embed), np.einsum("tf,tfw->wf", dpool, picked), dpool.sum(0),
                     pool.T @ dz + 1e-3 * net.weights, dz.sum(keepdims=True)]
            source = padded[best[:, :, None] * STRIDE + np.arange(WIDTH)]
            np.add.at(grads[0], source.reshape(-1), dchunk.reshape(-1, EMBED))
            step += 1
            for value, grad, (m, v) in zip(net.parts(), grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def held_out(id_column: str = "doc_id") -> Column:
    """Rows whose labels are never learned; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "quality", rows: int = TRAIN_ROWS) -> Network:
    """Fits on at most `rows` labelled rows that are not held out, half of each class where there are enough,
    taken in hash order; only their ids are sent to the tasks and only their texts to the driver."""
    known = labels.where(~held_out(id_column) & F.col(label_column).isin(0, 1)).select(
        F.col(id_column).alias("k"), F.col(label_column).cast("int").alias("y")).dropDuplicates(["k"])
    mix = F.xxhash64(F.lit("train"), "k")
    chosen = known.where("y = 0").orderBy(mix, "k").limit(rows // 2).unionAll(
        known.where("y = 1").orderBy(mix, "k").limit(rows // 2))
    own = docs.select(F.col(f"`{id_column}`").alias("k"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("t"))
    texts = own.join(F.broadcast(chosen), "k")
    sample = texts.orderBy(F.xxhash64("k"), "k", F.xxhash64("t")).limit(rows).collect()
    return fit([r.t.encode() for r in sample], np.array([r.y for r in sample], np.float64))


def score(docs: DataFrame, net: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row, from all bytes of its text and nothing else.

    A null text is scored as an empty one, whatever its length a text is covered whole, equal texts get equal
    scores, every row gets one, and an empty table stays empty. Without labels of both kinds the score is constant.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = probability(net, *buffers(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(value, pa.float64()),
                 pa.array((value >= THRESHOLD).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(f"`{id_column}`").alias("id"), held_out(id_column).alias("held_out"),
                       F.col(f"`{text_column}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed(
        "id", id_column)
