"""A byte-level convolutional network in numpy that scores whole texts.

A text's bytes are embedded and convolved with learned filters of ``WIDTH`` bytes at every position.
Positions are pooled in overlapping chunks of ``CHUNK`` blocks of ``BLOCK`` bytes that step by one block less
and cover the whole text, each chunk keeping every filter's maximum; the maximum and the mean over the
chunks are combined into one probability. Embedding and filters are folded into tables by pairs of bytes, so that a position costs
``WIDTH / 2`` look-ups. Texts are laid out with zero bytes between them that no window crosses: a
score depends on the text alone, not on its neighbours in a batch.

Training is mini-batch Adam with hand-written gradients on a bounded sample of labelled rows
(``rows``), the driver's only work. Rows are scored in Arrow batches.

Cases: null and empty texts are scored as one block of zero bytes; texts of any length are scored to
their last byte; equal texts have equal scores; an empty table gives no rows; without labels of both
kinds every score is the smoothed rate of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import Batches, filtered, pieces, run, spans, utf8
from .training import labelled_texts, platt, sigmoid

WIDTH, FILTERS, EMBED, BLOCK, CHUNK = 6, 16, 8, 64, 4
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in blocks, WIDTH - 1 zeros at least behind each text and before the first; blocks of each text."""
    raw, ends = utf8(column)
    size = np.diff(ends)
    blocks = (size + WIDTH - 2) // BLOCK + 1
    start = (np.cumsum(blocks) - blocks) * BLOCK + WIDTH - 1
    out = np.zeros(int(blocks.sum()) * BLOCK + WIDTH - 1, np.uint8)
    out[spans(start, size)] = raw
    return out, blocks


def chunked(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every chunk, by text; chunks overlap by one block."""
    step = CHUNK - 1
    chunks = np.maximum(1, -(-(blocks - 1) // step))
    first = np.cumsum(blocks) - blocks
    text = np.repeat(np.arange(len(blocks)), chunks)
    at = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = first[text] + at * step
    return start, np.minimum(CHUNK, (first + blocks)[text] - start)


class ByteCnn:
    def __init__(self, seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.p = {
            "embed": rnd.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filters": rnd.normal(0, 0.3, (WIDTH, EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rnd.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "last": np.zeros(1, np.float32),
        }
        self.slope, self.shift = 1.0, 0.0

    def tables(self) -> list[np.ndarray]:
        """What a pair of bytes adds at each place of the window."""
        one = [self.p["embed"] @ self.p["filters"][k] for k in range(WIDTH)]
        return [(one[k][:, None, :] + one[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    def block_maxima(self, data: np.ndarray, tables: list[np.ndarray], at_once: int = 512) -> np.ndarray:
        total = (len(data) - WIDTH + 1) // BLOCK
        out = np.empty((total, FILTERS), np.float32)
        pair = (data[:-1].astype(np.int32) << 8) | data[1:]
        for b in range(0, total, at_once):
            n = min(at_once, total - b) * BLOCK
            conv = tables[0][pair[b * BLOCK : b * BLOCK + n]]
            for k in range(1, len(tables)):
                conv += tables[k][pair[b * BLOCK + 2 * k : b * BLOCK + 2 * k + n]]
            out[b : b + at_once] = conv.reshape(-1, BLOCK, FILTERS).max(1)
        return out

    def features(self, maxima: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, ...]:
        start, many = chunked(blocks)
        # maxima of each chunk's blocks; a chunk that has fewer repeats its last one
        member = start[:, None] + np.minimum(np.arange(CHUNK), many[:, None] - 1)
        chunk = np.maximum(maxima[member].max(1) + self.p["bias"], 0)
        ends = np.concatenate([[0], np.cumsum(np.maximum(1, -(-(blocks - 1) // (CHUNK - 1))))])
        top = np.maximum.reduceat(chunk, ends[:-1]) if len(blocks) else np.zeros((0, FILTERS), np.float32)
        mean = np.add.reduceat(chunk, ends[:-1], dtype=np.float64) / np.diff(ends)[:, None] if len(blocks) else np.zeros((0, FILTERS))
        return np.concatenate([top, mean], 1), member, chunk, ends

    def raw(self, column: pa.Array, tables: list[np.ndarray]) -> np.ndarray:
        data, blocks = layout(column)
        feature = self.features(self.block_maxima(data, tables), blocks)[0]
        # summed row by row: a matrix product may round by the batch's shape
        return (feature * self.p["out"].astype(np.float64)).sum(1) + float(self.p["last"][0])

    def score(self, column: pa.Array, tables: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.slope * self.raw(column, tables) + self.shift)

    def gradients(self, column: pa.Array, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        data, blocks = layout(column)
        total = int(blocks.sum())
        one = [self.p["embed"] @ self.p["filters"][k] for k in range(WIDTH)]
        n = total * BLOCK
        conv = one[0][data[:n]]
        for k in range(1, WIDTH):
            conv += one[k][data[k : k + n]]
        conv = conv.reshape(total, BLOCK, FILTERS)
        where = conv.argmax(1)
        maxima = np.take_along_axis(conv, where[:, None], 1)[:, 0]
        feature, member, chunk, ends = self.features(maxima, blocks)
        g = (sigmoid(feature @ self.p["out"] + self.p["last"][0]) - y) * weight
        grad = {"out": feature.T @ g, "last": np.array([g.sum()])}
        back = g[:, None] * self.p["out"]
        text = np.repeat(np.arange(len(blocks)), np.diff(ends))
        into = back[text, FILTERS:] / np.diff(ends)[text][:, None]
        top = chunk == feature[text, :FILTERS]  # chunks that tie for the maximum share its gradient
        into = into + top * (back[:, :FILTERS] / np.add.reduceat(top, ends[:-1], dtype=np.int64))[text]
        into = into * (chunk > 0)
        grad["bias"] = into.sum(0)
        best = member[np.arange(len(member))[:, None], maxima[member].argmax(1)]
        position = best * BLOCK + where[best, np.arange(FILTERS)]
        flat = np.broadcast_to(np.arange(FILTERS), position.shape).ravel()
        grad["embed"], grad["filters"] = np.zeros((256, EMBED)), np.zeros((WIDTH, EMBED, FILTERS))
        for k in range(WIDTH):
            byte = data[position + k].ravel().astype(np.int64)
            by = np.bincount(byte * FILTERS + flat, weights=into.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
            grad["filters"][k] = self.p["embed"].T @ by
            grad["embed"] += by @ self.p["filters"][k].T
        return grad


def train(column: pa.Array, y: np.ndarray, epochs: int = 8, size: int = 48, rate: float = 0.02, seed: int = 7) -> ByteCnn:
    model, rnd = ByteCnn(seed), np.random.default_rng(seed)
    held = np.arange(len(y)) % 6 == 5
    learn = np.flatnonzero(~held)
    if len(set(y[learn])) < 2:
        model.p = {k: np.zeros_like(v) for k, v in model.p.items()}
        model.p["last"][0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return model
    share = y[learn].mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    m, v, t = {k: np.zeros(x.shape) for k, x in model.p.items()}, {k: np.zeros(x.shape) for k, x in model.p.items()}, 0
    for epoch in range(epochs):
        order = rnd.permutation(learn)
        for b in range(0, len(order), size):
            pick = order[b : b + size]
            grad = model.gradients(column.take(pa.array(pick)), y[pick], weight[pick] / len(pick))
            t += 1
            pace = rate * (1 - epoch / epochs)
            for k, x in model.p.items():
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
                x -= (pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    tables = model.tables()
    z = model.raw(column, tables)
    use = held if len(set(y[held])) == 2 else ~held
    model.slope, model.shift = platt(z[use], y[use])
    return model


def score_batches(shared):
    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables()
        for batch in batches:
            score = np.concatenate([model.score(part, tables) for part in pieces(batch.column("text").fill_null(""))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return step


def held_out():
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = 2000) -> ByteCnn:
    return train(*labelled_texts(docs, labels, "quality", rows, ~held_out()))


def score_documents(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """held_out, score and verdict of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return run(docs.select("doc_id", "text", held_out().alias("held_out")), SCHEMA, score_batches(shared))


def keep_documents(docs: DataFrame, model: ByteCnn, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda text: shared.value.score(text, shared.value.tables()) >= least)
