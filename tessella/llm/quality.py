"""Byte-level convolutional quality classifier in numpy.

Each byte has a fixed vector: its class (blank, line end, lower, upper, digit,
punctuation, control, above 0x7F) and a few random numbers. Learned filters of 8
bytes slide over the whole text in steps of 4. Their rectified outputs are
max-pooled over chunks of 512 bytes that overlap by half, and a logistic layer on
the mean of the chunks' pooled vectors gives one probability.

Fitting takes a bounded sample of rows (``labels.PER_CLASS`` a label, a seeded window of long texts) to the driver; scoring
runs in Arrow batches on the executors, every byte of every text, BLOCK_BYTES at a
time, of a long text too. The sample is enlarged by short cuts of its good texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.labels import fold, labelled_documents, windows
from tessella.llm.textkit import flat_texts

STEP, FILTERS, HALF = 4, 16, 64  # HALF steps are half a chunk
FOLDS, HELD, THRESHOLD = 4, 2, 0.7
BLOCK_BYTES = 1 << 17
CLEAN_WEIGHT = 3.0
_RANDOM_DIMS = 4


def _byte_vectors() -> np.ndarray:
    b = np.arange(256)
    kinds = [
        np.isin(b, [9, 32]),
        np.isin(b, [10, 13]),
        (b >= 97) & (b <= 122),
        (b >= 65) & (b <= 90),
        (b >= 48) & (b <= 57),
        (b > 32) & (b < 127) & ~np.char.isalnum([chr(x) for x in b]),
        (b < 9) | (b == 11) | (b == 12) | ((b > 13) & (b < 32)) | (b == 127),
        b > 127,
    ]
    noise = np.random.default_rng(3).normal(0, 0.5, (256, _RANDOM_DIMS))
    return np.concatenate([np.stack(kinds, axis=1).astype(np.float32), noise], axis=1).astype(np.float32)


BYTES = _byte_vectors()
WIDTH = STEP * BYTES.shape[1]


@dataclass
class Model:
    near: np.ndarray  # WIDTH x FILTERS: the first 4 bytes of a filter
    far: np.ndarray  # the last 4
    bias: np.ndarray
    out: np.ndarray
    constant: np.ndarray


def _steps(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte vectors of all texts by step, which steps begin inside a text, and half-chunks per text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    halves = np.maximum(1, -(-sizes // (STEP * HALF)))
    begins = (np.cumsum(halves) - halves) * HALF
    data = np.zeros(int(halves.sum()) * HALF * STEP, np.uint8)
    real = np.zeros(len(data) // STEP, bool)
    for t, at in zip(texts, begins.tolist(), strict=True):
        data[at * STEP : at * STEP + len(t)] = t
        real[at : at - (-len(t) // STEP)] = True
    return BYTES[data].reshape(-1, WIDTH), real, halves


def _pooled(model: Model, rows: np.ndarray, real: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rectified maxima of each half-chunk (with the step of each), and of each overlapping chunk."""
    z = rows @ model.near + model.bias
    ahead = rows[1:] @ model.far
    ahead[np.cumsum(halves)[:-1] * HALF - 1] = 0  # a text's last step sees nothing of the next text
    z[:-1] += ahead
    np.maximum(z, 0, out=z)
    z[~real] = 0
    cube = z.reshape(-1, HALF, FILTERS)
    at = cube.argmax(axis=1)
    top = np.take_along_axis(cube, at[:, None, :], axis=1)[:, 0]
    last = np.zeros(len(top), bool)
    last[np.cumsum(halves) - 1] = True
    after = np.concatenate([top[1:], top[-1:]])
    after[last] = 0
    return top, at, np.maximum(top, after)


def _mean(chunks: np.ndarray, halves: np.ndarray) -> np.ndarray:
    return np.add.reduceat(chunks, np.cumsum(halves) - halves, axis=0) / halves[:, None]


def _long(model: Model, text: np.ndarray) -> np.ndarray:
    """The mean of a long text's chunks, block by block: each looks two half-chunks ahead."""
    half = STEP * HALF
    n = -(-len(text) // half)
    total = np.zeros(FILTERS)
    for at in range(0, n, BLOCK_BYTES // half):
        to = min(at + BLOCK_BYTES // half, n)
        _, _, chunks = _pooled(model, *_steps([text[at * half : (to + 2) * half]]))
        total += chunks[: to - at].sum(axis=0, dtype=np.float64)
    return total / n


def probabilities(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """The probability of each text, an array of bytes, some BLOCK_BYTES at a time."""
    out, own, size = [np.zeros((0, FILTERS))], [], 0
    for t in [*texts, None]:
        if own and (t is None or size + len(t) > BLOCK_BYTES):
            rows, real, halves = _steps(own)
            out.append(_mean(_pooled(model, rows, real, halves)[2], halves).astype(np.float64))
            own, size = [], 0
        if t is not None and len(t) > 2 * BLOCK_BYTES:
            out.append(_long(model, t)[None])
        elif t is not None:
            own.append(t)
            size += len(t)
    logit = np.concatenate(out) @ model.out.astype(np.float64) + float(model.constant[0])
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def score_column(model: Model, column: pa.Array) -> np.ndarray:
    """The probability of each text of an Arrow column; null is empty."""
    buf, offsets = flat_texts(column)
    return probabilities(model, [buf[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])


def fit(texts: list[np.ndarray], y: np.ndarray, epochs: int = 24, batch: int = 64, seed: int = 5) -> Model:
    """Adam on the logistic loss; gradients pass through each chunk's maxima. Without both labels, a constant."""
    rng = np.random.default_rng(seed)
    scale = (2 / (2 * WIDTH)) ** 0.5
    params = [rng.normal(0, scale, (WIDTH, FILTERS)), rng.normal(0, scale, (WIDTH, FILTERS)), np.full(FILTERS, 0.05), rng.normal(0, 0.3, FILTERS), np.zeros(1)]
    model = Model(*(p.astype(np.float32) for p in params))
    if len(set(y.tolist())) < 2:
        model.out[:] = 0
        model.constant[:] = {1: 4.0, 0: -4.0}.get(int(y[0]) if len(y) else 1)
        return model
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in vars(model).values()]
    # Rows to keep weigh CLEAN_WEIGHT times as much as rows to reject, however many of each the sample has.
    weight = np.where(y == 1, CLEAN_WEIGHT / (y == 1).sum(), 1 / (y == 0).sum()) * len(y) / (1 + CLEAN_WEIGHT)
    t = 0
    for epoch in range(epochs):
        rate = 0.005 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            pick = order[lo : lo + batch]
            rows, real, halves = _steps([texts[i] for i in pick])
            top, at, chunks = _pooled(model, rows, real, halves)
            mean = _mean(chunks, halves)
            p = 1 / (1 + np.exp(-np.clip(mean @ model.out + model.constant[0], -30, 30)))
            g = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            per_chunk = np.repeat(g / halves, halves)[:, None] * model.out
            last = np.zeros(len(top), bool)
            last[np.cumsum(halves) - 1] = True
            later = np.concatenate([top[1:], top[-1:]])
            later[last] = -1
            own = top >= later
            to_half = per_chunk * own
            to_half[1:] += (per_chunk * ~own)[:-1]
            to_half *= top > 0
            step = at + np.arange(len(top))[:, None] * HALF
            after = np.minimum(step + 1, len(rows) - 1)
            near, far = np.empty_like(model.near), np.empty_like(model.far)
            for f in range(FILTERS):
                near[:, f] = to_half[:, f] @ rows[step[:, f]]
                far[:, f] = to_half[:, f] @ rows[after[:, f]]
            grads = [near, far, to_half.sum(axis=0), mean.T @ g, g.sum(keepdims=True)]
            t += 1
            for value, grad, (m, v) in zip(vars(model).values(), grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return model


def score_with(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row, from the whole text; null and empty texts score as no bytes do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_column(model, b.column(1)))], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def with_cuts(texts: list[np.ndarray], y: np.ndarray, seed: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """The sample, and a short cut of each good text, so that short good texts are known as such."""
    rng = np.random.default_rng(seed)
    cuts = []
    for t, good in zip(texts, y, strict=True):
        n = int(rng.integers(20, 200))
        if good and len(t) > n + 10:
            at = int(rng.integers(0, len(t) - n))
            cuts.append(t[at : at + n])
    return texts + cuts, np.concatenate([y, np.ones(len(cuts), y.dtype)])


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows outside the held-out fold; only the text is an input."""
    open_rows = labels.where(fold(F.col("doc_id"), FOLDS) != HELD)
    sample: pd.DataFrame = windows(labelled_documents(documents, open_rows, "quality")).toPandas()
    return fit(*with_cuts([np.frombuffer(t.encode(), np.uint8) for t in sample["text"]], sample["y"].to_numpy()))


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents``.

    Rows with a null id are scored and not held out. Repeated rows are scored
    each. Without any usable label all scores are alike and high. Other columns
    are not read.
    """
    scored = score_with(documents, train(documents, labels))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that score at least 0.7, with all their columns."""
    model = train(documents, labels)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(score_column(model, texts))

    return documents.where(score(F.col("text")) >= THRESHOLD)
