"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words in lower case and their beginnings of 4, 5
and 6 letters (so that an insult's stem counts under any ending), hashed by crc32
into 2**20 buckets. The score is the logistic of

    w0 + sum_i w_i + sum_{i<j} <v_i, v_j>

over the buckets present: the pair term is what an additive model lacks, and lets
an insult weigh more beside a group's name than alone. An L1 step keeps buckets
that say nothing at exactly zero, so long clean texts gather no noise.

Fitting takes the buckets of a bounded sample to the driver; scoring runs in batches on the
executors over every word of every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.labels import fold, labelled_documents
from tessella.llm.scratch import Scratch
from tessella.llm.textkit import slices

BUCKETS, RANK = 1 << 20, 4
STEMS, STEM = (4, 5, 6), 5
SAMPLE_TERMS = 8_000_000
TOXIC_WEIGHT = 2.0
FOLDS, HELD, THRESHOLD = 3, 1, 0.7
MIN_Z, PAIR_Z = 2.5, 5.0
PULL = 1e-3
_WORD = re.compile(r"[^\W\d_]+")
_MEMO_ENTRIES = 200_000


def buckets_of(word: str) -> list[int]:
    """Buckets of a word in lower case: itself and its beginnings."""
    terms = [f"w:{word}", *(f"s{n}:{word[:n]}" for n in STEMS if len(word) >= n)]
    return [zlib.crc32(t.encode()) % BUCKETS for t in terms]


@dataclass
class Model:
    constant: float
    rows: dict[int, int]  # bucket to row
    weights: np.ndarray
    factors: np.ndarray


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _z(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log odds ratios of presence between the labels, in standard errors."""
    pos, neg = pos + 0.5, neg + 0.5
    rest_pos, rest_neg = n_pos + 1 - pos, n_neg + 1 - neg
    return (np.log(pos / rest_pos) - np.log(neg / rest_neg)) / np.sqrt(1 / pos + 1 / rest_pos + 1 / neg + 1 / rest_neg)


def _gap(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Differences of shares of presence between the labels, in standard errors."""
    share = (pos + neg + 1) / (n_pos + n_neg + 2)
    return np.abs(pos / n_pos - neg / n_neg) / np.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_neg))


def _contrast(cells: list[np.ndarray]) -> np.ndarray:
    """Log odds of presence of both, and of neither, less those of one alone, in standard errors; cells are pos and neg of each."""
    log = [np.log(c + 0.5) for c in cells]
    sign = (1, -1, -1, 1, -1, 1, 1, -1)
    return np.abs(sum(s * x for s, x in zip(sign, log, strict=True))) / np.sqrt(sum(1 / (c + 0.5) for c in cells))


def _pairs(docs: list[np.ndarray], y: np.ndarray, n_terms: int) -> np.ndarray:
    """Of terms numbered below n_terms, those that tell beside another where neither does alone.

    Both of a pair are taken if the pair's presence is PAIR_Z standard errors
    further from nothing than the two together, or if it shifts the odds by as
    much against one of them alone. Only terms and pairs in so few texts that
    their presence could not reach PAIR_Z stay out, however frequent or rare.
    """
    n_pos, n_neg = int((y == 1).sum()), int((y == 0).sum())
    pos, neg = (np.bincount(np.concatenate([d for d, v in zip(docs, y, strict=True) if v == k]), minlength=n_terms) for k in (1, 0))
    # At best all texts with a term are of one label, and the pair is in them.
    k = np.arange(max(n_pos, n_neg) + 1)
    best = np.maximum(_gap(np.minimum(k, n_pos), 0 * k, n_pos, n_neg), _gap(0 * k, np.minimum(k, n_neg), n_pos, n_neg))
    few = (np.flatnonzero(best >= PAIR_Z).tolist() or [len(docs) + 1])[0]
    often = np.flatnonzero(pos + neg >= few)
    # Rare ones first, so that frequent ones have little left to be counted with.
    often = often[np.argsort((pos + neg)[often], kind="stable")]
    rank = np.full(n_terms, -1)
    rank[often] = np.arange(len(often))
    ranked = [np.sort(rank[d][rank[d] >= 0]).astype(np.int32) for d in docs]
    cols = np.concatenate(ranked)
    order = np.argsort(cols, kind="stable")
    starts = np.searchsorted(cols[order], np.arange(len(often) + 1))
    rows = np.repeat(np.arange(len(ranked), dtype=np.int32), [len(r) for r in ranked])[order]
    after = np.concatenate([np.arange(1, len(r) + 1, dtype=np.int32) for r in ranked])[order]
    pos, neg = pos[often], neg[often]
    single = _gap(pos, neg, n_pos, n_neg)
    taken = np.zeros(n_terms, bool)
    for a in range(len(often)):
        rest = ([], [])
        here = slice(starts[a], starts[a + 1])
        for row, n in zip(rows[here].tolist(), after[here].tolist(), strict=True):
            rest[int(y[row] == 0)].append(ranked[row][n:])
        both = [np.bincount(np.concatenate(r) - a, minlength=len(often) - a) if r else np.zeros(len(often) - a, np.int64) for r in rest]
        at_least = np.flatnonzero(both[0] + both[1] >= few)
        b = at_least + a
        both = [m[at_least] for m in both]
        far = _gap(*both, n_pos, n_neg) - single[a] - single[b]
        cells = [[m, c[a] - m, c[b] - m, n - c[a] - c[b] + m] for m, c, n in zip(both, (pos, neg), (n_pos, n_neg), strict=True)]
        tells = (far >= PAIR_Z) | (_contrast([x for pair in zip(*cells, strict=True) for x in pair]) >= PAIR_Z)
        if tells.any():
            taken[often[b[tells]]] = taken[often[a]] = True
    return np.flatnonzero(taken)


def _telling(docs: list[np.ndarray], words: list[np.ndarray], stems: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets that tell: by themselves, MIN_Z standard errors from nothing, or in a pair of words or of stems."""
    seen = np.unique(np.concatenate(docs))
    n_pos, n_neg = int((y == 1).sum()), int((y == 0).sum())
    pos, neg = (np.bincount(np.searchsorted(seen, np.concatenate([d for d, v in zip(docs, y, strict=True) if v == k])), minlength=len(seen)) for k in (1, 0))
    taken = [seen[np.abs(_z(pos, neg, n_pos, n_neg)) >= MIN_Z]]
    for terms in (words, stems):
        own = np.unique(np.concatenate(terms))
        if len(own):
            taken.append(own[_pairs([np.searchsorted(own, t) for t in terms], y, len(own))])
    return np.unique(np.concatenate(taken))


def terms_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct buckets of a text: of all terms, of its words alone, and of their stems of STEM letters."""
    own = [buckets_of(w) for w in words_of(text)]
    middle = 1 + STEMS.index(STEM)
    parts = ([b for x in own for b in x], [x[0] for x in own], [x[middle] for x in own if len(x) > middle])
    return tuple(np.unique(np.array(p, np.int32)) for p in parts)


def fit(terms: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 15, batch: int = 64, l1: float = 1e-3, seed: int = 9) -> Model:
    """Proximal Adam on the logistic loss of texts known by ``terms_of``; toxic ones weigh TOXIC_WEIGHT times the others together. Without both labels, a constant."""
    if len(set(y.tolist())) < 2:
        return Model({1: 4.0}.get(int(y[0]) if len(y) else 0, -4.0), {}, np.zeros(0), np.zeros((0, RANK)))
    docs, words, stems = (list(x) for x in zip(*terms, strict=True))
    seen = _telling(docs, words, stems, y)
    docs = [np.searchsorted(seen, d[np.isin(d, seen, assume_unique=True)]) for d in docs]
    share = (y == 1).mean()
    weight = np.where(y == 1, TOXIC_WEIGHT / share, 1 / (1 - share)) / (1 + TOXIC_WEIGHT)
    rng = np.random.default_rng(seed)
    w, v, c = np.zeros(len(seen)), rng.normal(0, 0.1, (len(seen), RANK)), np.zeros(1)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, v, c)]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            pick = order[lo : lo + batch]
            own = [docs[i] for i in pick]
            at, of = np.concatenate(own), np.repeat(np.arange(len(pick)), [len(d) for d in own])
            sums = np.stack([np.bincount(of, v[at, f], len(pick)) for f in range(RANK)], axis=1)
            squares = np.bincount(of, (v[at] ** 2).sum(axis=1), len(pick))
            logit = c[0] + np.bincount(of, w[at], len(pick)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            g = weight[pick] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[pick]) / len(pick)
            pull = g[of][:, None] * (sums[of] - v[at])
            grads = [np.bincount(at, g[of], len(w)), np.stack([np.bincount(at, pull[:, f], len(w)) for f in range(RANK)], axis=1), g.sum(keepdims=True)]
            t += 1
            for value, grad, (m, s), shrink in zip((w, v, c), grads, state, (l1, 0.0, 0.0), strict=True):
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                rate = 0.02 / (np.sqrt(s / (1 - 0.999**t)) + 1e-3)
                value -= rate * m / (1 - 0.9**t)
                # Steps towards zero: in proportion to the step size for weights, by a fixed amount for factors.
                pull_in = rate * shrink if value is w else PULL if value is v else 0.0
                np.copyto(value, np.sign(value) * np.maximum(np.abs(value) - pull_in, 0))
    live = np.flatnonzero((w != 0) | (v != 0).any(axis=1))
    return Model(float(c[0]), {int(b): k for k, b in enumerate(seen[live])}, w[live], v[live])


class Scorer:
    """Scores texts; a bounded memory of words saves hashing."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def __call__(self, text: str | None) -> float:
        m, memo, rows = self.model, self.memo, set()
        for word in words_of(text):
            found = memo.get(word)
            if found is None:
                if len(memo) >= _MEMO_ENTRIES:
                    memo.clear()
                found = memo[word] = tuple(m.rows[b] for b in buckets_of(word) if b in m.rows)
            if found:
                rows.update(found)
        at = np.fromiter(sorted(rows), np.int64, len(rows))
        v = m.factors[at]
        logit = m.constant + m.weights[at].sum() + 0.5 * float((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def score_with(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row, from the whole text; null and empty texts have no terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = [terms_of(t) for t in b.column(1).to_pylist()]
        cols = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in range(3)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], names=["doc_id", "y", "all", "words", "stems"])


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE_TERMS) -> Model:
    """A model from labelled rows outside the held-out fold.

    The executors turn whole texts into buckets. Of the bounded sample
    (``labels.PER_CLASS`` rows a label) rows come to the driver, in the order of a
    hash, as long as each label's have ``most`` buckets together at most.
    """
    open_rows = labels.where(fold(F.col("doc_id"), FOLDS) != HELD)
    rows = labelled_documents(documents, open_rows, "toxic").select("doc_id", "text", "y")
    found = rows.mapInArrow(_terms, "doc_id long, y int, all array<int>, words array<int>, stems array<int>")
    # Of several texts of one id, one counts.
    found = found.groupBy("doc_id").agg(F.min(F.struct("y", "all", "words", "stems")).alias("r")).select("doc_id", "r.*")
    found = Scratch(documents.sparkSession, "toxic").keep(found, "sample")
    # At most 2 * PER_CLASS rows: a window of one task.
    upto = Window.partitionBy("y").orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id")
    kept = found.select("doc_id", (F.sum(F.size("all") + F.size("words") + F.size("stems")).over(upto) <= most).alias("in")).where("in").select("doc_id")
    sample = found.join(F.broadcast(kept), "doc_id").orderBy("doc_id").toArrow()
    terms = [tuple(x.values.to_numpy() for x in own) for own in zip(*(sample.column(c) for c in ("all", "words", "stems")), strict=True)]
    return fit(terms, sample.column("y").to_numpy())


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents``.

    Rows with a null id are scored and not held out. Repeated rows are scored
    each. Without any usable label all scores are alike and low. Other columns
    are not read.
    """
    scored = score_with(documents, train(documents, labels))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
