"""Toxicity grades by cumulative-link ordinal regression.

A text has sparse features: the distinct words and word beginnings that it holds. With one weight
vector w for all thresholds, P(grade <= k) is sigmoid(t_k - w.x) for ordered thresholds t_0 < t_1 < ..;
the output is the expected grade. Weights are not negative - a word adds to severity or says nothing -
and an adaptive elastic net keeps them few: a feature pays the more for its weight the less it tells
toxic training texts from others by itself. So no lexicon of a fixed size is chosen; a feature that no
toxic training text holds has weight zero at the optimum, and only such features are left out.

The labels at hand are binary. Grade 0 are the texts labelled as not toxic; a toxic text's grade says
how much of it is toxic: the thirds of what its words weigh in a binary model that was fitted on the
other half of the labelled texts, so no text's own label takes part in its grade.

Scale: the model is fitted on the driver on at most MAX_TRAIN labelled rows, those with the smallest
hash of their id; all texts are then scored by a map without any exchange.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.shipping import ship

from .common import id_and_text, rows, slices, tidied

MAX_TRAIN = 6000
GRADES = 4
#: Weight of the penalty on the sum of the weights, for a feature whose shares among toxic and other texts differ by EVIDENCE
#: standard errors; it falls and grows with the power STEEP of that number. And of the penalty on half the sum of squares.
PENALTY, EVIDENCE, STEEP, RIDGE = 1.0, 4.0, 8, 0.5
_PREFIX = 5
_UNFOLDED = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\r\x0b\x0c.,!?;:\"'()[]{}<>*#$%&|/\\-_=+~`@^"
_FOLD = bytes.maketrans(_UNFOLDED, b"abcdefghijklmnopqrstuvwxyz" + b" " * (len(_UNFOLDED) - 26))


def text_words(text: bytes) -> set[bytes]:
    """The distinct words of the whole text, lower-cased and without punctuation."""
    return set(text.translate(_FOLD).split())


def text_features(text: bytes) -> set[bytes]:
    words = text_words(text)
    return words | {w[:_PREFIX] + b"*" for w in words if len(w) > _PREFIX}


class OrdinalModel:
    """Lexicon, one weight vector and ordered thresholds."""

    def __init__(self, lexicon: dict[bytes, float], thresholds: np.ndarray):
        self.words = {f: w for f, w in lexicon.items() if f[-1:] != b"*"}
        self.starts = {f[:-1]: w for f, w in lexicon.items() if f[-1:] == b"*"}
        self.thresholds = [float(t) for t in thresholds]
        self._words, self._starts = frozenset(self.words), frozenset(self.starts)

    def score(self, text: bytes) -> float:
        words = text_words(text)
        score = sum([self.words[w] for w in self._words & words])
        if self.starts:
            score += sum([self.starts[p] for p in {w[:_PREFIX] for w in words if len(w) > _PREFIX} & self._starts])
        return score

    def grades(self, text: bytes) -> list[float]:
        """P(grade = k) for each k."""
        score = self.score(text)
        below = [1 / (1 + math.exp(-max(-500.0, min(500.0, t - score)))) for t in self.thresholds] + [1.0]
        return [b - a for a, b in zip([0.0, *below], below)]


class Presence:
    """A sparse matrix of ones: which features each text holds."""

    def __init__(self, rows: list[np.ndarray], columns: int):
        self.shape = (len(rows), columns)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.concatenate(rows) if rows else np.empty(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, g[self.row], self.shape[1])


def fit_ordinal(
    x: Presence, y: np.ndarray, grades: int = GRADES, steps: int = 300, penalty: np.ndarray | float = 0.0, ridge: float = RIDGE, least: float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    """Weights of at least so much and ordered thresholds by penalised maximum likelihood: proximal steps, scaled by past gradients.

    Thresholds are a start and positive gaps.
    """
    n, d = x.shape
    theta = np.concatenate([np.zeros(d), [2.0], np.zeros(grades - 2)])
    past = np.full(len(theta), 1e-8)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    cost = np.concatenate([np.broadcast_to(penalty, d), np.zeros(grades - 1)])
    for _ in range(steps):
        w, gaps = theta[:d], np.exp(theta[d + 1 :])
        t = theta[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = x.dot(w)
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        high, low = sigmoid(edges[y + 1] - z), sigmoid(edges[y] - z)
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        by_threshold = np.array([dh[y == k].sum() - dl[y == k + 1].sum() for k in range(grades - 1)])
        gradient = np.concatenate([x.back(dl - dh), [by_threshold.sum()], [by_threshold[k + 1 :].sum() * gaps[k] for k in range(grades - 2)]])
        gradient[:d] -= ridge * w
        past += gradient**2
        rate = 0.5 / np.sqrt(past)
        moved = theta + rate * gradient
        theta = np.sign(moved) * np.maximum(0.0, np.abs(moved) - rate * cost)
        theta[:d] = np.maximum(least, theta[:d])
    return theta[:d], theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))])


def _features(texts: list[bytes], toxic: np.ndarray) -> tuple[list[bytes], Presence]:
    """The features of the toxic texts, and which of them each text holds. Texts are read twice rather than held as features."""
    chosen = sorted({f for t, y in zip(texts, toxic) if y for f in text_features(t)})
    column = {f: k for k, f in enumerate(chosen)}
    return chosen, Presence([np.array([column[f] for f in text_features(t) if f in column], np.int64) for t in texts], len(chosen))


def _penalties(x: Presence, y: np.ndarray) -> np.ndarray:
    """What each feature pays for its weight."""
    toxic = (y > 0).astype(float)
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    a, b = x.back(toxic), x.back(1 - toxic)
    pooled = (a + b) / (n1 + n0)
    errors = (a / n1 - b / n0) / np.sqrt(np.maximum(1e-12, pooled * (1 - pooled) * (1 / n1 + 1 / n0)))
    return np.minimum(1e6, PENALTY * (EVIDENCE / np.maximum(errors, 1e-3)) ** STEEP)


def _fitted(texts: list[bytes], y: np.ndarray, grades: int) -> OrdinalModel:
    names, x = _features(texts, y)
    w, thresholds = fit_ordinal(x, y, grades, penalty=_penalties(x, y))
    return OrdinalModel({f: float(v) for f, v in zip(names, w) if v}, thresholds)


def fit(texts: list[bytes], toxic: list[int]) -> OrdinalModel:
    """Grade the toxic texts by models of the other half of the texts, then fit the ordinal model. Without both kinds of labels nothing is toxic."""
    if not any(toxic) or all(toxic):
        return OrdinalModel({}, np.array([50.0 + k for k in range(GRADES - 1)]))
    half = np.array([zlib.crc32(t) & 1 for t in texts])
    y = np.array([int(bool(t)) for t in toxic])
    dose = np.zeros(len(texts))
    for k in (0, 1):
        other = np.flatnonzero(half != k)
        found = _fitted([texts[i] for i in other], y[other], 2)
        for i in np.flatnonzero((half == k) & (y > 0)):
            dose[i] = found.score(texts[i])
    of_toxic = np.sort(dose[y > 0])
    cuts = [of_toxic[min(len(of_toxic) - 1, len(of_toxic) * k // (GRADES - 1))] for k in range(1, GRADES - 1)]
    return _fitted(texts, np.where(y > 0, 1 + sum((dose >= c).astype(int) for c in cuts), 0), GRADES)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN) -> OrdinalModel:
    """Fit on at most max_rows rows of labels (id, toxic) that have a text; null labels are left out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), "toxic")
    picked = known.orderBy(F.xxhash64("id"), "id", "toxic").limit(max_rows)
    # At most max_rows ids: bounded by the parameter, so it may be sent to all tasks. Of rows that repeat an id one text counts.
    found = id_and_text(docs, id_col, text_col).join(F.broadcast(picked), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    got = sorted((r["id"], r["toxic"], bytes(r["text"])) for r in found.collect())
    return fit([t for _, _, t in got], [int(y) for _, y, _ in got])


def grade_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, expected_severity (0 to GRADES - 1), grade (the likeliest), p_toxic, toxic.

    Null and empty texts have no features and get the grades of such a text: not toxic. Repeated and
    null ids are returned as they come; an empty table gives an empty result.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches):
            p = [model.grades(t) for t in texts]
            expected = [sum(k * q for k, q in enumerate(g)) for g in p]
            arrays = [
                pa.array(ids, pa.int64()),
                pa.array(expected, pa.float64()),
                pa.array([max(range(GRADES), key=g.__getitem__) for g in p], pa.int32()),
                pa.array([1 - g[0] for g in p], pa.float64()),
                pa.array([g[0] < 0.5 for g in p], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "expected_severity", "grade", "p_toxic", "toxic"])

    scored = id_and_text(docs, id_col, text_col).mapInArrow(tidied(score), "id bigint, expected_severity double, grade int, p_toxic double, toxic boolean")
    return scored.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that the model does not reject; null texts stay, an empty table gives none. A map without any exchange."""
    at = docs.columns.index(text_col)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([t is None or model.grades(t)[0] >= 0.5 for t in texts], pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(tidied(select), docs.schema)
