"""Quality scores by a factorisation machine."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import need
from .features import STRUCTURE, WORD_BITS, WordIds, collect_features, flat, hashed, labelled_sample, logistic, score_texts, structure

#: Labelled rows that the fit reads, about and at most.
SAMPLE = 8000
FACTORS, EPOCHS, STEP, DECAY = 8, 12, 0.05, 2e-4
WORDS = 1 << WORD_BITS


@dataclass(frozen=True)
class Machine:
    """bias + w.x + the pairwise products of x weighted by inner products of the rows of V."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, ids: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values: words share a length of 1, statistics are standardised."""
        x = np.concatenate((np.full(len(ids), 1 / np.sqrt(max(1, len(ids)))), np.clip((dense - self.mean) / self.scale, -4, 4)))
        return np.concatenate((ids, np.arange(WORDS, WORDS + len(dense)))), x

    def pairs(self, at: np.ndarray, x: np.ndarray) -> float:
        """The sum over i < j of <v_i, v_j> x_i x_j, in time linear in the features: half of (square of sum - sum of squares)."""
        vx = self.v[at] * x[:, None]
        return float(0.5 * (np.square(vx.sum(axis=0)) - np.square(vx).sum(axis=0)).sum())

    def score(self, ids: np.ndarray, dense: np.ndarray) -> float:
        at, x = self.inputs(ids, dense)
        return float(logistic(self.bias + self.w[at] @ x + self.pairs(at, x)))


def _word_ids() -> WordIds:
    return WordIds(lambda word: (hashed(word, WORD_BITS),))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 7) -> Machine:
    """Fits to about ``sample`` labelled rows at most. Without labels every score is one half.

    Null labels and texts, and labels without a row, teach nothing; an empty
    text is a text without words; rows that share an id all have its label (a
    null id has none). Texts of any length are read whole. Other columns are not
    read.
    """
    need(docs, id_col, text_col)
    need(labels, id_col, target)
    words = _word_ids()
    y, ids, dense, _ = collect_features(labelled_sample(docs, labels, target, sample, id_col, text_col), lambda t: (words.features(t), structure(t), []))
    size, rng = WORDS + len(STRUCTURE), np.random.default_rng(seed)
    if not len(y):
        return Machine(0.0, np.zeros(size), np.zeros((size, FACTORS)), np.zeros(len(STRUCTURE)), np.ones(len(STRUCTURE)))
    rate = np.clip(y.mean(), 0.01, 0.99)
    m = Machine(float(np.log(rate / (1 - rate))), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), dense.mean(axis=0), dense.std(axis=0) + 1e-6)
    rows = [m.inputs(i, d) for i, d in zip(ids, dense, strict=True)]
    bias, seen_w, seen_v = m.bias, np.full(size, 1e-3), np.full((size, FACTORS), 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(order) // 64)):
            at, row = flat([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            vx = m.v[at] * x[:, None]
            total = np.stack([np.bincount(row, vx[:, f], len(part)) for f in range(FACTORS)], axis=1)
            z = bias + np.bincount(row, m.w[at] * x, len(part))
            z += 0.5 * (np.square(total).sum(axis=1) - np.bincount(row, np.square(vx).sum(axis=1), len(part)))
            error = (logistic(z) - y[part]) / len(part)
            bias -= STEP * error.sum()
            used, back = np.unique(at, return_inverse=True)
            gw = np.bincount(back, error[row] * x, len(used)) + DECAY * m.w[used]
            each = (error[row] * x)[:, None] * (total[row] - vx)
            gv = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(FACTORS)], axis=1) + DECAY * m.v[used]
            seen_w[used] += np.square(gw)
            seen_v[used] += np.square(gv)
            m.w[used] -= STEP * gw / np.sqrt(seen_w[used])
            m.v[used] -= STEP * gv / np.sqrt(seen_v[used])
    return Machine(float(bias), m.w, m.v, m.mean, m.scale)


def score(docs: DataFrame, machine: Machine, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Whole texts of any length; null and empty ones get the score of a text
    without words. Null ids and repeated rows are rows like any other; an empty
    table gives no rows. Columns of these names are replaced, others passed
    through.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(machine)

    def scorer():
        m, words = shipped.value, _word_ids()
        return lambda text: m.score(words.features(text), structure(text or ""))

    return score_texts(docs, scorer, threshold, text_col, keep)
