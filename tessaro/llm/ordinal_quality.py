"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

P(grade >= j) = sigmoid(weights . terms - threshold_j): one set of hashed-text weights
for all grades, and thresholds kept in order as a first one and positive steps.  The
expected grade is the sum of the tail probabilities; one of them is what selects.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaro.llm.hashed_text import Rows, averaged_rounds, labelled_terms, score_texts, telling_cells

#: Bound of the labelled sample, and cells that get weights.
MAX_FIT_ROWS, CELLS = 16_000, 2048
ROUNDS, TASKS, BATCH, STEP, SHRINK = 14, 4, 64, 0.2, 1e-4


def thresholds(params: np.ndarray, cuts: int) -> np.ndarray:
    return params[0] + np.r_[0.0, np.cumsum(np.exp(params[1:cuts]))]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _epoch(cuts: int):
    def epoch(rows: Rows, params: np.ndarray, turn: int) -> np.ndarray:
        """One pass of AdaGrad on the ordinal log loss."""
        seen = np.full(len(params), 1e-2)
        rng = np.random.default_rng(turn)
        w = params[cuts:]
        for row, at, x, y in rows.batches(BATCH, rng):
            b = len(y)
            t = thresholds(params, cuts)
            tail = _sigmoid(np.bincount(row, w[at] * x, b)[:, None] - t)  # P(grade >= j), j = 1..cuts
            above = np.c_[np.ones(b), tail, np.zeros(b)]
            i = np.arange(b)
            p = np.maximum(above[i, y] - above[i, y + 1], 1e-9)
            slope = above * (1 - above)
            # d(-log p) / d(logit of each tail): through the tail below the grade and the one above it
            g = np.zeros((b, cuts))
            has = y > 0
            g[i[has], y[has] - 1] -= (slope[i, y] / p)[has]
            has = y < cuts
            g[i[has], y[has]] += (slope[i, y + 1] / p)[has]
            g /= b
            grad = np.zeros(len(params))
            np.add.at(grad[cuts:], at, g.sum(1)[row] * x)
            by_cut = -g.sum(0)
            grad[0] = by_cut.sum()
            for k in range(1, cuts):
                grad[k] = by_cut[k:].sum() * np.exp(params[k])
            grad[cuts:] += SHRINK * w
            seen += grad**2
            params -= STEP * grad / np.sqrt(seen)
        return params

    return epoch


def tails(params: np.ndarray, cuts: int, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(grade >= j) for j = 1 to cuts, of a text with values x at the positions at."""
    return _sigmoid(float(params[cuts:][at] @ x) - thresholds(params, cuts))


def grade_quality(docs: DataFrame, ratings: DataFrame, grades: int = 3, select_from: int = 1, min_tail: float = 0.5, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """Per row: doc_id, expected_grade (0 to grades - 1), tail_probability, kept.

    ratings: (doc_id, grade), grades 0 to ``grades`` - 1, others and nulls ignored; of
    several the lowest counts; at most ``max_fit_rows`` are learned from.
    tail_probability is that of a grade of at least ``select_from``; kept if it is at
    least ``min_tail``.  Null and empty texts have no terms and are not kept.  Null ids
    and repeated rows are graded like others; without ratings every text is graded alike.
    """
    cuts = grades - 1
    valid = F.col("grade").between(0, cuts)
    rows = labelled_terms(docs, ratings.where(valid).groupBy("doc_id").agg(F.min("grade").cast("int").alias("y")), max_fit_rows, TASKS)
    kept = telling_cells(rows, CELLS, range(1, grades))
    start = np.zeros(cuts + len(kept))
    start[0] = -1.0
    params = averaged_rounds(rows, kept, start, _epoch(cuts), ROUNDS)

    def score(at: np.ndarray, x: np.ndarray) -> tuple[float, ...]:
        if not len(at):
            return 0.0, 0.0
        tail = tails(params, cuts, at, x)
        return float(tail.sum()), float(tail[select_from - 1])

    scored = score_texts(docs, kept, score, "expected_grade double, tail_probability double")
    return scored.withColumn("kept", F.col("tail_probability") >= min_tail)


def ratings_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels(doc_id, quality, toxic): 0 poor, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2))
    return labels.select("doc_id", grade.alias("grade"))
