"""Toxicity: a factorization machine over hashed terms.

logit = bias + sum of weights + sum over pairs of terms of the inner product of their
factors: a pair such as an insult and a group's name can weigh more, or less, than its
terms do alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaro.llm.hashed_text import Rows, averaged_rounds, labelled_terms, score_texts, telling_cells

#: Bound of the labelled sample, cells that get parameters, factors a cell.
MAX_FIT_ROWS, CELLS, FACTORS = 16_000, 2048, 4
ROUNDS, TASKS, BATCH, STEP, SHRINK = 10, 4, 64, 0.15, 1e-4


def _split(params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, factors): a row a cell; the bias is the first parameter."""
    m = (len(params) - 1) // (1 + FACTORS)
    return params[1 : 1 + m], params[1 + m :].reshape(m, FACTORS)


def _epoch(rows: Rows, params: np.ndarray, turn: int) -> np.ndarray:
    """One pass of AdaGrad on the log loss."""
    seen = np.full(len(params), 1e-2)
    rng = np.random.default_rng(turn)
    w, v = _split(params)
    m = len(w)
    for row, at, x, y in rows.batches(BATCH, rng):
        b = len(y)
        vx = v[at] * x[:, None]
        total = np.zeros((b, FACTORS))
        np.add.at(total, row, vx)
        square = np.zeros(b)
        np.add.at(square, row, (vx**2).sum(1))
        logit = params[0] + np.bincount(row, w[at] * x, b) + 0.5 * ((total**2).sum(1) - square)
        err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / b
        grad = np.zeros(len(params))
        grad[0] = err.sum()
        np.add.at(grad[1 : 1 + m], at, err[row] * x)
        np.add.at(grad[1 + m :].reshape(m, FACTORS), at, (err[row] * x)[:, None] * (total[row] - vx))
        grad[1:] += SHRINK * params[1:]
        seen += grad**2
        params -= STEP * grad / np.sqrt(seen)
    return params


def logit(params: np.ndarray, at: np.ndarray, x: np.ndarray) -> float:
    """Of a text with values x at the positions at: pairs in linear time, as half of (square of sums - sum of squares)."""
    w, v = _split(params)
    vx = v[at] * x[:, None]
    return float(params[0]) + float(w[at] @ x) + 0.5 * float((vx.sum(0) ** 2).sum() - (vx**2).sum())


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Learns from at most ``max_fit_rows`` rows of labels(doc_id, toxic), none held out;
    two labels of one id count as toxic if one is; null labels don't count.  The score is that of the
    whole text alone; null and empty texts get the score of the bias.  A null doc_id is
    not held out and never learned from.  Repeated rows are scored alike; without labels
    all score the same.  Only doc_id and text are read.
    """
    known = labels.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    rows = labelled_terms(docs, known, max_fit_rows, TASKS)
    kept = telling_cells(rows, CELLS)
    start = np.random.default_rng(0).normal(0, 0.05, 1 + len(kept) * (1 + FACTORS))
    start[: 1 + len(kept)] = 0
    params = averaged_rounds(rows, kept, start, _epoch, ROUNDS)

    def score(at: np.ndarray, x: np.ndarray) -> tuple[float, ...]:
        return (float(1 / (1 + np.exp(-np.clip(logit(params, at, x), -30, 30)))),)

    scored = score_texts(docs, kept, score, "score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
