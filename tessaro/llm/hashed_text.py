"""Hashed terms of texts, bounded labelled samples, and training by averaged rounds.

A worker keeps one 64-bit number a word: its cell, its stem's cell, its shape and a part
of its hash.
Models are trained by Spark: the sample's rows are dealt into a few tasks, each task
runs an epoch from the current parameters, and the driver averages the parameters,
whose number is fixed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaro.llm._work import Remembered, settle

CELL_BITS = 18
#: Bytes of the beginning that words longer than it share as a term of their own: inflections of one stem.
STEM = 7
MEMO_WORDS = 400_000
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SHAPES = ("plain", "marked", "bare", "capitals", "shout", "digits", "address", "long")
_CELLS = 2**CELL_BITS


def _named(name: str) -> int:
    return xxhash.xxh3_64_intdigest(f"\0{name}".encode()) % _CELLS


SHAPE_CELLS = np.array([_named(s) for s in (*_SHAPES, "repeats", "variety")], np.int64)


def _shape(word: bytes, core: bytes) -> int:
    if not core:
        return 2
    if len(word) - len(core) >= 2 and word[-1] == word[-2]:
        return 4 if word[-1:] == b"!" else 1
    if len(core) > 1 and core.isupper():
        return 3
    if b"://" in core or core.startswith(b"www."):
        return 6
    if any(48 <= c <= 57 for c in core):
        return 5
    return 7 if len(core) > 40 else 0


def _packed(word: bytes) -> int:
    core = word.strip(_EDGES)
    shape, h = _shape(word, core), xxhash.xxh3_64_intdigest((core or word).lower())
    core = core.lower()
    stem = xxhash.xxh3_64_intdigest(b"\1" + core[:STEM]) if len(core) > STEM else h
    return (h % _CELLS) | (stem % _CELLS) << CELL_BITS | shape << 2 * CELL_BITS | (h >> 40) << 40


_words = Remembered(_packed, MEMO_WORDS)


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(cells, values) of a whole text: 1 for each word and stem it has, and the shares of its words by shape.

    Words are split at ASCII white space, stripped of ASCII punctuation and lower-cased.
    No words: no cells.
    """
    tokens = (text or "").encode("utf-8", "replace").split()
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    packed = np.fromiter(map(_words.__getitem__, tokens), np.uint64, len(tokens))
    low = np.uint64(_CELLS - 1)
    cells = np.unique(np.r_[packed & low, (packed >> np.uint64(CELL_BITS)) & low].astype(np.int64))
    n = len(packed)
    shapes = np.bincount(((packed >> np.uint64(2 * CELL_BITS)) & np.uint64(7)).astype(np.int64), minlength=len(_SHAPES)) / n
    repeats = np.count_nonzero(packed[1:] == packed[:-1]) / n
    shares = np.r_[shapes, repeats, len(cells) / n].astype(np.float32)
    return np.r_[cells, SHAPE_CELLS], np.r_[np.ones(len(cells), np.float32), shares]


def labelled_terms(docs: DataFrame, labels: DataFrame, max_rows: int, tasks: int) -> DataFrame:
    """(y, cells, values) of at most max_rows labelled documents, least by a hash of their id, in about ``tasks`` files.

    labels: (doc_id, y), one row an id; rows with nulls are ignored.  Of several documents
    of one id that with the least hash of its text is taken.
    """
    sample = labels.where("doc_id is not null and y is not null").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows)
    sample = settle(sample)  # at most max_rows rows: small enough to send to all
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("h", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t.as_py()) for t in batch.column(2)]
            cells = pa.array([c.astype(np.int32) for c, _ in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells, pa.array([v for _, v in found], pa.list_(pa.float32()))], ["h", "y", "cells", "values"])

    got = joined.mapInArrow(extract, "h long, y int, cells array<int>, values array<float>")
    return settle(got.repartition(tasks, F.pmod("h", F.lit(tasks))).sortWithinPartitions("h"))


def telling_cells(rows: DataFrame, most: int, cuts: Iterable[int] = (1,), min_rows: int = 5, min_z: float = 4.0) -> np.ndarray:
    """Sorted cells whose values go with y >= cut, for one of the cuts, by at least min_z standard deviations; shapes are always among them."""
    cuts = list(cuts)
    means = rows.agg(*[F.avg((F.col("y") >= c).cast("double")) for c in cuts]).first()
    cuts, means = zip(*[(c, m) for c, m in zip(cuts, means) if m is not None and 0 < m < 1]) if any(m and m < 1 for m in means) else ((), ())
    if not cuts:
        return np.sort(SHAPE_CELLS)
    pairs = rows.select("y", F.explode(F.arrays_zip("cells", "values")).alias("p"))
    x = F.col("p.values")
    sums = [F.sum(x * ((F.col("y") >= c).cast("double") - m)).alias(f"s{c}") for c, m in zip(cuts, means)]
    by = pairs.groupBy("p.cells").agg(F.count("*").alias("n"), F.sum(x**2).alias("q"), *sums)
    strength = F.array_max(F.array(*[F.abs(F.col(f"s{c}")) / (F.sqrt("q") * (m * (1 - m)) ** 0.5) for c, m in zip(cuts, means)]))
    top = by.where((F.col("n") >= min_rows) & (F.col("q") > 0) & (strength >= min_z)).orderBy(strength.desc(), "cells").limit(most).collect()
    return np.unique(np.r_[SHAPE_CELLS, [r["cells"] for r in top]].astype(np.int64))


def dense(cells: np.ndarray, values: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept cells of a text as positions in ``kept``, and their values."""
    at = np.searchsorted(kept, cells)
    at[at == len(kept)] = 0
    hit = kept[at] == cells
    return at[hit], values[hit]


class Rows:
    """Sparse rows of a task: positions, values and row starts."""

    def __init__(self, batches: Iterator[pa.RecordBatch], kept: np.ndarray):
        positions, values, ends, ys = [], [], [0], []
        for batch in batches:
            for y, c, v in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                p, x = dense(c.values.to_numpy().astype(np.int64), v.values.to_numpy(), kept)
                positions.append(p), values.append(x), ends.append(ends[-1] + len(p)), ys.append(y)
        self.positions = np.concatenate(positions) if positions else np.zeros(0, np.int64)
        self.values = np.concatenate(values) if values else np.zeros(0, np.float32)
        self.ends, self.y = np.array(ends), np.array(ys)

    def batches(self, size: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row within the batch, position, value, y) of shuffled batches."""
        order = rng.permutation(len(self.y))
        for lo in range(0, len(order), size):
            rows = order[lo : lo + size]
            spans = [np.arange(self.ends[r], self.ends[r + 1]) for r in rows]
            flat = np.concatenate(spans)
            yield np.repeat(np.arange(len(rows)), [len(s) for s in spans]), self.positions[flat], self.values[flat], self.y[rows]


def averaged_rounds(rows: DataFrame, kept: np.ndarray, start: np.ndarray, epoch: Callable[[Rows, np.ndarray, int], np.ndarray], rounds: int) -> np.ndarray:
    """Parameters after ``rounds`` rounds; in each, every task runs epoch() from the average of the last."""
    sc = rows.sparkSession.sparkContext
    kept_everywhere, params = sc.broadcast(kept), start
    for turn in range(rounds):
        sent = sc.broadcast(params)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            mine = Rows(batches, kept_everywhere.value)
            if len(mine.y):
                new = epoch(mine, sent.value.copy(), turn)
                yield pa.RecordBatch.from_arrays([pa.array([len(mine.y)], pa.int64()), pa.array([new.astype("<f8").tobytes()], pa.binary())], ["n", "params"])

        got = rows.select("y", "cells", "values").mapInArrow(run, "n long, params binary").collect()
        if not got:
            return params
        params = np.average([np.frombuffer(r["params"], "<f8") for r in got], axis=0, weights=[r["n"] for r in got])
        sent.unpersist()
    return params


def score_texts(docs: DataFrame, kept: np.ndarray, score: Callable[[np.ndarray, np.ndarray], tuple[float, ...]], columns: str) -> DataFrame:
    """(doc_id, columns): score(positions, values) of every whole text."""
    kept_everywhere = docs.sparkSession.sparkContext.broadcast(kept)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(*dense(*terms(t.as_py()), kept_everywhere.value)) for t in batch.column(1)]
            scores = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *scores], ["doc_id", *names])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, f"doc_id long, {columns}")
