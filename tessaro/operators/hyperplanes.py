"""Random hyperplanes in NumPy: the buckets of many vectors, and the nearest of those that share one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries that are compared with a shard at a time.
BLOCK = 128


def _matrix(column: pa.ChunkedArray, length: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in column.chunks] or [np.zeros(0)]).reshape(-1, length)


def buckets(vectors: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """Each vector's bucket in each table.  planes: a row a component, bits columns a table.

    Components are added one after another, so that equal vectors have equal buckets
    whatever stands beside them.  What is no number counts as above a plane.
    """
    sums = np.zeros((len(vectors), planes.shape[1]))
    for i in range(vectors.shape[1]):
        sums += vectors[:, i, None] * planes[i]
    sides = ~(sums <= 0)
    powers = (1 << np.arange(bits)[::-1]).astype(np.int64)
    return (sides.reshape(len(vectors), -1, bits) @ powers).astype(np.min_scalar_type(2**bits - 1))


def _cosine_distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    size = lambda v: np.sqrt((v * v).sum(axis=1))
    return 1 - (q @ c.T) / np.outer(size(q), size(c))


def _first(distances: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least of rounded distances; ties go to the earlier place, and what is no number comes last."""
    some = np.arange(len(distances))
    if len(distances) > k:
        last = np.partition(distances, k - 1)[k - 1]
        some = some if np.isnan(last) else np.flatnonzero(distances <= last)
    return some[np.argsort(distances[some], kind="stable")[:k]]


def nearest(k: int, bits: int, planes: np.ndarray, schema: pa.Schema) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """A function of cogrouped chunks (chunk_id, v) and queries (query_id, q): each query's k nearest of the chunks that share a bucket with it."""

    def best(key: tuple, chunks: pa.Table, queries: pa.Table) -> pa.Table:
        out = [schema.empty_table()]
        chunks = chunks.sort_by("chunk_id")  # ties go to the smaller id
        sizes, asked_sizes = pc.list_value_length(chunks["v"]), pc.list_value_length(queries["q"])
        for length in pc.unique(asked_sizes).to_pylist():
            same, asked = chunks.filter(pc.equal(sizes, length)), queries.filter(pc.equal(asked_sizes, length))
            if not len(same) or not length:
                continue
            c, q = _matrix(same["v"], length), _matrix(asked["q"], length)
            held, wanted = buckets(c, planes[:length], bits).T.copy(), buckets(q, planes[:length], bits)
            for lo in range(0, len(q), BLOCK):
                met = np.zeros((len(q[lo : lo + BLOCK]), len(c)), dtype=bool)
                for t, codes in enumerate(held):
                    met |= wanted[lo : lo + BLOCK, t, None] == codes
                with np.errstate(all="ignore"):
                    distances = _cosine_distances(q[lo : lo + BLOCK], c)
                    rounded = np.round(distances, 6)
                asked_at, found_at = [], []
                for i, here in enumerate(met):
                    those = np.flatnonzero(here)
                    near = those[_first(rounded[i, those], k)]
                    asked_at.append(np.full(len(near), lo + i))
                    found_at.append(near)
                a, f = np.concatenate(asked_at), np.concatenate(found_at)
                columns = [asked["query_id"].take(pa.array(a)), same["chunk_id"].take(pa.array(f)), pa.array(distances[a - lo, f])]
                out.append(pa.table(dict(zip(schema.names, columns))).cast(schema))
        return pa.concat_tables(out)

    return best
