"""Exact top-k search by tiled matrix products.

Candidates are packed into shards and queries into tiles, both of bounded size, as
binary integer matrices of the narrowest type.  Groups of tiles and groups of shards make
a grid; in each of its cells every (tile, shard) pair is one matrix product, of which
each query keeps its k best.  Lists meet in a tree: within a cell, within groups of
cells, then over the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaro.llm._work import settle

SCALE = 1024
#: Rows of a tile of queries and of a shard of candidates, fewer where vectors are longer than 64; how many of each a cell of the grid holds.
TILE_ROWS, SHARD_ROWS, CELL_TILES, CELL_SHARDS = 2048, 8192, 8, 16
#: Components beyond count as this bound: nothing overflows 64 bits.
LARGEST = 2.0**62
_PACKED = "dim int, kind string, ids binary, matrix binary"


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<bigint>) of floor(scale * x), at most LARGEST either way; vectors null, empty or with null or non-finite parts are left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    usable = vectors.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", fine))
    return usable.select("vec_id", F.transform("x", lambda e: F.floor(F.greatest(F.least(e * scale, F.lit(LARGEST)), F.lit(-LARGEST)))).alias("v"))


def _packer(rows: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for pdf in batches:
            for vec_id, v in zip(pdf["vec_id"], pdf["v"]):
                group = held.setdefault(len(v), [])
                group.append((vec_id, v))
                if len(group) * max(64, len(v)) >= rows * 64:
                    yield _packed(held.pop(len(v)))
        for group in held.values():
            yield _packed(group)

    return pack


def _packed(group: list) -> pd.DataFrame:
    ids = np.array([i for i, _ in group], dtype=np.int64)
    matrix = np.stack([np.asarray(v, dtype=np.int64) for _, v in group])
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= matrix.min() and matrix.max() <= np.iinfo(k).max)
    return pd.DataFrame({"dim": [matrix.shape[1]], "kind": [kind], "ids": [ids.tobytes()], "matrix": [matrix.astype(kind).tobytes()]})


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact q @ c.T: in doubles, 64-bit or unbounded integers, whichever no partial sum can leave; scores beyond 64 bits count as the last that fits."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q @ c.T
    scores = q.astype(object) @ c.astype(object).T
    return np.minimum(np.maximum(scores, -(2**63)), 2**63 - 1).astype(np.int64)


def _matrices(packed: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of each row, in order of ids: ties go to the smaller."""
    out = []
    for r in packed.select(["kind", "ids", "matrix"]).to_pylist():
        ids = np.frombuffer(r["ids"], np.int64)
        order = np.argsort(ids, kind="stable")
        out.append((ids[order], np.frombuffer(r["matrix"], r["kind"]).reshape(len(ids), -1)[order].astype(np.int64)))
    return out


def _near(scores: np.ndarray, k: int) -> np.ndarray:
    """The k highest, and whatever ties with the last of them until ids have been compared."""
    if len(scores) <= k:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])


_LISTS = pa.schema([("cell", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _best(k: int):
    def best(key: tuple, shards: pa.Table, tiles: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        candidates = _matrices(shards)
        for qid, q in _matrices(tiles) if candidates else ():
            for lo in range(0, len(qid), 256):  # scores of 256 queries at a time
                lists: list[list[tuple]] = [[] for _ in qid[lo : lo + 256]]
                for cid, c in candidates:
                    scores = _product(q[lo : lo + 256], c)
                    for i, own in enumerate(qid[lo : lo + 256]):
                        others = np.flatnonzero(cid != own)
                        near = others[_near(scores[i][others], k)]
                        lists[i].append((cid[near], scores[i][near]))
                for own, some in zip(qid[lo : lo + 256], lists):
                    cid, s = (np.concatenate(x) for x in zip(*some))
                    # ~s: descending, also for the least score of all.
                    first = np.lexsort((cid, ~s))[:k]
                    for column, values in zip(columns, (np.full(len(first), own), cid[first], s[first])):
                        column.append(values)
        made = [np.concatenate(c) for c in columns]
        return pa.Table.from_arrays([pa.array(np.full(len(made[0]), key[2].as_py())), *map(pa.array, made)], schema=_LISTS)

    return best


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, scale: int = SCALE, fan_in: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    Both sides need vec_id and embedding.  Rows with a null id, or whose vector is
    null, empty or holds a null or non-finite part, take no part.  Finite components
    whose multiple is beyond 2**62 either way count as that bound, and scores beyond 64
    bits as the last that fits.  A candidate of the query's own id is not a candidate;
    only vectors of its length are.  Ties go to the smaller id.  Repeated candidates
    count each time; of several queries of one id the least vector asks.  No queries or no candidates: no rows.
    """
    number = F.xxhash64(F.monotonically_increasing_id())
    tiles = settle(scaled(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v")).mapInPandas(_packer(TILE_ROWS), _PACKED).withColumn("at", number))
    shards = settle(scaled(candidates, scale).mapInPandas(_packer(SHARD_ROWS), _PACKED).withColumn("at", number))
    rows, cells = (max(1, -(-df.count() // most)) for df, most in ((tiles, CELL_TILES), (shards, CELL_SHARDS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A shard is copied once a group of tiles, a tile once a group of shards.
    q = tiles.withColumn("row", F.pmod("at", F.lit(rows)).cast("int")).withColumn("cell", every(cells))
    c = shards.withColumn("cell", F.pmod("at", F.lit(cells)).cast("int")).withColumn("row", every(rows))
    lists = c.groupBy("dim", "row", "cell").cogroup(q.groupBy("dim", "row", "cell")).applyInArrow(_best(k), "cell long, query_id long, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id")]
    some = Window.partitionBy("query_id", "branch").orderBy(*order)
    merged = lists.withColumn("branch", F.pmod("cell", F.lit(fan_in))).withColumn("r", F.row_number().over(some)).where(F.col("r") <= k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return merged.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
