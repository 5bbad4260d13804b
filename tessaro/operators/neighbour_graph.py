"""Approximate nearest chunks by navigable small-world graphs, one a shard.

Vectors are dealt into shards of bounded size by hash of their ids.  In a shard, rows are
put in one after another, each linked both ways with the nearest of those before it: early
rows get the long links that make a graph navigable, late ones the short.  No row keeps more
than DEGREE links.  A search walks every shard's graph from its first row, for a tile of
queries at once: the best rows found so far that were not looked at yet are opened, until
none of the best is left.  The shards' lists are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaro.sources.shared import new_folder, written

#: Rows of a shard and queries of a tile, about; links that a row makes, and keeps; rows compared at once while a shard is built.
SHARD_ROWS, TILE_ROWS, LINKS, DEGREE, BLOCK = 8_192, 1_024, 16, 48, 1_024
#: Rows found so far that a walk keeps, and how many of them it opens at a time.
BEAM, OPENED = 160, 4
_PACKED = "dim int, shard int, ids binary, matrix binary, links binary"


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of vectors with a direction: null ids, vectors that are null, of zeros, or have null, NaN or infinite parts are left out."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.transform(vector, lambda x: x.cast("double"))
    kept = rows.select(F.col(key).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.forall("v", fine))
    return kept.where(F.exists("v", lambda x: x != 0))


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy())
    m /= np.abs(m).max(axis=1, keepdims=True)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def linked(matrix: np.ndarray) -> np.ndarray:
    """(rows, DEGREE) links of unit vectors put in in order; -1 where there are fewer."""
    n = len(matrix)
    out = np.full((n, DEGREE), -1, dtype=np.int32)
    made: list[np.ndarray] = [np.empty(0, dtype=np.int64)]
    for at in range(0, n, BLOCK):
        near = matrix[at : at + BLOCK] @ matrix[: at + BLOCK].T
        own = np.arange(at, min(at + BLOCK, n))
        near[np.arange(near.shape[1])[None, :] >= own[:, None]] = -2.0  # only rows before it
        most = min(LINKS, near.shape[1])
        best = np.argpartition(-near, most - 1, axis=1)[:, :most]
        for i, b in zip(own, best):
            made.append(b[b < i]) if i else None
    target = np.concatenate(made)
    source = np.repeat(np.arange(1, n), [len(m) for m in made[1:]]) if n > 1 else np.empty(0, dtype=np.int64)
    for rows, others in ((source, target), (target, source)):
        # Each row's own links come first; of those made to it, the earliest half of the rest and the nearest other half.
        order = np.lexsort((others, rows))
        rows, others = rows[order], others[order]
        begins = np.searchsorted(rows, np.arange(n + 1))
        for i in np.flatnonzero(np.diff(begins)):
            mine = others[begins[i] : begins[i + 1]]
            used = int((out[i] >= 0).sum())
            room = DEGREE - used
            if len(mine) > room:
                early = mine[: room // 2]
                late = mine[room // 2 :]
                mine = np.r_[early, late[np.argsort(-(matrix[late] @ matrix[i]), kind="stable")[: room - len(early)]]]
            out[i, used : used + len(mine)] = mine
    return out


def walk(queries: np.ndarray, matrix: np.ndarray, links: np.ndarray, k: int) -> np.ndarray:
    """(queries, k) rows found nearest, the nearest first; -1 where a shard has fewer."""
    n, q = len(matrix), len(queries)
    beam = min(max(BEAM, 2 * k), n)
    found = np.full((q, beam), -1, dtype=np.int64)
    score = np.full((q, beam), -np.inf, dtype=np.float32)
    opened = np.ones((q, beam), dtype=bool)
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, n] = True  # where a link is missing
    found[:, 0], score[:, 0], opened[:, 0], seen[:, 0] = 0, queries @ matrix[0], False, True
    each = np.arange(q)[:, None]
    while True:
        live = np.flatnonzero((~opened).any(axis=1))
        if not len(live):
            break
        # The best OPENED rows of each query that were not opened yet.
        todo = np.where(opened[live], -np.inf, score[live])
        pick = np.argsort(-todo, axis=1, kind="stable")[:, :OPENED]
        valid = np.take_along_axis(todo, pick, 1) > -np.inf
        rows = each[: len(live)]
        opened[live[:, None], pick] = True
        at = np.where(valid, found[live[:, None], pick], -1)
        near = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(live), -1)
        near = np.where(near < 0, n, near)
        near.sort(axis=1)
        fresh = ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[live[:, None], near] = True
        far = np.full(near.shape, -np.inf, dtype=np.float32)
        i, j = np.nonzero(fresh)
        far[i, j] = np.einsum("ij,ij->i", queries[live[i]], matrix[near[i, j]])
        every = np.concatenate([score[live], far], axis=1)
        keep = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        found[live] = np.concatenate([found[live], near], axis=1)[rows, keep]
        opened[live] = np.concatenate([opened[live], ~fresh], axis=1)[rows, keep]
        score[live] = every[rows, keep]
        opened[live] |= np.isneginf(score[live])
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return np.where(np.isneginf(np.take_along_axis(score, order, 1)), -1, np.take_along_axis(found, order, 1))


def build(chunks: DataFrame, folder: str | None = None) -> DataFrame:
    """The written index of chunks (chunk_id, embedding), every usable vector in it: a row a shard."""
    rows = usable(chunks, "chunk_id", "embedding").withColumn("dim", F.size("v"))
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", key=lambda s: s * 0x5851F42D4C957F2D % 2**31)  # an order that tells nothing about the vectors
        matrix = _unit(pdf["v"])
        ids = pdf["id"].to_numpy(np.int64)
        return pd.DataFrame({"dim": [matrix.shape[1]], "shard": [pdf["shard"].iloc[0]], "ids": [ids.tobytes()], "matrix": [matrix.tobytes()], "links": [linked(matrix).tobytes()]})

    return written(dealt.groupBy("dim", "shard").applyInPandas(pack, _PACKED), folder or new_folder(chunks.sparkSession, "graph"))


def search(index: DataFrame, queries: DataFrame, k: int = 40) -> DataFrame:
    """query_id, rank, chunk_id, distance (1 - cosine) of about the k nearest chunks of queries(query_id, query).

    Queries meet vectors of their own length only; those without a direction have no rows.
    """
    asked = usable(queries, "query_id", "query").withColumn("dim", F.size("v"))
    tiles = max(1, -(-asked.count() // TILE_ROWS))
    asked = asked.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("tile")).agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    # Every tile meets every shard, as an equi join: shards are repeated once a tile.
    pairs = index.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).join(asked, ["dim", "tile"])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, matrix, links, dim, questions in zip(pdf["ids"], pdf["matrix"], pdf["links"], pdf["dim"], pdf["asked"]):
                ids = np.frombuffer(ids, np.int64)
                matrix = np.frombuffer(matrix, np.float32).reshape(len(ids), dim)
                units = _unit(pd.Series([x["v"] for x in questions]))
                rows = walk(units, matrix, np.frombuffer(links, np.int32).reshape(len(ids), DEGREE), min(k, len(ids)))
                i, j = np.nonzero(rows >= 0)
                at = rows[i, j]
                near = 1.0 - np.einsum("ij,ij->i", units[i].astype(np.float64), matrix[at].astype(np.float64))
                names = np.array([x["id"] for x in questions], dtype=np.int64)
                yield pd.DataFrame({"query_id": names[i], "chunk_id": ids[at], "distance": near})

    met = pairs.select("ids", "matrix", "links", "dim", "asked").mapInPandas(look, "query_id long, chunk_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"))
