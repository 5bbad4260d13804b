"""Keyword, vector and hybrid retrieval as one DataFrame plan.

Chunks need ``chunk_id``, ``content`` and, for vectors, ``embedding``; ``source`` where
results are counted by source.  All orders end in chunk_id, so limits are determined.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tessaro.functions import text as tx
from tessaro.operators import hyperplanes

CANDIDATES, FINAL = 40, 16
#: Vector components of a shard of chunks and of a group of queries that meet in one task.
SHARD_NUMBERS, QUERY_NUMBERS = 2**20, 2**18


def question_keywords(question: str) -> list[str]:
    """The keywords of one question, as ``tx.keywords`` finds them in a column."""
    found = regex.findall(tx.WORD, question.lower())
    return [w for w in found if w not in tx.STOPWORDS][: tx.MAX_KEYWORDS]


def in_scope(chunks: DataFrame, column: str, ids: list | None) -> DataFrame:
    """Chunks of the given documents; an empty or missing list means all."""
    return chunks.where(F.col(column).isin(list(ids))) if ids else chunks


def keyword_search(chunks: DataFrame, question: str, k: int = CANDIDATES) -> DataFrame:
    """Up to 3 k chunks that hold a keyword: chunk_id, score; most keywords first."""
    words = question_keywords(question)
    if not words:
        return chunks.select("chunk_id", F.lit(0).alias("score")).limit(0)
    found = chunks.where(tx.keyword_candidate(F.col("content"), words)).select("chunk_id", tx.keyword_score(F.col("content"), words).alias("score"))
    return found.orderBy(F.desc("score"), "chunk_id").limit(3 * k)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in doubles; null where a vector is null, of another length or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), 1 - dot(a, b) / norm)


def semantic_search(chunks: DataFrame, query_vector: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The k nearest chunks: chunk_id, distance, by the whole distance.  query_vector: one row with the column query.

    One vector meets every row once; the top k come from each task's own k.
    """
    one = F.broadcast(query_vector.select("query").limit(1))
    near = chunks.where("embedding is not null").crossJoin(one).select("chunk_id", cosine_distance(F.col("embedding"), F.col("query")).alias("distance"))
    return near.where("distance is not null").orderBy("distance", "chunk_id").limit(k)


def first_wins(*lists: tuple[DataFrame, list[Column]]) -> DataFrame:
    """Ranked lists one after another, each chunk at its first place: chunk_id, position from 1.

    Lists are already cut to a bounded number of rows, which is why one window may hold them.
    """
    parts = []
    for leg, (rows, order) in enumerate(lists):
        place = F.row_number().over(Window.partitionBy(F.lit(leg)).orderBy(*order, "chunk_id"))
        parts.append(rows.select("chunk_id", F.lit(leg).alias("leg"), place.alias("place")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    first = union.groupBy("chunk_id").agg(F.min(F.struct("leg", "place")).alias("at"))
    return first.select("chunk_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at", "chunk_id")).alias("position"))


def hybrid_search(
    chunks: DataFrame,
    question: str,
    query_vector: DataFrame,
    k: int = CANDIDATES,
    top_n: int = FINAL,
    scorer: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Keyword hits, then nearest vectors, each chunk once, cut to top_n: chunk_id, position.

    scorer(candidates, question) may return (chunk_id, relevance) to order them by; its
    order counts only if there are more than top_n candidates.  It runs at once, over the
    candidates only.  Without one, or where it fails, be it at work, or leaves a candidate
    without a relevance, the order stays.
    """
    legs = [(keyword_search(chunks, question, k), [F.desc("score")]), (semantic_search(chunks, query_vector, k), [F.col("distance")])]
    ranked = first_wins(*legs)
    scores = _scores(scorer, ranked.join(chunks, "chunk_id"), question) if scorer is not None else None
    if scores is not None:
        # The candidates are few by construction: the two lists' limits.
        many = F.count("*").over(Window.partitionBy(F.lit(0))) > top_n
        ranked = ranked.join(scores.select("chunk_id", "relevance"), "chunk_id", "left").withColumn("relevance", F.when(many, F.col("relevance")))
        by = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("relevance"), "position")
        ranked = ranked.select("chunk_id", F.row_number().over(by).alias("position"))
    return ranked.where(F.col("position") <= top_n)


def _scores(scorer: Callable[[DataFrame, str], DataFrame], candidates: DataFrame, question: str) -> DataFrame | None:
    """The relevance of the candidates, of which there are never more than the lists' limits; None where it cannot be had."""
    try:
        found = {r["chunk_id"]: r["relevance"] for r in scorer(candidates, question).select("chunk_id", F.col("relevance").cast("double")).collect()}
    except Exception as e:  # a reranker is optional: search goes on without it
        warnings.warn(f"reranker left out: {e}", stacklevel=3)
        return None
    ids = [r["chunk_id"] for r in candidates.select("chunk_id").collect()]
    if any(found.get(i) is None or math.isnan(found[i]) for i in ids):
        warnings.warn("reranker left out: a candidate has no relevance", stacklevel=3)
        return None
    kind = candidates.schema["chunk_id"].dataType.simpleString()
    return candidates.sparkSession.createDataFrame([(i, found[i]) for i in ids], f"chunk_id {kind}, relevance double")


def results_per_source(results: DataFrame, chunks: DataFrame) -> DataFrame:
    return results.join(chunks.select("chunk_id", "source"), "chunk_id").groupBy("source").agg(F.count("*").alias("n_results"))


def lsh_search(chunks: DataFrame, queries: DataFrame, k: int = CANDIDATES, bits: int = 4, tables: int = 24) -> DataFrame:
    """Approximate nearest chunks of queries(query_id, query) by random hyperplanes: query_id, rank, chunk_id, distance.

    Only chunks that share a bucket of one table with the query are compared, each once.
    Every vector is in every table.  A plane's components are hashes of its number.  Few
    bits find most neighbours and meet most of the chunks, so pairs are no rows: shards of
    chunks meet groups of queries, and each query leaves k rows a shard.  Null ids and
    vectors, and vectors of another length, of zeros or with a null, take no part.
    """
    spark = chunks.sparkSession

    def held(rows: DataFrame, key: str, v: str, name: str) -> DataFrame:
        kept = rows.where(F.col(key).isNotNull() & F.col(v).isNotNull() & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull()))
        exact = dict(rows.dtypes)[v] in ("array<float>", "array<double>")
        return kept.select(key, (F.col(v) if exact else F.col(v).cast("array<double>")).alias(name))

    c, q = held(chunks, "chunk_id", "embedding", "v"), held(queries.dropDuplicates(["query_id"]), "query_id", "query", "q")
    numbers, longest = q.agg(F.sum(F.size("q")), F.max(F.size("q"))).first()
    cells, groups = (max(1, -(-(n or 0) // most)) for n, most in ((c.agg(F.sum(F.size("v"))).first()[0], SHARD_NUMBERS), (numbers, QUERY_NUMBERS)))
    parts = f"flatten(transform(sequence(1, {tables}), t -> transform(sequence(1, {bits}), b -> xxhash64(t, b, int(id)) / 9.3e18D)))"
    planes = np.array([r["p"] for r in spark.range(longest or 0).select("id", F.expr(parts).alias("p")).orderBy("id").collect()]).reshape(-1, tables * bits)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A chunk is copied once a group of queries, a query once a shard.
    c = c.withColumn("cell", F.pmod(F.xxhash64("chunk_id", "v"), F.lit(cells)).cast("int")).withColumn("group", every(groups))
    q = q.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("cell", every(cells))
    kind = StructType([StructField("query_id", q.schema["query_id"].dataType), StructField("chunk_id", c.schema["chunk_id"].dataType), StructField("distance", DoubleType())])
    best = hyperplanes.nearest(k, bits, planes, to_arrow_schema(kind))
    near = c.groupBy("group", "cell").cogroup(q.groupBy("group", "cell")).applyInArrow(best, kind).withColumn("distance", F.round("distance", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "distance")
