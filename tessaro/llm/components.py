"""Connected components by alternating star contractions, in DataFrame operations.

Each round points every node at the least label around it, first through its
larger neighbours, then through its smaller ones (Kiveris et al., "Connected
Components in MapReduce and Beyond").  A node of very many edges is reduced by
partial minima before its shuffle, and the joins back are plain equi joins that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaro.llm._work import settle

def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge (src, dst): root is the least node reachable.

    Nulls and loops are ignored; repeated edges count once; no edges give no rows.
    """
    down = settle(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    state = None
    for _ in range(rounds):
        now = tuple(down.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now[0] == 0 or now == state:
            return down.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                down.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now
        down = settle(_small(_large(down)), over=down)  # rounds never add edges
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _large(down: DataFrame) -> DataFrame:
    """Every larger neighbour of u, and u, now point at the least node around u."""
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # A node without smaller neighbours is least around itself: its edges stay as they are.
    joined = down.join(least.select(F.col("u").alias("v"), "m"), "v", "left")
    return joined.select("u", F.coalesce("m", "v").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def _small(down: DataFrame) -> DataFrame:
    """The smaller neighbours of u, and u, now point at the least of them."""
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
