"""K-d tree sharding: leaves of near equal bytes, cut at weighted medians of the metadata.

A node of m leaves is cut along its widest dimension so that floor(m / 2) / m of its
bytes go left.  A dimension's coordinates are whole numbers, the same in all nodes: the
ranks of distinct strings, or a number's place in its range.  All nodes of a level are cut
together: one aggregation finds their spreads, and the medians are found digit by digit
in histograms of bounded width, so the driver sees a few rows a node whatever the size of
the corpus.  Texts that are equal share their coordinates and stay together, unless the
copies alone are more than a shard: those are told apart by their ids.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaro.llm._work import join_on, join_small, ranks, running_before, settle, small_table

#: A code is a coordinate of PLACE_BITS, then a tie-break of TIE_BITS; its digits have DIGIT_BITS.
PLACE_BITS, TIE_BITS, DIGIT_BITS = 24, 24, 16
DIGITS = (PLACE_BITS + TIE_BITS) // DIGIT_BITS
#: Of the tie-break: copies that make up more of a shard come first, so that a cut meets small ones.
WEIGHT_BITS = 4
#: Rows of a shard that get their slots in one task; levels of the tree after which the nodes are written.
BLOCK_ROWS, LEVELS = 2_000, 6


@dataclass
class _Node:
    """A node's first shard and leaves, its cut, and what its digits have found so far."""

    node: int
    leaves: int
    dimension: int = 0
    prefix: int = 0
    below: int = 0
    goal: float = 0.0

    @property
    def right(self) -> int:
        return self.node + self.leaves // 2


_NODE = "node: int, leaves: int, dimension: int, prefix: bigint, below: bigint, goal: double, right: int"


def _coordinates(rows: DataFrame, dims: dict[str, str]) -> DataFrame:
    """rows with each dimension replaced by a whole number below 2**PLACE_BITS that keeps its order, null last."""
    for name, kind in dims.items():
        if kind == "string":
            placed = settle(ranks(rows, name))
            rows, value = join_small(rows, placed, [name]).withColumn(name, F.col("rank").cast("double")).drop("rank"), F.col(name)
        else:
            value = F.log2(F.col(name)) if name == "size" else F.col(name).cast("double")
        low, high = rows.agg(F.min(value), F.max(value)).first()
        width = float(high - low) if high is not None and high > low else 0.0
        steps = width if kind == "string" and width < 2**PLACE_BITS else float(2**PLACE_BITS - 1)
        place = F.floor((value - F.lit(float(low or 0.0))) * (steps / width if width else 0.0)).cast("int")
        rows = rows.withColumn(f"x_{name}", F.coalesce(place, F.lit(2**PLACE_BITS - 1)))
    return rows


def _with_nodes(points: DataFrame, nodes: list[_Node]) -> DataFrame:
    """points with the columns of their nodes: a table of at most as many rows as there are shards."""
    known = small_table(points.sparkSession, [asdict(n) | {"right": n.right} for n in nodes], _NODE)
    return points.join(F.broadcast(known), "node")


def _code(names: list[str]) -> Column:
    """Where a row stands in its node: its coordinate in the node's dimension, then its tie-break."""
    return F.shiftleft(F.element_at(F.array(*names), F.col("dimension") + 1).cast("long"), TIE_BITS) + F.col("tie")


def _cut_level(points: DataFrame, nodes: list[_Node], names: list[str], widths: list[float]) -> None:
    """Fills in each node's dimension and prefix (the last code that goes left)."""
    spread = points.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(x).alias(f"{f.__name__}_{x}") for x in names for f in (F.min, F.max)])
    seen = {r["node"]: r for r in spread.collect()}
    open_nodes = [n for n in nodes if n.leaves > 1 and n.node in seen]
    for n in open_nodes:
        r = seen[n.node]
        n.dimension = max(range(len(names)), key=lambda d: ((r[f"max_{names[d]}"] - r[f"min_{names[d]}"]) / (widths[d] or 1.0), -d))
        n.goal = r["bytes"] * (n.leaves // 2) / n.leaves
    if not open_nodes:
        return
    for digit in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - digit)
        coded = _with_nodes(points, open_nodes).withColumn("code", _code(names)).where(F.shiftright("code", shift + DIGIT_BITS) == F.col("prefix"))
        cells = coded.groupBy("node", F.shiftright("code", shift).alias("cell")).agg(F.sum("size").alias("bytes"), F.first(F.col("goal") - F.col("below")).alias("need"))
        run = F.sum("bytes").over(Window.partitionBy("node").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        # The first cell at which the goal is reached.
        reached = cells.withColumn("run", run).where(F.col("run") >= F.col("need"))
        hit = {r["node"]: r for r in reached.groupBy("node").agg(F.min(F.struct("cell", "run", "bytes")).alias("at")).select("node", "at.*").collect()}
        for n in open_nodes:
            if (r := hit.get(n.node)) is None:
                n.prefix <<= DIGIT_BITS
                continue
            n.prefix = r["cell"]
            before = r["run"] - r["bytes"]
            if digit == DIGITS - 1 and n.goal - n.below - before < r["run"] + n.below - n.goal:
                n.prefix -= 1  # without this cell the cut is nearer
            n.below += before


def tree_shards(docs: DataFrame, shards: int = 24, dims: tuple[str, ...] = ("source", "lang", "size")) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes (null: none) plus 8.  ``dims`` are columns of docs,
    or ``size``; a missing or null one orders last.  Copies of a text stay in one shard
    unless together they are more than a shard's bytes: then they are ordered by their
    ids, fill neighbouring shards and may share them with others.  Shards are as near
    equal as whole groups allow.  slot numbers a shard's rows from 0 without gaps.  Null
    ids and repeated rows are rows like others (rows equal in id and text always stay
    together); no rows give none.  Fewer texts than shards leave shards empty.
    """
    kinds = {d: "double" if d == "size" else dict(docs.dtypes).get(d, "string") for d in dims}
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        docs["doc_id"].alias("_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("_crc"),
        F.xxhash64(text).alias("_h"),
        *[(docs[d] if d in docs.columns else F.lit(None).cast("string")).alias(d) for d in dims if d != "size"],
    )
    rows = _coordinates(settle(rows), kinds)
    names = [f"x_{d}" for d in dims]
    rows = settle(rows.select("_id", "size", "_crc", "_h", *names))
    whole = rows.agg(F.sum("size"), *[F.max(x) - F.min(x) for x in names]).first()
    limit = (whole[0] or 0) / shards
    groups = rows.groupBy("_h", "_crc", "size").agg((F.count("*") * F.col("size")).alias("bytes"), *[F.min(x).alias(f"g{x}") for x in names])
    apart = F.col("bytes") > limit
    weight = F.when(apart, 2**WEIGHT_BITS - 1).otherwise(F.least(F.lit(2**WEIGHT_BITS - 1), F.floor(F.log2(F.lit(limit) / F.col("bytes")))))
    mixed = F.shiftrightunsigned(F.when(apart, F.xxhash64("_h", "_id")).otherwise(F.col("_h")), 64 - TIE_BITS + WEIGHT_BITS)
    tie = F.shiftleft(weight.cast("long"), TIE_BITS - WEIGHT_BITS) + mixed
    points = join_on(rows, groups, ["_h", "_crc", "size"])
    points = settle(points.select("_id", "size", "_crc", *[F.col(f"g{x}").alias(x) for x in names], tie.alias("tie")))

    nodes, placed, level = [_Node(0, shards)], points.withColumn("node", F.lit(0)), 0
    while any(n.leaves > 1 for n in nodes):
        _cut_level(placed, nodes, names, [float(v or 0.0) for v in whole[1:]])
        turn = F.when((F.col("leaves") > 1) & (_code(names) > F.col("prefix")), F.col("right")).otherwise(F.col("node"))
        placed = _with_nodes(placed, nodes).withColumn("node", turn).select(*points.columns, "node")
        nodes = [m for n in nodes for m in ([n] if n.leaves == 1 else [_Node(n.node, n.leaves // 2), _Node(n.right, n.leaves - n.leaves // 2)])]
        level += 1
        placed = settle(placed, over=placed) if level % LEVELS == 0 else placed
    placed = settle(placed.select("_id", "size", "_crc", "tie", F.col("node").alias("shard")))
    counts = settle(placed.groupBy("shard").agg(F.count("*").alias("rows")))
    dealt = join_small(placed, counts, ["shard"]).withColumn("one", F.lit(1)).withColumn("mix", F.xxhash64("_id", "tie"))
    dealt = dealt.withColumn("block", F.pmod("mix", F.ceil(F.col("rows") / BLOCK_ROWS)))
    order = [F.col("_id"), F.col("mix"), F.col("size")]
    out = running_before(dealt, ["shard"], "block", order, "one")
    return out.select(F.col("_id").alias("doc_id"), "size", F.col("_crc").alias("text_crc32"), "shard", F.col("before").cast("long").alias("slot"))
