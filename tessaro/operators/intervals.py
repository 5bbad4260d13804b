"""Points in rectangles, such as cells in merged ranges, as an equi join over a grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a square of the grid.
SIDE = 32


def in_rectangles(points: DataFrame, rectangles: DataFrame, keys: list[str], x: str = "row", y: str = "col", side: int = SIDE) -> DataFrame:
    """points with every rectangle of their keys that they lie in: points' columns, then ``_x``, ``_y``, ``_x2``, ``_y2``.

    rectangles: keys, x, y, and the last x and y, named with a 2; both ends belong to it.
    A rectangle is repeated once a square of the grid that it touches and a point lies in
    one square, so each pair meets once, in a join on keys and square.  Rectangles with a
    null or with ends before their beginnings hold nothing, nor do null keys.
    """
    grid = lambda c: F.floor(F.col(c) / side)
    whole = rectangles.where((F.col(f"{x}2") >= F.col(x)) & (F.col(f"{y}2") >= F.col(y)))
    ends = [F.col(c).alias(f"_{n}") for c, n in ((x, "x"), (y, "y"), (f"{x}2", "x2"), (f"{y}2", "y2"))]
    span = lambda a, b: F.explode(F.sequence(grid(a), grid(b)))
    laid = whole.select(*[F.col(k).alias(f"_{k}") for k in keys], *ends).withColumn("_gx", span("_x", "_x2")).withColumn("_gy", span("_y", "_y2"))
    placed = points.withColumn("_px", grid(x)).withColumn("_py", grid(y))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys], (F.col("_px") == F.col("_gx")) & (F.col("_py") == F.col("_gy")))
    met = placed.join(laid, same).where(F.col(x).between(F.col("_x"), F.col("_x2")) & F.col(y).between(F.col("_y"), F.col("_y2")))
    return met.select(*points.columns, "_x", "_y", "_x2", "_y2")
