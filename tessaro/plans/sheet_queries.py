"""Cells in merged ranges, on sheets that are laid out from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaro.operators.intervals import in_rectangles
from tessaro.plans.catalog import query
from tessaro.session import table

#: A cell a line item, on a sheet a supplier and line number; a range a part, of up to 50 rows and 9 columns, on the sheets of the suppliers that sell it.
_CELLS = "SELECT DISTINCT l_suppkey % 40 AS book, l_linenumber AS sheet, l_orderkey % 1500 AS \"row\", l_partkey % 64 AS col FROM lineitem"
_RANGES = """SELECT p_partkey % 40 AS book, p_partkey % 7 + 1 AS sheet, p_partkey * 37 % 1500 AS "row", p_partkey % 61 AS col,
    p_partkey * 37 % 1500 + p_size AS row2, p_partkey % 61 + p_partkey % 9 AS col2 FROM part"""


def merged_cells(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("book"), F.col("l_linenumber").alias("sheet"), (F.col("l_orderkey") % 1500).alias("row"), (F.col("l_partkey") % 64).alias("col")).distinct()
    key = F.col("p_partkey")
    row, col = key * 37 % 1500, key % 61
    ranges = table(spark, sf_dir, "part").select((key % 40).alias("book"), (key % 7 + 1).alias("sheet"), row.alias("row"), col.alias("col"), (row + F.col("p_size")).alias("row2"), (col + key % 9).alias("col2"))
    return in_rectangles(cells, ranges, ["book", "sheet"])


@query(f"""WITH c AS ({_CELLS}), r AS ({_RANGES})
    SELECT c.book, c.sheet, count(*) AS n_held, count(*) FILTER (c."row" <> r."row" OR c.col <> r.col) AS n_secondary, sum(r.row2 - r."row" + 1)::BIGINT AS spanned
    FROM c JOIN r ON c.book = r.book AND c.sheet = r.sheet AND c."row" BETWEEN r."row" AND r.row2 AND c.col BETWEEN r.col AND r.col2 GROUP BY 1, 2""")
def cells_in_ranges(spark, sf_dir):
    """Per sheet: cells in ranges, those that are not a range's first, and the rows that their ranges span."""
    held = merged_cells(spark, sf_dir)
    other = (F.col("row") != F.col("_x")) | (F.col("col") != F.col("_y"))
    return held.groupBy("book", "sheet").agg(F.count("*").alias("n_held"), F.count_if(other).alias("n_secondary"), F.sum(F.col("_x2") - F.col("_x") + 1).alias("spanned"))
