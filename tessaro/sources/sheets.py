"""Workbooks: headers, totals, row texts, statistics and formulas from cell facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaro.functions import cells as fx
from tessaro.operators.context import ordered_concat
from tessaro.operators.intervals import in_rectangles

KEY = ["path", "sheet"]
FORMULAS, CROSS_SHEET = 200, 50


def cells(facts: DataFrame) -> DataFrame:
    """(path, sheet, row, col, kind, bold, filled, format, formula, text, number, shown) of every cell with something in it."""
    if (made := getattr(facts, "cells_of_these", None)) is not None:
        return made  # the expression is large: it is built once for all that use the same facts
    f = F.split("flags", "\t")
    found = facts.where("kind = 'cell'").select(
        "path", F.col("part").alias("sheet"), F.col("a").alias("row"), F.col("b").alias("col"), f[0].alias("kind"), (f[1] == "b").alias("bold"),
        (f[2] == "f").alias("filled"), f[3].alias("format"), F.col("name").alias("formula"), "text", "number",
    )
    facts.cells_of_these = found.withColumn("shown", fx.cell_text(F.col("kind"), F.col("text"), F.col("number"), F.col("format"), F.col("formula")))
    return facts.cells_of_these


def header_rows(cell: DataFrame) -> DataFrame:
    """(path, sheet, row) of the header: rows 1 to 10 scored by share of bold (3), filled (2) and text cells (2 or 1), the first row 1 more.

    Rows of at least 3 and of 60 % of the best score are headers; if none is, the first
    row is where it has 1.5.
    """
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    rows = cell.where("row between 1 and 10").groupBy(*KEY, "row").agg(share(F.col("bold")).alias("b"), share(F.col("filled")).alias("f"), share(F.col("kind") == "s").alias("s"))
    score = (
        F.when(F.col("b") >= 0.5, 3).otherwise(0) + F.when(F.col("f") >= 0.3, 2).otherwise(0)
        + F.when(F.col("s") >= 0.7, 2).when(F.col("s") >= 0.5, 1).otherwise(0) + F.when(F.col("row") == 1, 1).otherwise(0)
    )
    w = Window.partitionBy(*KEY)
    scored = rows.withColumn("score", score).withColumn("best", F.max("score").over(w))
    strong = F.col("score") >= F.greatest(F.lit(3.0), 0.6 * F.col("best"))
    marked = scored.withColumn("strong", strong).withColumn("any", F.bool_or("strong").over(w))
    return marked.where("strong or (not any and row = 1 and score >= 1.5)").select(*KEY, "row")


def headers(cell: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, sheet, col, header): several header rows joined by slashes."""
    inside = cell.join(rows, [*KEY, "row"]).where("shown is not null")
    return inside.groupBy(*KEY, "col").agg(ordered_concat(F.col("shown"), F.col("row"), " / ").alias("header"))


def totals_rows(cell: DataFrame) -> DataFrame:
    """(path, sheet, row) of rows called totals: within the last five rows, in the first five columns."""
    last = cell.withColumn("last", F.max("row").over(Window.partitionBy(*KEY)))
    return last.where((F.col("row") > F.col("last") - 5) & (F.col("col") <= 5) & fx.is_totals(F.col("text"))).select(*KEY, "row").distinct()


def merged(facts: DataFrame) -> DataFrame:
    """(path, sheet, row, col, row2, col2) of merged ranges; the first cell holds the value."""
    end = F.split("flags", "\t")
    return facts.where("kind = 'merge'").select("path", F.col("part").alias("sheet"), F.col("a").alias("row"), F.col("b").alias("col"), end[0].cast("int").alias("row2"), end[1].cast("int").alias("col2"))


def _marks(facts: DataFrame, kind: str, place: str) -> DataFrame:
    return facts.where(F.col("kind") == kind).select("path", F.col("part").alias("sheet"), F.col("a" if place == "row" else "b").alias(place)).distinct()


def row_documents(facts: DataFrame, kinds: set[str] | None = None) -> DataFrame:
    """(path, sheet, row, content, hidden, is_totals_row) of rows below the headers.

    ``header: value`` by column, with what is to be said of a cell, joined by bars; rows of
    two numbers or more end in their sum, count and mean.  Of a merged range only the first
    cell speaks.  kinds: the kinds of fact that there are, if they are known; what is made of others is not planned.
    """
    none = lambda kind: kinds is not None and kind not in kinds
    cell = cells(facts)
    heads = header_rows(cell)
    below = cell.join(heads, [*KEY, "row"], "left_anti").where("shown is not null")
    if none("merge"):
        spans = below.withColumn("span", F.lit(None).cast("string"))
    else:
        ranges = merged(facts)
        other = (F.col("row") != F.col("_x")) | (F.col("col") != F.col("_y"))
        secondary = in_rectangles(below.select(*KEY, "row", "col"), ranges, list(KEY)).where(other).select(*KEY, "row", "col").distinct()
        below = below.join(secondary, [*KEY, "row", "col"], "left_anti")
        spans = below.join(ranges.withColumn("span", F.concat(F.lit(" [merged "), F.col("row2") - F.col("row") + 1, F.lit("x"), F.col("col2") - F.col("col") + 1, F.lit("]"))).drop("row2", "col2"), [*KEY, "row", "col"], "left")
    hidden_cols = _marks(facts, "hidden_col", "col").withColumn("hidden_col", F.lit(True))
    named = spans.join(headers(cell, heads), [*KEY, "col"], "left")
    named = named.withColumn("hidden_col", F.lit(False)) if none("hidden_col") else named.join(hidden_cols, [*KEY, "col"], "left")
    label = F.when(F.col("header").isNotNull(), F.concat(F.col("header"), F.lit(": "))).otherwise("")
    said = F.concat(label, F.col("shown"), F.coalesce("span", F.lit("")), F.when(F.col("hidden_col"), " [HIDDEN COL]").otherwise(""), F.when(F.col("bold"), " [bold]").otherwise(""))
    number = F.when((F.col("kind") == "n") & ~F.isnan("number") & (F.abs("number") < float("inf")), F.col("number"))
    rows = named.groupBy(*KEY, "row").agg(ordered_concat(said, F.col("col"), " | ").alias("text"), F.sum(number).alias("total"), F.count(number).alias("n"), F.avg(number).alias("mean"))
    fixed = lambda c, p: F.call_function("format_number", F.col(c), F.lit(p))
    sums = F.when(F.col("n") >= 2, F.concat(F.lit(" | [Row total: "), fixed("total", "#,##0"), F.lit(", count: "), F.col("n"), F.lit(", avg: "), fixed("mean", "#,##0.0"), F.lit("]"))).otherwise("")
    hidden = _marks(facts, "hidden_row", "row").withColumn("hidden", F.lit(True))
    totals = totals_rows(cell).withColumn("is_totals_row", F.lit(True))
    out = rows.withColumn("hidden", F.lit(False)) if none("hidden_row") else rows.join(hidden, [*KEY, "row"], "left")
    out = out.join(totals, [*KEY, "row"], "left")
    return out.select(*KEY, "row", F.concat("text", sums).alias("content"), F.coalesce("hidden", F.lit(False)).alias("hidden"), F.coalesce("is_totals_row", F.lit(False)).alias("is_totals_row"))


def column_statistics(facts: DataFrame) -> DataFrame:
    """(path, sheet, col, header, n, total, mean, low, high) of columns of two numbers or more; header rows don't count."""
    cell = cells(facts)
    heads = header_rows(cell)
    numbers = cell.join(heads, [*KEY, "row"], "left_anti").where((F.col("kind") == "n") & ~F.isnan("number") & (F.abs("number") < float("inf")))
    stats = numbers.groupBy(*KEY, "col").agg(
        F.count("*").alias("n"), F.round(F.sum("number"), 2).alias("total"), F.round(F.avg("number"), 2).alias("mean"), F.min("number").alias("low"), F.max("number").alias("high")
    ).where("n >= 2")
    return stats.join(headers(cell, heads), [*KEY, "col"], "left")


def column_letters(col: Column) -> Column:
    """A, B, ..., Z, AA, ... of a column number up to three letters."""
    letter = lambda n: F.char(65 + n.cast("int"))
    n = col - 1
    two = F.floor(n / 26) - 1
    return F.concat(F.when(n >= 702, letter(F.floor((n - 702) / 676))).otherwise(""), F.when(n >= 26, letter(two % 26)).otherwise(""), letter(n % 26))


def formulas(facts: DataFrame) -> DataFrame:
    """Per workbook: formula_count, cross_sheet_count, the first 200 formulas and the first 50 that name another sheet."""
    cell = cells(facts).where("formula is not null")
    order = facts.where("kind = 'sheet'").select("path", F.col("part").alias("sheet"), "part_no")
    line = F.concat("sheet", F.lit("!"), column_letters(F.col("col")), "row", F.lit(": "), fx.with_formula(F.coalesce("text", F.lit("")), F.col("formula")))
    rows = cell.join(order, KEY).select("path", F.struct("part_no", "row", "col").alias("at"), line.alias("line"), fx.refers_elsewhere(F.col("formula"), F.col("sheet")).alias("cross"))
    place = F.row_number().over(Window.partitionBy("path", "cross").orderBy("at"))
    every = F.row_number().over(Window.partitionBy("path").orderBy("at"))
    kept = rows.withColumn("place", place).withColumn("every", every)
    listed = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("at", "line")))), lambda x: x["line"]), "\n")
    return kept.groupBy("path").agg(
        F.count("*").alias("formula_count"), F.count_if("cross").alias("cross_sheet_count"), listed(F.col("every") <= FORMULAS).alias("formulas"),
        listed(F.col("cross") & (F.col("place") <= CROSS_SHEET)).alias("cross_sheet"),
    )


def sheet_summaries(facts: DataFrame) -> DataFrame:
    """Per sheet: visibility, last row and column, and how many of everything there is."""
    kinds = ("cell", "merge", "comment", "hyperlink", "validation", "conditional_format", "chart", "table", "sparkline", "hidden_row", "hidden_col", "row_outline", "col_outline")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds]
    state = F.max(F.when(F.col("kind") == "sheet", F.col("name"))).alias("visibility")
    settings = F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == "setting", F.concat_ws(" ", "name", "text")))), "; ").alias("settings")
    size = [F.max(F.when(F.col("kind") == "cell", F.col(c))).alias(n) for c, n in (("a", "last_row"), ("b", "last_col"))]
    return facts.where("part <> '' and part is not null").groupBy("path", F.col("part").alias("sheet")).agg(state, *size, *counts, settings)


def images(facts: DataFrame) -> DataFrame:
    """(path, image, bytes, sheet): every image of a workbook, once a sheet that shows it; null for one that no sheet's drawing refers to."""
    shown = facts.where("kind = 'picture'").select("path", F.col("name").alias("image"), F.col("part").alias("sheet")).distinct()
    held = facts.where("kind = 'image'").select("path", F.col("name").alias("image"), F.col("number").cast("long").alias("bytes"))
    return held.join(shown, ["path", "image"], "left")


def annotations(facts: DataFrame) -> DataFrame:
    """(path, sheet, kind, content): comments, links, rules, tables, charts, sparklines, pivots, named ranges, images and properties as lines."""
    kinds = ("comment", "hyperlink", "validation", "conditional_format", "table", "chart", "sparkline", "pivot", "named_range", "image", "picture", "property")
    ref = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.concat(column_letters(F.col("b")), F.col("a")))
    said = (
        F.when(F.col("kind") == "comment", F.concat(F.col("flags"), F.lit(": ["), F.coalesce("name", F.lit("")), F.lit("] "), F.col("text")))
        .when(F.col("kind") == "hyperlink", F.concat_ws(" -> ", "name", "text"))
        .when(F.col("kind").isin("named_range", "property"), F.concat_ws(" = ", "name", "text"))
        .otherwise(F.concat_ws(" ", ref, F.translate("flags", "\t", " "), "name", "text"))
    )
    return facts.where(F.col("kind").isin(*kinds)).select("path", F.col("part").alias("sheet"), "kind", said.alias("content")).distinct()
