"""Questions about tables: totals, extremes, counts, profiles; a closed set of operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What in a question asks for which answer; substrings of the lower-cased question.
NAME_COLUMNS = ("name", "employee", "person", "staff")
TOTAL_WORDS = ("total", "sum", "how many", "كم", "مجموع", "leave", "days", "hours", "إجازة")
LIST_WORDS = ("list all", "show all", "all employees", "everyone", "جميع")
WHO_WORDS = ("who has", "من لديه", "من عنده")
MOST_WORDS = ("most", "highest", "maximum", "max", "أكثر", "أعلى")
LEAST_WORDS = ("least", "lowest", "minimum", "min", "fewest", "أقل")
COUNT_WORDS = ("how many employees", "how many people", "how many rows", "total employees", "total people", "count", "عدد الموظفين")
LEAVE_WORDS = ("leave", "days", "hours")
MEAN_WORDS = ("average", "mean", "متوسط")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def name_column(df: DataFrame) -> str | None:
    texts = text_columns(df)
    return next((c for c in texts if any(k in c.lower() for k in NAME_COLUMNS)), texts[-1] if texts else None)


def row_total(columns: list[str]) -> Column:
    """Sum over a row, nulls and NaN left out."""
    return sum((F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in columns), F.lit(0.0))


def with_total(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumn("total", row_total(columns or numeric_columns(df)))


def total_for_name(df: DataFrame, name: str, order: str, question: str) -> DataFrame:
    """Total of the first row (by order) a part of whose name, longer than two letters, is in the question; null names never are."""
    parts = F.filter(F.split(F.lower(F.col(name)), r"\s+"), lambda p: F.length(p) > 2)
    hit = F.exists(parts, lambda p: F.contains(F.lit(question.lower()), p))
    return with_total(df).where(hit).orderBy(order).limit(1).select(name, "total")


def all_sorted(df: DataFrame, name: str, order: str, ascending: bool = False) -> DataFrame:
    total = F.asc("total") if ascending else F.desc("total")
    return with_total(df).orderBy(total, order).select(name, "total")


def extreme(df: DataFrame, name: str, order: str, most: bool = True) -> DataFrame:
    """``name (total)`` of the row of largest or smallest total; of ties the first row."""
    key = F.struct((-F.col("total") if most else F.col("total")).alias("t"), F.col(order).alias("o"))
    best = with_total(df).agg(F.min_by(F.struct(name, "total"), key).alias("b"))
    return best.select(F.concat(F.col(f"b.{name}"), F.lit(" ("), F.col("b.total").cast("long").cast("string"), F.lit(")")).alias("answer"))


def mean_total(df: DataFrame) -> DataFrame:
    return with_total(df).agg(F.avg("total").alias("mean_total"))


def value_counts(df: DataFrame, column: str, most: int = 5) -> DataFrame:
    """The column's commonest values; only where it has 2 to 10 distinct ones."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    distinct = counts.agg(F.count("*").alias("d"))
    return counts.crossJoin(F.broadcast(distinct)).where("d between 2 and 10").orderBy(F.desc("n"), "value").limit(most).select("value", "n")


def column_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a numeric column: n, min, max, mean, total; one pass over the table."""
    names = columns or numeric_columns(df)
    valid = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    stats = [F.struct(F.lit(c).alias("column_name"), F.count(valid(c)).alias("n"), F.min(valid(c)).alias("min_value"), F.max(valid(c)).alias("max_value"),
                      F.avg(valid(c)).alias("mean_value"), F.sum(valid(c)).alias("total")) for c in names]
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def column_pattern(columns: list[str]) -> str:
    """``first__last`` of prefixes and suffixes if half of the names have an underscore; else empty."""
    parts = [c.rsplit("_", 1) for c in columns if "_" in c]
    if not parts or 2 * len(parts) < len(columns):
        return ""
    prefixes, suffixes = sorted({p for p, _ in parts}), sorted({s for _, s in parts})
    return f"{prefixes[0]}__{prefixes[-1]} x {suffixes[0]}__{suffixes[-1]} ({len(columns)} columns: {columns[0]}...{columns[-1]})"


def header_scores(cells: DataFrame) -> DataFrame:
    """Scores of header candidates of raw tables: cells(sheet, row, col, value), rows and cols from 0.

    Candidates are the first five rows, alone or with the row after.  Alone: 10 a named
    column, 1 a value below in the first column, -50 for a title (at most one distinct
    value among the first three rows of a table wider than one column), -8 a numeric name.  In pairs names
    are joined by _: 10 a distinct named column, 1 a value below, -15 a repeated name, -8 a
    numeric one; no pair starts at a title.  Rows with nothing below them are no candidates.
    Points and hyphens do not make a name any less numeric, in pairs neither do
    underscores.  (sheet, header_row, n_rows, score).
    """
    shape = cells.groupBy("sheet").agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"))
    said = cells.where("value is not null and trim(value) <> ''").withColumn("value", F.trim("value"))
    first = said.where("col = 0")
    head = said.where("row < 6")
    titles = head.where("row < 3").groupBy("sheet", "row").agg(F.count_distinct("value").alias("d"))
    rows = shape.withColumn("header_row", F.explode(F.sequence(F.lit(0), F.least(F.lit(4), F.col("height") - 1))))
    marked = rows.join(titles.withColumnRenamed("row", "header_row"), ["sheet", "header_row"], "left")
    is_title = (F.col("header_row") < 3) & (F.coalesce("d", F.lit(0)) <= 1) & (F.col("width") > 1)
    candidates = marked.withColumn("title", is_title).withColumn("n_rows", F.explode(F.array(F.lit(1), F.lit(2))))
    candidates = candidates.where("header_row + n_rows < height and (n_rows = 1 or (not title and header_row + 1 < 5))")
    # A count for each of the seven places where a body can begin.
    bodies = first.groupBy("sheet").agg(F.array(*[F.count_if(F.col("row") >= r) for r in range(7)]).alias("filled"))
    below = F.element_at("filled", F.col("header_row") + F.col("n_rows") + 1)
    candidates = candidates.join(bodies, "sheet", "left").withColumn("below", F.coalesce(below, F.lit(0))).drop("filled")
    on = (head["sheet"] == candidates["sheet"]) & (head["row"] >= F.col("header_row")) & (head["row"] < F.col("header_row") + F.col("n_rows"))
    picked = candidates.join(head, on).select(candidates["*"], "row", "col", "value")
    keys = ["sheet", "header_row", "n_rows"]
    names = picked.groupBy(*keys, "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]), "_").alias("name"))
    bare = F.when(F.col("n_rows") == 1, F.translate("name", ".-", "")).otherwise(F.translate("name", "._-", ""))
    numeric = bare.rlike(r"^\p{Nd}+$")
    tally = names.groupBy(*keys).agg(F.count("*").alias("named"), F.count_distinct("name").alias("distinct"), F.count_if(numeric).alias("numeric"))
    scored = candidates.join(tally, keys, "left").na.fill(0, ["named", "distinct", "numeric"])
    single = 10 * F.col("named") + F.col("below") - F.when(F.col("title"), 50).otherwise(0) - 8 * F.col("numeric")
    pair = 10 * F.col("distinct") + F.col("below") - 15 * (F.col("named") - F.col("distinct")) - 8 * F.col("numeric")
    return scored.select(*keys, F.when(F.col("n_rows") == 1, single).otherwise(pair).alias("score"))


def best_header(cells: DataFrame) -> DataFrame:
    """The winning candidate a sheet: singles before pairs, upper rows first, only a higher score wins; the first row where none reaches 0."""
    order = Window.partitionBy("sheet").orderBy(F.desc("score"), "n_rows", "header_row")
    best = header_scores(cells).where("score >= 0").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    sheets = cells.select("sheet").distinct().join(best, "sheet", "left")
    return sheets.select("sheet", F.coalesce("header_row", F.lit(0)).alias("header_row"), F.coalesce("n_rows", F.lit(1)).alias("n_rows"), F.coalesce("score", F.lit(-1)).alias("score"))


@dataclass(frozen=True)
class Query:
    """One operation of the closed set: filter_contains, row_sum, col_sum, count_where, value_counts, argmax.

    order: the column that tells which of equal rows argmax takes, the first; without it the least label.
    """

    op: str
    col: str | None = None
    value: str | None = None
    label: str | None = None
    order: str | None = None


def run_query(df: DataFrame, q: Query) -> DataFrame:
    for c in (q.col, q.label, q.order):
        if c is not None and c not in df.columns:
            raise ValueError(f"no column {c}")
    match q.op:
        case "filter_contains":
            return df.where(F.coalesce(F.col(q.col).rlike(f"(?i){q.value}"), F.lit(False)))
        case "row_sum":
            return with_total(df)
        case "col_sum":
            return df.agg(F.sum(q.col).alias("total"))
        case "count_where":
            return df.where(F.col(q.col) == q.value).agg(F.count("*").alias("n"))
        case "value_counts":
            return df.where(F.col(q.col).isNotNull()).groupBy(q.col).agg(F.count("*").alias("n"))
        case "argmax":
            best = df.where(F.col(q.col).isNotNull()).withColumn("_at", F.col(q.order or q.label)).groupBy(q.col).agg(F.min_by(q.label, "_at").alias(q.label))
            return best.agg(F.max_by(q.label, q.col).alias(q.label))
    raise ValueError(f"unknown operation {q.op}")


def answer(df: DataFrame, question: str, order: str) -> tuple[str, DataFrame] | None:
    """The first pattern that the question meets and its answer's plan; None if none does."""
    q = question.lower()
    has = lambda words: any(w in q for w in words)
    name, numbers = name_column(df), [c for c in numeric_columns(df) if c != order]
    table = df.select(order, name, *numbers) if name else df
    if name and numbers:
        totals = table.select(order, name, row_total(numbers).alias("total"))
        if has(TOTAL_WORDS):
            parts = F.filter(F.split(F.lower(F.col(name)), r"\s+"), lambda p: F.length(p) > 2)
            hit = totals.where(F.exists(parts, lambda p: F.contains(F.lit(q), p))).orderBy(order).limit(1)
            if hit.count():
                return "total_for_name", hit.select("total")
        if has(LIST_WORDS):
            low_first = any(w in q for w in ("lowest", "ascending", "least"))
            return "list_all", totals.orderBy(F.asc("total") if low_first else F.desc("total"), order).select(name, "total")
        if has(WHO_WORDS) and (has(MOST_WORDS) or has(LEAST_WORDS)):
            most = has(MOST_WORDS)
            best = totals.orderBy(F.desc("total") if most else F.asc("total"), order).limit(1)
            text = F.concat(F.col(name), F.lit(" ("), F.col("total").cast("long").cast("string"), F.lit(")"))
            return "who_has", best.select(text.alias("answer"))
    if has(COUNT_WORDS) and not has(LEAVE_WORDS):
        return "row_count", df.agg(F.count("*").alias("n"))
    if name and numbers and has(MEAN_WORDS):
        return "mean_total", table.select(row_total(numbers).alias("total")).agg(F.avg("total").alias("mean_total"))
    return None
