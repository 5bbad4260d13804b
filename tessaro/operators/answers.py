"""From a raw sheet to an answer: the table under its header, a summary, and the answer as text."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaro.operators import tabular

WIDE, SAMPLE, SHOWN = 15, 5, 20


def sheet_table(cells: DataFrame, sheet: str) -> DataFrame:
    """The sheet's table below its best header: column _row, then the named columns; blank rows are left out.

    cells(sheet, row, col, value), rows and cols from 0.  Unnamed columns are called
    Col_n.  A repeated name gets .1, .2, ...  A column whose values are all numbers is numeric.
    """
    here = cells.where((F.col("sheet") == sheet) & (F.trim("value") != ""))
    head = tabular.best_header(here).first()
    if head is None:
        return here.select(F.col("row").alias("_row")).limit(0)
    first, n = head["header_row"], head["n_rows"]
    last = here.agg(F.max("col")).first()[0]
    named = here.where((F.col("row") >= first) & (F.col("row") < first + n)).orderBy("col", "row").collect()  # one or two rows
    names: list[str] = []
    for c in range(last + 1):
        base = "_".join(r["value"].strip() for r in named if r["col"] == c) or f"Col_{c + 1}"
        again = sum(x == base or x.rpartition(".")[0] == base for x in names)
        names.append(f"{base}.{again}" if again else base)
    body = here.where(F.col("row") >= first + n)
    wide = body.groupBy(F.col("row").alias("_row")).pivot("col", list(range(last + 1))).agg(F.first("value"))
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    kinds = wide.agg(*[(F.count(number(c)) == F.count(F.col(f"`{c}`"))).alias(str(c)) for c in range(last + 1)]).first()
    return wide.select("_row", *[(number(c) if kinds[str(c)] else F.col(f"`{c}`")).alias(names[c]) for c in range(last + 1)])


def summary(df: DataFrame, title: str, order: str) -> str:
    """What a table holds, as text: shape, columns, patterns of names, first rows, their totals, commonest values.

    Reads one count, five rows, and a value count for each of the first three text columns.
    """
    numbers, texts = [c for c in tabular.numeric_columns(df) if c != order], tabular.text_columns(df)
    columns = [c for c in df.columns if c != order]
    lines = [f"=== {title} ===", f"Rows: {df.count()}, Columns: {len(columns)}"]
    sample_columns = columns
    if len(columns) > WIDE:
        pattern = tabular.column_pattern(numbers)
        lines += [f"Text columns: {texts}", f"Numeric column patterns: {pattern}" if pattern else f"Numeric columns ({len(numbers)}): {numbers[:10]}"]
        sample_columns = texts[:3] + numbers[:5]
    else:
        lines += [f"Columns: {', '.join(columns)}", f"Numeric columns: {numbers}"]
    head = tabular.with_total(df, numbers or None).orderBy(order).limit(SAMPLE).collect()
    lines.append(f"First rows ({', '.join(sample_columns)}):")
    lines += [" | ".join("" if r[c] is None else str(r[c]) for c in sample_columns) for r in head]
    if len(columns) > WIDE and numbers:
        label = texts[1] if len(texts) > 1 else texts[0] if texts else None
        lines += [f"Row total {r[label] if label else r[order]}: {int(r['total'])}" for r in head]
    for c in texts[:3]:
        if counts := tabular.value_counts(df, c).collect():
            lines.append(f"'{c}' values: " + ", ".join(f"{r['value']} ({r['n']})" for r in counts))
    return "\n".join(lines)


def answer_text(df: DataFrame) -> str:
    """A result as text: one value plainly, whole numbers without a point, else its first 20 rows and how many there are."""
    rows = df.limit(SHOWN + 1).collect()
    if not rows:
        return "No results found."
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    if len(rows) == 1 and len(df.columns) == 1:
        return "No result." if rows[0][0] is None else plain(rows[0][0])
    lines = [" | ".join(df.columns), *(" | ".join("" if v is None else plain(v) for v in r) for r in rows[:SHOWN])]
    return "\n".join(lines + ([f"({df.count()} rows in all)"] if len(rows) > SHOWN else []))


def ask(df: DataFrame, question: str, order: str, planner: Callable[[str, str], tabular.Query | None] | None = None) -> dict:
    """{answer, plan, success}: a known pattern, else what a supplied planner makes of the summary.

    planner(question, summary) returns an operation of the closed set; one that cannot
    run is asked for once more with the error added to the question.
    """
    if found := tabular.answer(df, question, order):
        return {"answer": answer_text(found[1]), "plan": found[0], "success": True}
    asked = question
    about = summary(df, "table", order) if planner else ""
    for _ in range(2 if planner else 0):
        plan = planner(asked, about)
        if plan is None:
            break
        try:
            return {"answer": answer_text(tabular.run_query(df, plan)), "plan": plan, "success": True}
        except ValueError as e:
            asked = f"{question}\n{e}"
    return {"answer": "No answer found.", "plan": None, "success": False}


def phrased(question: str, computed: str, filename: str) -> str:
    """The answer's sentence where no language model phrases it."""
    return f"Based on the data in {filename}:\n\n{computed}"
