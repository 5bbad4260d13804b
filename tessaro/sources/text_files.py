"""Text formats: encodings, CSV, JSON, XML, logs, HTML, plain text.

Formats that Spark reads are read by Spark; Python only decodes and sniffs.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tessaro.functions.text import html_text
from tessaro.sources import variants
from tessaro.sources.shared import each_row

# Tried in this order; latin-1 takes anything.
ENCODINGS = ("utf-8-sig", "utf-8", "utf-16", "latin-1", "cp1252", "cp1256", "iso-8859-6")
PROBE_CHARS, SNIFF_CHARS, JSON_RECORDS, LOG_LISTED, PROFILE_ROWS = 1024, 8192, 1000, 50, 10_000


def _strings(*names: str) -> StructType:
    out = StructType()
    for n in names:
        out = out.add(n, StringType())
    return out


def _decoded(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    for name in ENCODINGS:
        if name == "utf-16" and raw[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue  # without its mark anything of even length would pass
        try:
            raw.decode(name) if len(raw) <= PROBE_CHARS else raw[: 4 * PROBE_CHARS].decode(name, "strict")
        except UnicodeDecodeError as e:
            # An unfinished character at the end of the probe is no error of the encoding.
            if not (len(raw) > 4 * PROBE_CHARS and e.end >= 4 * PROBE_CHARS - 3 and name.startswith("utf")):
                continue
        except UnicodeError:
            continue
        return raw.decode(name, "replace")
    return raw.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """Bytes as text, in the first encoding that fits the beginning."""
    return content.map(_decoded)


def _delimiter(sample: str | None) -> str:
    try:
        return csv.Sniffer().sniff((sample or "")[:SNIFF_CHARS], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


@F.pandas_udf(StringType())
def sniff_delimiter(text: pd.Series) -> pd.Series:
    return text.map(_delimiter)


def read_csv(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """A CSV or TSV file with its header; columns as strings.  The delimiter is sniffed from the beginning."""
    if separator is None:
        head = "\n".join(r["value"] for r in spark.read.text(path).limit(50).collect())
        separator = "\t" if path.lower().endswith(".tsv") else _delimiter(head)
    return spark.read.option("header", "true").option("sep", separator).option("mode", "PERMISSIVE").csv(path)


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """``header: value`` of the values that are not blank, joined by bars; null if none is."""
    parts = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string")))) for c in columns or df.columns]
    text = F.concat_ws(" | ", *parts)
    return F.when(text != "", text)


def csv_profile(df: DataFrame, columns: list[str], most: int | None = PROFILE_ROWS) -> DataFrame:
    """Of the first 10,000 rows (None: of all): n_rows and each numeric column's count, min, max and mean of two decimals."""
    head = df.select(*columns) if most is None else df.select(*columns).limit(most)
    number = lambda c: F.col(c).try_cast("double")
    stats = [F.struct(F.lit(c).alias("column_name"), F.count(number(c)).alias("n"), F.min(number(c)).alias("min_value"), F.max(number(c)).alias("max_value"),
                      F.round(F.avg(number(c)), 2).alias("mean_value")) for c in columns]
    return head.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def plain_number(x: Column, whole: Column) -> Column:
    """A number as text: as an integer where whole says so and it fits one."""
    return F.when(whole & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))


def statistics_line(name: Column, low: Column, high: Column, mean: Column, whole: Column) -> Column:
    """``  name: min=, max=, avg=`` of a numeric column, the average with two decimals."""
    average = F.call_function("format_number", mean, F.lit("0.00"))
    return F.concat(F.lit("  "), name, F.lit(": min="), plain_number(low, whole), F.lit(", max="), plain_number(high, whole), F.lit(", avg="), average)


def _csv_records(ext: str, text: str | None) -> Iterator[list[str]]:
    return csv.reader(io.StringIO(text or ""), delimiter="\t" if ext == ".tsv" else _delimiter(text))


def _csv_cells(path: str, ext: str, text: str | None) -> Iterator[tuple]:
    """(path, row, col, name, value) of all records of a whole CSV text; blank lines and records with too many values are left out, no value is null.

    A text that is no CSV at any place has none: it is read through first, so that its cells need not be held.
    """
    try:
        for _ in _csv_records(ext, text):
            pass
    except csv.Error:
        return
    records = _csv_records(ext, text)
    names = next(records, [])
    for n, record in enumerate(r for r in records if r and len(r) <= len(names)):
        for i, name in enumerate(names):
            yield path, n, i, name, (record[i].strip() or None) if i < len(record) else None


def csv_summaries(texts: DataFrame) -> DataFrame:
    """(path, content) of CSV texts(path, ext, text) with a value: rows and columns, their names, and the extremes, mean and count of numeric ones."""
    cells = each_row(texts.select("path", "ext", "text"), _csv_cells, "path string, row long, col int, name string, value string")
    number = F.col("value").try_cast("double")
    per = cells.groupBy("path", "col", "name").agg(
        F.max("row").alias("last"), F.count("value").alias("n"), F.count(number).alias("numbers"), F.min(number).alias("low"), F.max(number).alias("high"), F.avg(number).alias("mean"),
        F.coalesce(F.bool_and(~F.col("value").rlike("[^0-9+-]")), F.lit(False)).alias("whole"),
    )
    line = F.concat(statistics_line(F.col("name"), F.col("low"), F.col("high"), F.col("mean"), F.col("whole")), F.lit(", count="), F.col("n"))
    said = F.struct("col", "name", F.when((F.col("n") > 0) & (F.col("n") == F.col("numbers")), line).alias("line"))
    whole = per.groupBy("path").agg(F.max("last").alias("last"), F.sum("n").alias("values"), F.array_sort(F.collect_list(said)).alias("columns")).where("values > 0")
    head = F.concat(F.lit("[CSV Summary: "), F.col("last") + 1, F.lit(" rows x "), F.size("columns"), F.lit(" columns]"))
    lines = F.array_join(F.transform("columns", lambda c: c["line"]), "\n")
    return whole.select("path", F.concat_ws("\n", head, F.concat(F.lit("Columns: "), F.array_join("columns.name", ", ")), F.nullif(lines, F.lit(""))).alias("content"))


def flatten_structs(df: DataFrame, joined: str = ".") -> DataFrame:
    """Nested structs as columns of dotted names, as deep as they go."""
    def leaves(schema: StructType, at: tuple[str, ...] = ()):
        for f in schema.fields:
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, (*at, f.name))
            else:
                yield (*at, f.name)

    return df.select(*[F.col(".".join(f"`{p}`" for p in leaf)).alias(joined.join(leaf)) for leaf in leaves(df.schema)])


def json_records(files: DataFrame, key: str = "path", text: str = "content", most: int = JSON_RECORDS) -> DataFrame:
    """Of every file that is a list: record (from 1) and the record as indented JSON, the first thousand."""
    records = files.select(key, F.posexplode(F.from_json(text, "array<string>")).alias("at", "raw")).where(F.col("at") < most)
    return records.select(key, (F.col("at") + 1).alias("record"), pretty_json("raw")["content"].alias("content"))


def json_table(spark: SparkSession, path: str) -> DataFrame:
    """A file of a list of objects as a table, nested objects as dotted columns."""
    return flatten_structs(spark.read.option("multiLine", "true").json(path))


def _pretty(text: str | None) -> tuple[str | None, str | None]:
    try:
        return json.dumps(json.loads(text or ""), indent=2, ensure_ascii=False), None
    except ValueError as e:
        return text, str(e)


@F.pandas_udf(_strings("content", "parse_error"))
def pretty_json(text: pd.Series) -> pd.DataFrame:
    """JSON with an indent of two; invalid text as it is, with the error."""
    return pd.DataFrame([_pretty(t) for t in text], columns=["content", "parse_error"])


XML_DEPTH, XML_TEXT = 10, 200


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _outline(text: str | None) -> tuple[str | None, str | None, str | None]:
    try:
        root = ElementTree.fromstring(text or "")
    except ElementTree.ParseError:
        return text, None, "invalid_xml"
    lines, waiting = [f"[XML Document: {root.tag}]"], [(0, root)]
    while waiting:
        level, node = waiting.pop()
        said, below = (node.text or "").strip(), list(node)
        if said or below:  # leaves without text say nothing
            shown = "".join(f' {k}="{v}"' for k, v in node.attrib.items())
            cut = said if len(said) <= XML_TEXT else said[:XML_TEXT] + "..."
            lines.append(f"{'  ' * level}<{_local(node.tag)}{shown}>{' ' + cut if cut else ''}")
        if level < XML_DEPTH:
            waiting += [(level + 1, child) for child in reversed(below)]
    return "\n".join(lines), root.tag, None


@F.pandas_udf(_strings("content", "root_tag", "parse_error"))
def xml_tree(text: pd.Series) -> pd.DataFrame:
    """An indented outline ten levels deep, texts cut at 200; leaves without text are left out; invalid text as it is."""
    return pd.DataFrame([_outline(t) for t in text], columns=["content", "root_tag", "parse_error"])


def log_level(line: Column) -> Column:
    """error, warning or null, by words in the line; errors first."""
    low = F.lower(line)
    return F.when(low.rlike("error|exception|fatal|critical|fail"), "error").when(low.rlike("warn|warning|caution"), "warning")


def log_issues(logs: DataFrame, key: str = "path", text: str = "content", most: int = LOG_LISTED) -> DataFrame:
    """Per log with issues: error_count, warning_count, and the first fifty lines of each as ``L{n}: line``."""
    lines = logs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return line_issues(lines.select(key, (F.col("at") + 1).alias("at"), "line"), key, most)


def line_issues(lines: DataFrame, key: str, most: int = LOG_LISTED) -> DataFrame:
    """log_issues of lines that are rows already: key, at (the line's number) and line.

    Counts are partial sums, and of the lines each task keeps its first fifty a level: no log meets in one task.
    """
    found = lines.select(key, "at", "line", log_level(F.col("line")).alias("level")).where("level is not null")
    counts = found.groupBy(key).agg(F.count_if(F.col("level") == "error").alias("error_count"), F.count_if(F.col("level") == "warning").alias("warning_count"))
    place = F.row_number().over(Window.partitionBy(key, "level").orderBy("at"))
    first = found.withColumn("place", place).where(F.col("place") <= most)
    said = F.concat(F.lit("L"), F.col("at").cast("string"), F.lit(": "), F.trim("line"))
    listed = lambda level: F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == level, F.struct("at", said.alias("said"))))), lambda r: r["said"])
    texts = first.groupBy(key).agg(F.array_join(listed("error"), "\n").alias("errors"), F.array_join(listed("warning"), "\n").alias("warnings"))
    named = texts.withColumnRenamed(key, "_key")
    return counts.join(named, counts[key].eqNullSafe(named["_key"])).drop("_key")


def log_documents(logs: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """(key, content) of logs with issues: both counts, then the listed lines."""
    found = log_issues(logs, key, text)
    head = F.concat(F.lit("Log issues: "), F.col("error_count"), F.lit(" errors, "), F.col("warning_count"), F.lit(" warnings"))
    part = lambda title, c: F.when(F.col(c) != "", F.concat(F.lit(f"{title}:\n"), F.col(c)))
    return found.select(key, F.concat_ws("\n\n", head, part("Errors", "errors"), part("Warnings", "warnings")).alias("content"))


def json_summaries(files: DataFrame, key: str = "path", text: str = "content", most: int = JSON_RECORDS) -> DataFrame:
    """(key, content) of every file that is a list: how many records it has, how many are listed, the fields of its objects, and a line a numeric field, four levels deep."""
    rows = files.select(key, F.from_json(text, "array<string>").alias("all")).where("all is not null")
    fields = F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda r: F.coalesce(F.json_object_keys(r), F.array().cast("array<string>"))))))
    said = F.concat(F.lit("JSON list: "), F.size("all"), F.lit(" records, "), F.least(F.size("all"), F.lit(most)), F.lit(" listed"))
    heads = rows.select(key, F.concat(said, F.when(F.size(fields) > 0, F.concat(F.lit("\nFields: "), F.array_join(fields, ", "))).otherwise("")).alias("head"))
    found = variants.field_statistics(variants.records(files.select(key, text), text), [key], depth=4).where("n_numbers > 0")
    whole = (F.col("low") == F.floor("low")) & (F.col("high") == F.floor("high"))
    line = statistics_line(F.col("field"), F.col("low"), F.col("high"), F.col("mean"), whole)
    lines = found.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", line.alias("line")))), lambda s: s["line"]), "\n").alias("lines"))
    return heads.join(lines, key, "left").select(key, F.concat_ws("\n", "head", "lines").alias("content"))


def html_documents(pages: DataFrame, text: str = "html") -> DataFrame:
    """pages with their readable text as content; pages without any are left out."""
    return pages.withColumn("content", html_text(F.col(text))).where("content is not null")


def plain_documents(files: DataFrame) -> DataFrame:
    """(path, content) of text files that are not blank."""
    return files.select("path", decode_text("content").alias("content")).where(F.col("content").rlike(r"\S"))
