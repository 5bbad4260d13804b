"""Batch ingest: files to documents and chunks in one plan."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaro.functions.text import html_text
from tessaro.operators.chunking import OVERLAP, SIZE, chunk_documents
from tessaro.operators.context import ordered_concat
from tessaro.sources import ooxml, pages, sheets, text_files
from tessaro.sources.routing import already_chunked, extension, parser_of, supported_types
from tessaro.sources.shared import each_row, new_folder, written

DOCS = "path string, ordinal long, content string"
#: Ordinals of what is beside a file's own rows or sections begin here.
BESIDE = 2**50
#: Parsers of text and Office files.
PARSERS = ("text", "excel", "pptx", "word")
#: A CSV field may be as long as a file.
csv.field_size_limit(2**31 - 1)


def _csv_rows(path: str, ext: str, text: str | None) -> list[tuple]:
    """Rows of a whole CSV text as ``header: value`` lines; the header is row 1.  Without a record, or where the text is no CSV, it is one row as it is."""
    separator = "\t" if ext == ".tsv" else text_files._delimiter(text)
    rows = csv.reader(io.StringIO(text or ""), delimiter=separator)
    try:
        names = next(rows, [])
        out = [(path, n, " | ".join(f"{h}: {v}" for h, v in zip(names, row) if v.strip())) for n, row in enumerate(rows, 2)]
    except csv.Error:
        out = []
    return [r for r in out if r[2]] or [(path, 1, text)]


def _beside(found: DataFrame) -> DataFrame:
    """(path, ordinal, content) of what Word files hold beside sections: tables, then headers, footers, notes, comments and links."""
    tables = pages.table_texts(found).select("path", (F.lit(BESIDE) + F.col("part_no")).alias("ordinal"), "content")
    kinds = F.array(*[F.lit(k) for k in ("header", "footer", "footnote", "endnote", "comment", "hyperlink")])
    place = (F.lit(2 * BESIDE) + F.array_position(kinds, F.col("kind"))).alias("ordinal")
    return tables.unionByName(pages.notes(found).select("path", place, "content"))


def workbook_notes(found: DataFrame) -> DataFrame:
    """(path, ordinal, content) of what workbooks hold beside rows, from their facts: a summary, the statistics of numeric columns and the annotations of each sheet, and formulas."""
    order = found.where("kind = 'sheet'").select("path", F.col("part").alias("sheet"), "part_no")
    at = lambda block: F.lit(block * BESIDE) + F.coalesce("part_no", F.lit(0)).cast("long")
    counted = sheets.sheet_summaries(found.where(parser_of(F.col("path")) == "excel"))
    many = [c for c in counted.columns if c.startswith("n_")]
    size = F.concat(F.lit("Sheet "), F.col("sheet"), F.lit(": "), F.coalesce("last_row", F.lit(0)), F.lit(" rows, "), F.coalesce("last_col", F.lit(0)), F.lit(" columns"))
    there = [F.when(F.col(c) > 0, F.concat(F.col(c), F.lit(f" {c[2:].replace('_', ' ')}s"))) for c in many]
    hidden = F.when(F.col("visibility") != "visible", F.col("visibility"))
    summary = counted.join(order, ["path", "sheet"]).select("path", at(1).alias("ordinal"), F.concat_ws("; ", size, hidden, *there, F.nullif("settings", F.lit(""))).alias("content"))
    notes = sheets.annotations(found.where(parser_of(F.col("path")) == "excel")).where("content <> ''").groupBy("path", "sheet").agg(ordered_concat(F.concat_ws(": ", "kind", "content"), F.struct("kind", "content"), "\n").alias("text"))
    notes = notes.join(order, ["path", "sheet"], "left").select("path", at(3).alias("ordinal"), F.concat(F.lit("Annotations of "), F.coalesce(F.nullif("sheet", F.lit("")), F.lit("the workbook")), F.lit("\n"), F.col("text")).alias("content"))
    said = F.concat_ws("\n", F.concat(F.col("formula_count"), F.lit(" formulas, "), F.col("cross_sheet_count"), F.lit(" to other sheets")), "formulas")
    formulas = sheets.formulas(found).select("path", F.lit(4 * BESIDE).alias("ordinal"), said.alias("content"))
    shown = lambda c: text_files.plain_number(F.col(c), F.col(c) == F.floor(c))
    head = F.coalesce("header", sheets.column_letters(F.col("col")))
    line = F.concat(F.lit("  "), head, F.lit(":"), *[x for c in ("n", "total", "mean", "low", "high") for x in (F.lit(f" {c}="), shown(c))])
    columns = sheets.column_statistics(found).groupBy("path", "sheet").agg(ordered_concat(line, F.col("col"), "\n").alias("text"))
    statistics = columns.join(order, ["path", "sheet"]).select("path", at(2).alias("ordinal"), F.concat(F.lit("Statistics of "), "sheet", F.lit("\n"), "text").alias("content"))
    return summary.unionByName(statistics).unionByName(notes).unionByName(formulas)


def parse_files(files: DataFrame, parsers: tuple[str, ...] = PARSERS) -> DataFrame:
    """(path, ordinal, content) of files(path, content) of the text and Office parsers.

    CSV and TSV give a row a record (the whole text where there is none), JSON lists a row
    a record (the whole text where it does not parse), workbooks a row a sheet row, slides a row a
    slide, Word files a row a section; other texts are whole.  After these come a JSON list's
    or a CSV text's summary, a log's issues, and what workbooks (workbook_notes) and Word
    files (_beside) hold besides.  PDF and images need a provider's pages.  parsers: those
    that the files can need; a plan for fewer is much smaller, and files of others give
    nothing; ``rejected`` names those of no parser.
    """
    files = files.withColumn("parser", parser_of(F.col("path"))).withColumn("ext", extension(F.col("path")))
    parts = [_text_rows(files)] if "text" in parsers else []
    return reduce(DataFrame.unionByName, parts + _office_rows(files, [p for p in parsers if p != "text"])).where(F.col("content").rlike(r"\S"))


def _office_rows(files: DataFrame, parsers: list[str]) -> list[DataFrame]:
    """Written tables (path, ordinal, content) of Office files: each is planned by itself, and files are opened once for all that is made of them."""
    if not parsers:
        return []
    keep = lambda df: written(df, new_folder(files.sparkSession, "parsed"))
    found = keep(ooxml.facts(files.where(F.col("parser").isin(parsers))))
    parts = []
    if "excel" in parsers:
        kinds = {r["kind"] for r in found.select("kind").distinct().collect()}  # of facts: some twenty
        found.cells_of_these = keep(sheets.cells(found))  # what cells show is worked out once for all that is made of it
        book = keep(sheets.row_documents(found, kinds)).join(found.where("kind = 'sheet'").select("path", F.col("part").alias("sheet"), "part_no"), ["path", "sheet"])
        rows = book.select("path", (F.col("part_no").cast("long") * 2**21 + F.col("row")).alias("ordinal"), "content")
        unread = found.where("kind = 'error'").where(extension(F.col("path")) == ".xls")
        said = F.lit("This workbook of the older binary format is not available as text.")
        parts += [rows, keep(workbook_notes(found)), unread.select("path", F.lit(1).cast("long").alias("ordinal"), said.alias("content"))]
    if "pptx" in parsers:
        parts.append(keep(pages.slide_documents(found).select("path", F.col("slide").cast("long").alias("ordinal"), "content")))
    if "word" in parsers:
        words = pages.word_sections(found).select("path", F.col("section_index").cast("long").alias("ordinal"), "content")
        parts += [keep(words), keep(_beside(found.where(parser_of(F.col("path")) == "word")))]
    return parts


def rejected(files: DataFrame) -> DataFrame:
    """(path, error) of files that no parser takes, with the types that are taken."""
    known = ", ".join(supported_types())
    named = F.coalesce(F.nullif(extension(F.col("path")), F.lit("")), F.lit("none"))
    return files.where(parser_of(F.col("path")).isNull()).select("path", F.concat(F.lit("Unsupported file type: "), named, F.lit(f". Supported: {known}")).alias("error"))


def _text_rows(files: DataFrame) -> DataFrame:
    """(path, ordinal, content) of text files.

    Texts are decoded once, into a written table; only the types that it holds are planned for.
    """
    decoded = files.where("parser = 'text'").select("path", "ext", text_files.decode_text("content").alias("text"))
    texts = written(decoded, new_folder(files.sparkSession, "texts"))
    there = {r["ext"] for r in texts.select("ext").distinct().collect()}  # of the types that parsers take: a few
    again = F.lit(BESIDE).alias("ordinal")
    shown, is_list = F.col("text"), F.lit(False)
    parts = []
    if there & {".csv", ".tsv"}:
        tables = texts.where(F.col("ext").isin(".csv", ".tsv")).select("path", "ext", "text")
        parts += [each_row(tables, _csv_rows, DOCS), text_files.csv_summaries(tables).select("path", again, "content")]
    if ".json" in there:
        parses = F.from_json("text", "array<string>").isNotNull() & text_files.pretty_json("text")["parse_error"].isNull()
        is_list = F.coalesce((F.col("ext") == ".json") & F.ltrim("text").startswith("[") & parses, F.lit(False))
        lists = texts.where(is_list)
        parts += [text_files.json_records(lists, text="text").select("path", F.col("record").cast("long").alias("ordinal"), "content"), text_files.json_summaries(lists, text="text").select("path", again, "content")]
        shown = F.when(F.col("ext") == ".json", text_files.pretty_json("text")["content"]).otherwise(shown)
    if ".xml" in there:
        shown = F.when(F.col("ext") == ".xml", text_files.xml_tree("text")["content"]).otherwise(shown)
    if there & {".html", ".htm"}:
        shown = F.when(F.col("ext").isin(".html", ".htm"), html_text(F.col("text"))).otherwise(shown)
    if ".log" in there:
        parts.append(text_files.log_documents(texts.where("ext = '.log'"), text="text").select("path", again, "content"))
    whole = texts.where(~F.col("ext").isin(".csv", ".tsv") & ~is_list).select("path", F.lit(1).cast("long").alias("ordinal"), shown.alias("content"))
    return reduce(DataFrame.unionByName, parts, whole)


def ingest(files: DataFrame, user_id: str, embed: Callable[[Column], Column] | None = None, size: int = SIZE, overlap: int = OVERLAP, parsers: tuple[str, ...] = PARSERS) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of files(path, content): what is not one row a record already is split.

    Ids are hashes of user and path, so that the same file gets the same id again.
    embed: an expression over the contents, such as a pandas UDF.
    """
    parsed = parse_files(files, parsers)
    ready = parsed.where(already_chunked(F.col("path"))).select("path", "ordinal", F.lit(0).alias("part"), "content")
    rest = parsed.where(~already_chunked(F.col("path"))).withColumn("key", F.to_json(F.struct("path", "ordinal")))
    split = chunk_documents(rest, key="key", text="content", size=size, overlap=overlap)
    at = F.from_json("key", "path string, ordinal long")
    split = split.select(at["path"].alias("path"), at["ordinal"].alias("ordinal"), F.col("chunk_index").alias("part"), "content")
    document_id = F.sha2(F.concat_ws("\n", F.lit(user_id), F.col("path")), 256)
    index = F.row_number().over(Window.partitionBy("path").orderBy("ordinal", "part")) - 1
    name = F.element_at(F.split("path", "/"), -1)
    chunks = ready.unionByName(split).withColumn("chunk_index", index.cast("int")).select(
        F.concat_ws("-", document_id, "chunk_index").alias("id"), document_id.alias("document_id"), F.lit(user_id).alias("user_id"), "content",
        (embed(F.col("content")) if embed else F.lit(None).cast("array<float>")).alias("embedding"), "chunk_index",
        F.create_map(F.lit("filename"), name, F.lit("chunk_index"), F.col("chunk_index").cast("string")).alias("chunk_metadata"), F.localtimestamp().alias("created_at"),
    )
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias("chunk_count"))
    documents = files.where(parser_of(F.col("path")).isNotNull()).select(
        document_id.alias("id"), F.lit(user_id).alias("user_id"), name.alias("filename"), extension(F.col("path")).alias("file_type"), F.col("path").alias("file_path"), F.length("content").alias("file_size"), F.localtimestamp().alias("created_at"),
    )
    return documents.join(counts, "id", "left").na.fill(0, ["chunk_count"]), chunks
