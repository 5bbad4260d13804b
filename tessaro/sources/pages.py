"""Word documents, slides and the pages of providers: sections, texts and modes from facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaro.operators.context import ordered_concat

PAGE_CHARS, IMAGE_BYTES, IMAGE_CHARS = 100, 1000, 10
VECTOR_IMAGES = r"(?i)\.(emf|wmf)$"


def _bold_marked(flags: Column, text: Column) -> Column:
    """Runs joined, bold ones between stars where there is more than one run."""
    runs = F.split(flags, "\x1f")
    said = F.transform(runs, lambda r: F.when(r.startswith("b") & (F.trim(F.substring(r, 2, 10**6)) != ""), F.concat(F.lit("**"), F.substring(r, 2, 10**6), F.lit("**"))).otherwise(F.substring(r, 2, 10**6)))
    return F.when(F.size(runs) > 1, F.array_join(said, "")).otherwise(text)


def word_sections(facts: DataFrame) -> DataFrame:
    """(path, section_index, section, content): a section starts at each heading or title, its level as number signs."""
    body = facts.where("kind = 'paragraph' and trim(text) <> ''")
    is_heading = F.lower(F.coalesce("name", F.lit(""))).rlike("heading|title")
    level = F.coalesce(F.nullif(F.regexp_extract("name", r"(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    line = F.when(is_heading, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.trim("text"))).otherwise(_bold_marked(F.col("flags"), F.col("text")))
    ordered = Window.partitionBy("path").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    rows = body.withColumn("line", line).withColumn("section_index", F.sum(is_heading.cast("int")).over(ordered)).withColumn("title", F.when(is_heading, F.trim("text")))
    return rows.groupBy("path", "section_index").agg(F.max("title").alias("section"), ordered_concat(F.col("line"), F.col("a"), "\n").alias("content"))


def table_texts(facts: DataFrame) -> DataFrame:
    """(path, part_no, content): rows of a Word table joined by lines; blank rows are left out."""
    rows = facts.where("kind = 'table_row' and part = 'table'").where(F.col("text").rlike(r"[^\s|]"))
    return rows.groupBy("path", "part_no").agg(ordered_concat(F.col("text"), F.col("a"), "\n").alias("content"))


def notes(facts: DataFrame) -> DataFrame:
    """(path, kind, content): footnotes, endnotes (separators left out), comments, headers and footers, and links, in order."""
    kept = facts.where("kind in ('footnote', 'endnote', 'comment', 'header', 'footer', 'hyperlink') and part <> 'slide' and trim(text) <> ''")
    kept = kept.where("kind not in ('footnote', 'endnote') or a not in (-1, 0)")
    said = (
        F.when(F.col("kind") == "comment", F.concat(F.coalesce("name", F.lit("")), F.lit(" ("), F.coalesce("flags", F.lit("")), F.lit("): "), F.col("text")))
        .when(F.col("kind") == "hyperlink", F.concat("text", F.lit(" -> "), "name"))
        .when(F.col("kind").isin("footnote", "endnote"), F.concat(F.lit("["), F.col("a"), F.lit("] "), F.col("text")))
        .otherwise(F.concat(F.lit("["), F.initcap("kind"), F.lit("] "), F.col("text")))
    )
    first = kept.withColumn("said", said).groupBy("path", "kind", "said").agg(F.min(F.coalesce("a", F.lit(0))).alias("at"))
    return first.groupBy("path", "kind").agg(ordered_concat(F.col("said"), F.struct("at", "said"), "\n").alias("content"))


def slide_documents(facts: DataFrame) -> DataFrame:
    """(path, slide, title, content): texts by size (24 points a heading, 18 or bold marked, else bullets by level), tables, charts, notes, comments.

    The title is the title shape's text, else that of the largest type.
    """
    at = facts.where("part = 'slide'")
    size = F.coalesce("number", F.lit(0.0))
    line = (
        F.when(size >= 24, F.concat(F.lit("## "), F.col("text")))
        .when((size >= 18) | (F.col("flags") == "b"), F.concat(F.lit("**"), F.col("text"), F.lit("**")))
        .otherwise(F.concat(F.repeat(F.lit("  "), F.coalesce("b", F.lit(0))), F.lit("- "), F.col("text")))
    )
    texts = at.where("kind = 'text'")
    title = F.coalesce(F.min_by(F.when(F.col("name") == "title", F.col("text")), F.when(F.col("name") == "title", F.col("a"))), F.max_by("text", F.struct(size, -F.col("a"))))
    titles = texts.groupBy("path", "part_no").agg(title.alias("title"))
    rank = F.when(F.col("kind") == "text", 1).when(F.col("kind") == "table_row", 2).when(F.col("kind") == "chart", 3).when(F.col("kind") == "notes", 4).otherwise(5)
    said = F.when(F.col("kind") == "text", line).when(F.col("kind") == "chart", F.concat_ws(": ", F.nullif("name", F.lit("")), "text")).when(F.col("kind") == "notes", F.concat(F.lit("[Notes] "), F.col("text"))).otherwise(F.col("text"))
    kept = at.where("kind in ('text', 'table_row', 'chart', 'notes', 'comment') and trim(text) <> ''").withColumn("rank", rank).withColumn("said", said)
    blocks = kept.groupBy("path", "part_no", "rank").agg(ordered_concat(F.col("said"), F.struct(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)), "said"), "\n").alias("block"))
    slides = blocks.groupBy("path", "part_no").agg(ordered_concat(F.col("block"), F.col("rank"), "\n\n").alias("content"))
    return slides.join(titles, ["path", "part_no"], "left").select("path", F.col("part_no").alias("slide"), "title", "content")


def page_text(pages: DataFrame) -> DataFrame:
    """Pages from a provider (path, page, text, ocr_text, tables array<array<array<string>>>) with content and extraction_mode.

    Text of 100 characters or more is taken as it is, else recognized text, else what
    there is; tables follow, blank rows left out.
    """
    text, ocr = F.trim(F.coalesce("text", F.lit(""))), F.trim(F.coalesce("ocr_text", F.lit("")))
    mode = F.when(F.length(text) >= PAGE_CHARS, "text").when(ocr != "", "ocr").otherwise("text_partial")
    row = lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")
    filled = lambda t: F.filter(t, lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    tables = F.transform(F.coalesce("tables", F.array().cast("array<array<array<string>>>")), lambda t, i: F.concat(F.lit("[Table "), i + 1, F.lit("]\n"), F.array_join(F.transform(filled(t), row), "\n")))
    chosen = F.when(mode == "text", text).when(mode == "ocr", ocr).otherwise(text)
    content = F.array_join(F.filter(F.concat(F.array(chosen), tables), lambda x: x != ""), "\n\n")
    return pages.select(*[c for c in pages.columns], content.alias("content"), F.when((mode == "text") & (F.size(tables) > 0), "text+tables").otherwise(mode).alias("extraction_mode"))


def readable_images(images: DataFrame) -> DataFrame:
    """Images worth recognizing: of a thousand bytes or more, and no vector formats (name, number = bytes)."""
    return images.where((F.col("number") >= IMAGE_BYTES) & ~F.col("name").rlike(VECTOR_IMAGES))


def image_documents(readings: DataFrame) -> DataFrame:
    """Recognized images (with content) that say something: more than ten characters."""
    return readings.where(F.length(F.trim("content")) > IMAGE_CHARS)


def longest_reading(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Of several recognized texts (strategy_no, text) the longest cleaned one; of equal ones the first."""
    from tessaro.functions.text import clean_ocr, confidence

    cleaned = readings.withColumn("clean", clean_ocr(F.coalesce("text", F.lit(""))))
    best = cleaned.groupBy(*keys).agg(F.max_by("clean", F.struct(F.length("clean"), -F.col("strategy_no"))).alias("content"))
    return best.withColumn("confidence", confidence(F.col("content")))
