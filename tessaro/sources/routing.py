"""Which parser a file goes to, by its extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parsers by extension.
PARSERS = {
    "excel": (".xlsx", ".xls", ".xlsm"),
    "text": (".csv", ".tsv", ".txt", ".md", ".json", ".xml", ".html", ".htm", ".log"),
    "pdf": (".pdf",),
    "word": (".docx", ".doc"),
    "pptx": (".pptx", ".ppt"),
    "image": (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".tif", ".webp"),
}
# Whose parsers give one row a record, page or slide already.  .tif is not among them.
CHUNKED = (".xlsx", ".xls", ".xlsm", ".csv", ".tsv", ".pptx", ".ppt", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".webp")
#: Parsers that need libraries or models which callers supply.
PROVIDED = ("pdf", "image")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))


def parser_of(path: Column) -> Column:
    """The parser's name; null for unknown types."""
    ext, out = extension(path), F.lit(None).cast("string")
    for name, extensions in PARSERS.items():
        out = F.when(ext.isin(*extensions), name).otherwise(out)
    return out


def already_chunked(path: Column) -> Column:
    return extension(path).isin(*CHUNKED)


def supported_types() -> list[str]:
    return sorted(e for es in PARSERS.values() for e in es)


def parser_info() -> list[tuple[str, list[str], bool]]:
    """(parser, extensions, whether it runs without a supplied provider)."""
    return [(name, sorted(es), name not in PROVIDED) for name, es in PARSERS.items()]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: path, content and parser; unknown types raise, with the types there are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("parser", parser_of(F.col("path")))
    unknown = F.raise_error(F.concat(F.lit(f"unsupported type, expected one of {', '.join(supported_types())}: "), F.col("path")))
    return files.select("path", "content", F.coalesce("parser", unknown).alias("parser"))
