"""Recursive character splitting of texts into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, OVERLAP = 800, 100
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Parts of a text, each but the first with its separator in front; single characters for none."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *(separator + r for r in rest)] if p]


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most size characters.

    The first separator that occurs cuts the text; parts are joined again while they fit,
    a new chunk starting with parts of the last one's end, at most overlap long; parts that
    are too long are cut by the separators after it.
    """
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    chunks: list[str] = []
    window: list[str] = []
    held = 0

    def emit() -> None:
        if chunk := "".join(window).strip():
            chunks.append(chunk)

    for piece in _pieces(text, separators[at]):
        if len(piece) >= size and separators[at]:
            emit()
            window, held = [], 0
            chunks += split_text(piece, size, overlap, separators[at + 1 :]) if at + 1 < len(separators) else [piece]
            continue
        if held + len(piece) > size and window:
            emit()
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.pop(0))
        window.append(piece)
        held += len(piece)
    emit()
    return chunks


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index from 0, content) of every document; null and blank texts have no chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[[key]].assign(content=[split_text(t, size, overlap) for t in pdf[text]])
            yield out

    kind = dict(docs.dtypes)[key]
    lists = docs.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, content array<string>")
    return lists.select(key, F.posexplode("content").alias("chunk_index", "content"))


@F.udtf(returnType="chunk_index int, content string", useArrow=True)
class SplitText:
    """Rows of a text's chunks, for LATERAL joins in SQL: split_text(text, size, overlap).  Null and blank texts have none."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(split_text(text, size, overlap))


def register(spark: SparkSession) -> None:
    """Makes split_text known to SQL."""
    spark.udtf.register("split_text", SplitText)


def lateral_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """chunk_documents by a lateral join: a text's chunks leave row by row, and other columns need not be read."""
    rows = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"))
    return rows.lateralJoin(SplitText(F.col("_text").outer(), F.lit(size), F.lit(overlap))).select(key, "chunk_index", "content")
