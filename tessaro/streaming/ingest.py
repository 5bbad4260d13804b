"""Continuous ingest: new files in a folder become documents and chunks.  An extension; every batch is the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessaro.operators import ingest
from tessaro.operators.chunking import chunk_documents
from tessaro.operators.database import Database
from tessaro.sources.routing import parser_of
from tessaro.sources.text_files import decode_text

_FILES = "path string, modificationTime timestamp, length long, content binary"


def file_chunks(files: DataFrame) -> DataFrame:
    """(path, chunk_index, content) of text files; files of other parsers are left to theirs."""
    texts = files.where(parser_of(F.col("path")) == "text").select("path", decode_text("content").alias("text"))
    return chunk_documents(texts, key="path", text="text")


def stream_chunks(spark: SparkSession, folder: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Chunks of text files alone, as Parquet; what was read is kept in the checkpoint."""
    files = spark.readStream.schema(_FILES).format("binaryFile").load(folder)
    writer = file_chunks(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def commit_files(database: Database, files: DataFrame, user_id: str, batch: tuple[str, int] | None = None, embed: Callable[[Column], Column] | None = None, parsers: tuple[str, ...] = ingest.PARSERS) -> None:
    """Ingests files(path, content) into documents and document_chunks as one change; a file that comes again replaces what it gave before.

    A batch that is committed already changes nothing.
    """
    if batch and database.has_batch(*batch):
        return
    documents, chunks = ingest.ingest(files, user_id, embed, parsers=parsers)
    with database.change(batch) as change:
        if "document_chunks" in change.state["tables"]:
            gone = documents.selectExpr("user_id", "id as document_id")
            change.delete("document_chunks", gone)
        change.append("document_chunks", chunks)
        change.replace("documents", documents)


def stream_files(spark: SparkSession, folder: str, database: Database, checkpoint: str, user_id: str, name: str = "files", **options) -> StreamingQuery:
    """Every file of a folder once, with all parsers, as they come (options: trigger arguments, max_files a batch, and those of commit_files).

    A batch's number is committed with its rows: one that stopped before its commit is
    done again, one that stopped after it is skipped, so restarts neither lose nor repeat.
    """
    source = spark.readStream.schema(_FILES).format("binaryFile").option("recursiveFileLookup", "true")
    if most := options.pop("max_files", None):
        source = source.option("maxFilesPerTrigger", most)
    known = {k: options.pop(k) for k in ("embed", "parsers") if k in options}

    def commit(files: DataFrame, number: int) -> None:
        commit_files(database, files.select("path", "content"), user_id, (name, number), **known)

    writer = source.load(folder).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return writer.trigger(**(options or {"availableNow": True})).start()
