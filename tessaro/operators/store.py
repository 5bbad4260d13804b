"""The service's tables as immutable DataFrames: changes return new ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaro.functions.text import session_title

SCHEMAS = {
    "users": "id string, email string, created_at timestamp_ntz",
    "documents": "id string, user_id string, filename string, file_type string, file_path string, file_size int, chunk_count int, doc_metadata map<string,string>, created_at timestamp_ntz",
    "document_chunks": "id string, document_id string, user_id string, content string, embedding array<float>, chunk_index int, chunk_metadata map<string,string>, created_at timestamp_ntz",
    "chat_sessions": "id string, user_id string, title string, document_ids array<string>, created_at timestamp_ntz, updated_at timestamp_ntz",
    "chat_messages": "id string, session_id string, role string, content string, sources array<string>, created_at timestamp_ntz",
}
NEW_TITLE = "New Chat"


def create_tables(spark: SparkSession, database: str) -> None:
    """Drops and creates the five tables as Parquet, with the default user."""
    spark.sql(f"create database if not exists {database}")
    for name, schema in SCHEMAS.items():
        spark.sql(f"drop table if exists {database}.{name}")
        spark.sql(f"create table {database}.{name} ({schema}) using parquet")
    spark.sql(f"insert into {database}.users values ('default', 'default@local', localtimestamp())")


def append_chunks(chunks: DataFrame, document_id: str, user_id: str, filename: str) -> DataFrame:
    """Rows of document_chunks for (ordinal, content[, embedding]) in order: index from 0, metadata stamped."""
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy(F.lit(document_id)).orderBy("ordinal")) - 1  # one document's chunks
    embedding = F.col("embedding") if "embedding" in chunks.columns else F.lit(None).cast("array<float>")
    meta = F.create_map(F.lit("filename"), F.lit(filename), F.lit("document_id"), F.lit(document_id), F.lit("chunk_index"), F.col("chunk_index").cast("string"))
    rows = chunks.select("content", embedding.alias("embedding"), index.cast("int").alias("chunk_index"))
    return rows.select(
        F.concat(F.lit(f"{document_id}-"), F.col("chunk_index").cast("string")).alias("id"), F.lit(document_id).alias("document_id"), F.lit(user_id).alias("user_id"),
        "content", "embedding", "chunk_index", meta.alias("chunk_metadata"), F.localtimestamp().alias("created_at"),
    )


def without(rows: DataFrame, gone: DataFrame, **keys: str) -> DataFrame:
    """rows none of whose keys (row column = gone's column) is in gone; rows with null keys stay."""
    named = gone.select(*[F.col(v).alias(f"_gone_{k}") for k, v in keys.items()]).distinct()
    same = [rows[k] == F.col(f"_gone_{k}") for k in keys]
    return rows.join(named, same, "left_anti")


def delete_documents(documents: DataFrame, chunks: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """documents and chunks after deleting documents, chunks with them, by (user, document)."""
    gone = documents.where(which).select("user_id", "id")
    kept = documents.where(~F.coalesce(which, F.lit(False)))
    return kept, without(chunks, gone, user_id="user_id", document_id="id")


def create_session(sessions: DataFrame, session_id: str, user_id: str, document_ids: list[str] | None = None, title: str = NEW_TITLE) -> DataFrame:
    """sessions with a new one; ids as a set, in order."""
    ids = F.array_sort(F.array_distinct(F.array(*map(F.lit, document_ids or [])).cast("array<string>")))
    values = {"id": F.lit(session_id), "user_id": F.lit(user_id), "title": F.lit(title), "document_ids": ids, "created_at": F.localtimestamp(), "updated_at": F.localtimestamp()}
    kinds = dict(sessions.dtypes)
    row = sessions.sparkSession.range(1).select(*[values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in sessions.columns])
    return sessions.unionByName(row)


def append_messages(sessions: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) after new messages (id, session_id, role, content, sources, created_at) of existing sessions.

    A session's updated_at becomes that of its last message, if it is later; one still called as new gets
    its title.  Messages of unknown sessions are dropped.
    """
    kept = new.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi").select(*messages.columns)
    all_messages = messages.unionByName(kept)
    last = kept.groupBy(F.col("session_id").alias("_session")).agg(F.max("created_at").alias("_last"))
    touched = sessions.join(last, sessions["id"] == F.col("_session"), "left").withColumn("updated_at", F.greatest("updated_at", "_last")).select(*sessions.columns)
    return title_from_first_question(touched, all_messages), all_messages


def list_documents(documents: DataFrame, user_id: str) -> DataFrame:
    """A user's documents, the newest first."""
    return documents.where(F.col("user_id") == user_id).orderBy(F.desc_nulls_last("created_at"), "id")


def delete_sessions(sessions: DataFrame, messages: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    return sessions.where(~F.coalesce(which, F.lit(False))), without(messages, sessions.where(which).select("id"), session_id="id")


def rename_session(sessions: DataFrame, which: Column, title: str) -> DataFrame:
    return sessions.withColumn("title", F.when(which, F.lit(title)).otherwise(F.col("title")))


def add_documents(sessions: DataFrame, which: Column, ids: list[str]) -> DataFrame:
    joined = F.array_sort(F.array_union("document_ids", F.array(*map(F.lit, ids)).cast("array<string>")))
    return sessions.withColumn("document_ids", F.when(which, joined).otherwise(F.col("document_ids")))


def remove_documents(sessions: DataFrame, which: Column, ids: list[str]) -> DataFrame:
    left = F.array_sort(F.array_except("document_ids", F.array(*map(F.lit, ids)).cast("array<string>")))
    return sessions.withColumn("document_ids", F.when(which, left).otherwise(F.col("document_ids")))


def title_from_first_question(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions still called as new get their first user message, cut to 50 characters, as title."""
    first = messages.where("role = 'user'").groupBy(F.col("session_id").alias("_session")).agg(F.min_by("content", F.struct("created_at", "id")).alias("_first"))
    joined = sessions.join(first, sessions["id"] == F.col("_session"), "left")
    title = F.when((F.col("title") == NEW_TITLE) & F.col("_first").isNotNull(), session_title(F.col("_first"))).otherwise(F.col("title"))
    return joined.withColumn("title", title).select(*sessions.columns)


def session_documents(sessions: DataFrame, documents: DataFrame) -> DataFrame:
    """(session_id, document_id, filename) of every session's documents that exist and are its user's."""
    listed = sessions.select(F.col("id").alias("session_id"), "user_id", F.explode("document_ids").alias("document_id"))
    return listed.join(documents.select(F.col("id").alias("document_id"), "user_id", "filename"), ["document_id", "user_id"]).select("session_id", "document_id", "filename")


def reembed(documents: DataFrame, chunks: DataFrame, files: DataFrame, embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """All chunks again with new vectors, and documents with their counts; documents without a file get no chunks and status missing.

    files: (file_path); embed: an expression, such as a pandas UDF, over the contents.
    Documents and chunks belong together by user and document.
    """
    there = documents.join(files.select("file_path").distinct().withColumn("found", F.lit(True)), "file_path", "left")
    owned = there.where("found").select(F.col("id").alias("document_id"), "user_id").distinct()
    renewed = chunks.join(owned, ["document_id", "user_id"], "left_semi").withColumn("embedding", embed(F.col("content")))
    counts = renewed.groupBy(F.col("document_id").alias("_doc"), F.col("user_id").alias("_user")).agg(F.count("*").cast("int").alias("_n"))
    status = F.when(F.col("found"), "ok").otherwise("missing").alias("status")
    out = there.join(counts, (there["id"] == F.col("_doc")) & (there["user_id"] == F.col("_user")), "left")
    return renewed.select(*chunks.columns), out.select(*[c for c in documents.columns if c != "chunk_count"], F.coalesce("_n", F.lit(0)).alias("chunk_count"), status)


def reingest(documents: DataFrame, files: DataFrame, embed: Callable[[Column], Column] | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, counts) of a migration: files(path, content) parsed, split and embedded again for their documents.

    documents get chunk_count and status: ok, empty (no text in the file) or missing (no
    file); counts has one row a status.  Chunks keep their documents' ids and users.  options
    are those of ingest.
    """
    from tessaro.operators.ingest import ingest

    _, made = ingest(files, "", embed, **options)
    paths = files.select(F.col("path").alias("file_path"), F.sha2(F.concat(F.lit("\n"), F.col("path")), 256).alias("_made")).distinct()
    owned = documents.join(paths, "file_path", "left")
    fresh = made.withColumnsRenamed({"document_id": "_made", "user_id": "_nobody"}).join(owned.select("_made", F.col("id").alias("document_id"), "user_id"), "_made")
    chunks = fresh.withColumn("id", F.concat_ws("-", "document_id", "chunk_index")).select("id", "document_id", "user_id", "content", "embedding", "chunk_index", "chunk_metadata")
    per = chunks.groupBy("document_id", "user_id").agg(F.count("*").cast("int").alias("chunk_count"))
    status = F.when(F.col("_made").isNull(), "missing").when(F.col("chunk_count").isNull(), "empty").otherwise("ok").alias("status")
    joined = owned.drop("chunk_count").join(per, (owned["id"] == per["document_id"]) & (owned["user_id"] == per["user_id"]), "left").drop(per["document_id"], per["user_id"])
    out = joined.select(*[c for c in documents.columns if c != "chunk_count"], F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), status)
    return out, chunks, out.groupBy("status").agg(F.count("*").alias("n_documents"))
