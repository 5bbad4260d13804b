"""Changes that are committed to files, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaro.operators.database import Database
from tessaro.plans.catalog import query
from tessaro.session import table
from tessaro.sources.shared import new_folder


def _stored(spark, sf_dir) -> Database:
    """Documents as chunks of a document each; then poor ones are deleted and toxic ones replaced, as one change."""
    docs = table(spark, sf_dir, "documents")
    user, key = F.concat(F.lit("u"), F.col("doc_id") % 5).alias("user_id"), F.col("doc_id").cast("string").alias("document_id")
    chunks = docs.select(user, key, F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    labels = table(spark, sf_dir, "labels")
    database = Database(spark, new_folder(spark, "database"))
    with database.change() as change:
        change.append("document_chunks", chunks)
    with database.change() as change:
        change.replace("document_chunks", labels.where("toxic = 1").select(user, key, F.lit(0).alias("chunk_index"), F.lit("[removed]").alias("content")))
        change.delete("document_chunks", labels.where("quality = 0").select(user, key))
    return database


_FINAL = """(SELECT d.doc_id, CASE WHEN t.doc_id IS NULL THEN d.text ELSE '[removed]' END AS content FROM documents d
    LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) t ON t.doc_id = d.doc_id WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))"""


@query(f"SELECT doc_id::VARCHAR AS document_id, 'u' || (doc_id % 5) AS user_id, md5(content) AS content_md5 FROM {_FINAL}")
def committed_chunks(spark, sf_dir):
    return _stored(spark, sf_dir).read("document_chunks").select("document_id", "user_id", F.md5("content").alias("content_md5"))


@query(f"""SELECT 1 AS version, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM documents
    UNION ALL SELECT 2, count(*), sum(length(content))::BIGINT FROM {_FINAL}""")
def committed_versions(spark, sf_dir):
    """A version stays as it was: a reader of the first sees nothing of the second."""
    database = _stored(spark, sf_dir)
    rows: list[DataFrame] = []
    for version in database.versions():
        sums = database.read("document_chunks", version).agg(F.count("*").alias("n_rows"), F.sum(F.length("content")).alias("n_chars"))
        rows.append(sums.select(F.lit(version).alias("version"), "n_rows", "n_chars"))
    return rows[0].unionByName(rows[1])


@query("""SELECT conv_id::VARCHAR AS session_id, count(*) AS n_messages, max(turn) AS last_turn, md5(string_agg(text, chr(10) ORDER BY turn)) AS contents_md5
    FROM conversations WHERE conv_id % 10 <> 3 GROUP BY 1""")
def committed_messages(spark, sf_dir):
    """Messages appended in two commits, then some sessions deleted with theirs."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role", F.col("text").alias("content"))
    database = Database(spark, new_folder(spark, "database"))
    for part in (F.col("turn") % 2 == 0, F.col("turn") % 2 == 1):
        with database.change() as change:
            change.append("chat_messages", rows.where(part))
    with database.change() as change:
        change.delete("chat_messages", rows.where("cast(session_id as long) % 10 = 3").select("session_id"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda m: m["content"]), "\n")
    return database.read("chat_messages").groupBy("session_id").agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"), F.md5(ordered).alias("contents_md5"))
