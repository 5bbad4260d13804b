"""Changes to the service's tables, over conversations as sessions and sources as documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaro.operators import context, store
from tessaro.plans.catalog import query
from tessaro.session import table
from tessaro.sources.routing import already_chunked, parser_of


def sessions(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    made = conv.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("document_ids"), F.max("turn").alias("last"))
    return made.select(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("u"), (F.col("conv_id") % 3).cast("string")).alias("user_id"),
                       F.lit(store.NEW_TITLE).alias("title"), "document_ids", "last")


def messages(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return conv.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"), F.col("turn").alias("created_at"))


_S = "s AS (SELECT conv_id, 'u' || (conv_id % 3) AS user_id, list_sort(list_distinct(list(role))) AS ids, max(turn) AS last FROM conversations GROUP BY conv_id)"


@query(f"WITH {_S} SELECT conv_id::VARCHAR AS id, array_to_string(CASE WHEN user_id = 'u1' THEN list_sort(list_distinct(list_concat(ids, ['extra', 'user']))) ELSE ids END, ',') AS document_ids FROM s")
def session_add_docs(spark, sf_dir):
    out = store.add_documents(sessions(spark, sf_dir), F.col("user_id") == "u1", ["extra", "user"])
    return out.select("id", F.array_join("document_ids", ",").alias("document_ids"))


@query(f"WITH {_S} SELECT conv_id::VARCHAR AS id, array_to_string(CASE WHEN user_id = 'u1' THEN list_filter(ids, lambda x: x NOT IN ('system', 'user')) ELSE ids END, ',') AS document_ids FROM s")
def session_remove_docs(spark, sf_dir):
    out = store.remove_documents(sessions(spark, sf_dir), F.col("user_id") == "u1", ["system", "user"])
    return out.select("id", F.array_join("document_ids", ",").alias("document_ids"))


@query(f"WITH {_S} SELECT conv_id::VARCHAR AS id, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, conv_id::VARCHAR)::INT AS position FROM s")
def session_list(spark, sf_dir):
    listed = context.numbered(sessions(spark, sf_dir), ["user_id"], -F.col("last"), [F.col("id")])
    return listed.select("id", F.col("position").cast("int").alias("position"))


@query("""WITH f AS (SELECT conv_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY 1)
    SELECT DISTINCT c.conv_id::VARCHAR AS id, CASE WHEN q IS NULL THEN 'New Chat' ELSE substring(q, 1, 50) || CASE WHEN length(q) > 50 THEN '...' ELSE '' END END AS title
    FROM conversations c LEFT JOIN f ON f.conv_id = c.conv_id""")
def session_titles(spark, sf_dir):
    return store.title_from_first_question(sessions(spark, sf_dir), messages(spark, sf_dir)).select("id", "title")


@query("SELECT conv_id || '-' || turn AS id FROM conversations WHERE conv_id % 3 <> 2")
def delete_cascade(spark, sf_dir):
    """Messages left after the sessions of one user are deleted."""
    return store.delete_sessions(sessions(spark, sf_dir), messages(spark, sf_dir), F.col("user_id") == "u2")[1].select("id")


@query("SELECT doc_id::VARCHAR AS id FROM documents WHERE NOT (source = 'src1' AND lang = 'en')")
def delete_document_chunks(spark, sf_dir):
    """Chunks (documents here) left after a document of a user (source of a language) is deleted."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("document_id"), F.col("lang").alias("user_id"))
    documents = docs.select(F.col("source").alias("id"), F.col("lang").alias("user_id")).distinct()
    return store.delete_documents(documents, chunks, (F.col("user_id") == "en") & (F.col("id") == "src1"))[1].select("id")


@query(f"WITH {_S} SELECT s.conv_id::VARCHAR AS session_id, r AS document_id FROM (SELECT conv_id, unnest(ids) AS r FROM s) s WHERE r IN ('user', 'assistant')")
def session_documents(spark, sf_dir):
    documents = sessions(spark, sf_dir).select("user_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([("user",), ("assistant",)], "id string"))).withColumn("filename", F.col("id"))
    return store.session_documents(sessions(spark, sf_dir), documents).select("session_id", "document_id")


@query("""WITH p AS (SELECT page_id, 'dir.x/file' || (['.XLSX', '.tif', '.tiff', '.md', '.docx', '.zzz', ''])[(page_id % 7 + 1)::INT] AS path FROM pages)
    SELECT page_id, path, CASE (page_id % 7)::INT WHEN 0 THEN 'excel' WHEN 1 THEN 'image' WHEN 2 THEN 'image' WHEN 3 THEN 'text' WHEN 4 THEN 'word' END AS parser,
    page_id % 7 IN (0, 2) AS chunked FROM p""")
def type_routing(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in (".XLSX", ".tif", ".tiff", ".md", ".docx", ".zzz", "")])
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("dir.x/file"), F.element_at(names, (F.col("page_id") % 7 + 1).cast("int"))).alias("path"))
    return pages.select("page_id", "path", parser_of(F.col("path")).alias("parser"), already_chunked(F.col("path")).alias("chunked"))
