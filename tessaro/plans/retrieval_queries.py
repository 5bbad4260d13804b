"""Retrieval, context and history over documents, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaro.functions import text as tx
from tessaro.operators import chunking, context, retrieval
from tessaro.plans.catalog import query
from tessaro.session import table

#: A question with one word that few documents hold, and the vector that stands for it.
QUESTION, VECTOR_ID = "Where does the clown moron appear?", 7
SCOPE = ("src0", "src3", "src11")

_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_KEYWORDS = f"list_filter(regexp_extract_all(lower('{QUESTION}'), '[\\p{{L}}\\p{{N}}_]{{3,}}'), lambda x: x NOT IN ({_STOP}))[1:5]"
_SCORED = f"""kw AS (SELECT unnest({_KEYWORDS}) AS w),
scored AS (SELECT d.doc_id AS chunk_id, d.source, sum(CASE WHEN contains(lower(d.text), w) THEN 1 ELSE 0 END)::INT AS score
           FROM documents d, kw GROUP BY ALL HAVING bool_or(d.text ILIKE '%' || w || '%'))"""
_NEAR = f"""qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = {VECTOR_ID}),
near AS (SELECT d.doc_id AS chunk_id, d.source, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q) AS distance
         FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, qv)"""


def _legs(scored: str = "scored", near: str = "near") -> str:
    return f"""legs AS (SELECT chunk_id, 0 AS leg, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM {scored} QUALIFY place <= 120
          UNION ALL SELECT chunk_id, 1, row_number() OVER (ORDER BY distance, chunk_id) AS place FROM {near} QUALIFY place <= 40),
one AS (SELECT chunk_id, min((leg, place)) AS first_at FROM legs GROUP BY chunk_id),
hybrid AS (SELECT chunk_id, row_number() OVER (ORDER BY first_at, chunk_id)::INT AS position FROM one QUALIFY position <= 16)"""


def chunks(spark, sf_dir):
    """Documents as chunks of their own, with the vectors of the same number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return docs.join(vectors, "chunk_id", "left")


def plain_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source")


def query_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == VECTOR_ID).select(F.col("embedding").alias("query"))


@query(f"WITH {_SCORED} SELECT chunk_id, score FROM scored ORDER BY score DESC, chunk_id LIMIT 120")
def keyword_search(spark, sf_dir):
    return retrieval.keyword_search(plain_chunks(spark, sf_dir), QUESTION)


@query(
    f"SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{3,}}'), lambda x: x NOT IN ({_STOP}))[1:5], ',') AS keywords FROM benchmark"
)
def question_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tx.keywords(F.col("text")), ",").alias("keywords"))


@query(f"WITH {_NEAR} SELECT chunk_id, round(distance, 6) AS distance FROM (SELECT * FROM near ORDER BY distance, chunk_id LIMIT 40)")
def semantic_topk(spark, sf_dir):
    return retrieval.semantic_search(chunks(spark, sf_dir), query_vector(spark, sf_dir)).select("chunk_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_SCORED}, {_NEAR}, {_legs()} SELECT chunk_id, position FROM hybrid")
def hybrid_search(spark, sf_dir):
    return retrieval.hybrid_search(chunks(spark, sf_dir), QUESTION, query_vector(spark, sf_dir))


@query(
    f"""WITH {_SCORED}, {_NEAR}, {_legs(f"(SELECT * FROM scored WHERE source IN {SCOPE})", f"(SELECT * FROM near WHERE source IN {SCOPE})")}
    SELECT chunk_id, position FROM hybrid"""
)
def scoped_search(spark, sf_dir):
    scoped = retrieval.in_scope(chunks(spark, sf_dir), "source", list(SCOPE))
    return retrieval.hybrid_search(scoped, QUESTION, query_vector(spark, sf_dir))


@query(f"WITH {_SCORED}, {_NEAR}, {_legs()} SELECT chunk_id, position FROM hybrid")
def empty_scope_search(spark, sf_dir):
    return retrieval.hybrid_search(retrieval.in_scope(chunks(spark, sf_dir), "source", []), QUESTION, query_vector(spark, sf_dir))


@query(
    f"""WITH {_SCORED}, {_NEAR}, {_legs().replace("<= 16", "<= 160")},
    ranked AS (SELECT h.chunk_id, row_number() OVER (ORDER BY length(d.text), h.position)::INT AS position FROM hybrid h JOIN documents d ON d.doc_id = h.chunk_id)
    SELECT chunk_id, position FROM ranked WHERE position <= 16"""
)
def rerank_by_scorer(spark, sf_dir):
    """A supplied scorer, here one that likes short texts; it sees the candidates only."""
    shorter = lambda found, _: found.select("chunk_id", (-F.length("content")).alias("relevance"))
    return retrieval.hybrid_search(chunks(spark, sf_dir), QUESTION, query_vector(spark, sf_dir), scorer=shorter)


@query(f"WITH {_SCORED}, {_NEAR}, {_legs()} SELECT d.source, count(*) AS n_results FROM hybrid h JOIN documents d ON d.doc_id = h.chunk_id GROUP BY 1")
def results_per_source(spark, sf_dir):
    return retrieval.results_per_source(hybrid_search(spark, sf_dir), plain_chunks(spark, sf_dir))


@query(
    f"""WITH {_SCORED}, {_NEAR}, {_legs()}, j AS (SELECT h.position, d.source, d.text FROM hybrid h JOIN documents d ON d.doc_id = h.chunk_id)
    SELECT string_agg('[Document ' || position || ': ' || source || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS context,
    array_to_string(list_distinct_ordered, ',') AS sources FROM j,
    (SELECT list(source ORDER BY p) AS list_distinct_ordered FROM (SELECT source, min(position) AS p FROM j GROUP BY 1)) GROUP BY 2"""
)
def retrieval_context(spark, sf_dir):
    out = context.retrieval_context(hybrid_search(spark, sf_dir), plain_chunks(spark, sf_dir))
    return out.select("context", F.array_join("sources", ",").alias("sources"))


def scoped_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), "source", "lang")
    return docs.withColumn("scope", F.col("source"))


@query(
    """WITH t AS (SELECT lang || ':' || source AS scope, string_agg(chr(10) || '--- ' || source || ' ---' || chr(10) || chr(10) || text, chr(10) ORDER BY doc_id) AS x FROM documents GROUP BY 1)
    SELECT scope, length(x) AS n_chars, md5(x) AS text_md5 FROM t WHERE length(x) <= 50000"""
)
def full_context_text(spark, sf_dir):
    docs = scoped_documents(spark, sf_dir).withColumn("scope", F.concat_ws(":", "lang", "source"))
    out = context.full_text(docs, "scope")
    return out.select("scope", F.col("n_chars").cast("long").alias("n_chars"), F.md5("full_text").alias("text_md5"))


@query(
    """WITH t AS (SELECT lang || ':' || source AS scope, sum(length(text) + 1 + length(source) + 11) - 1 AS total_chars FROM documents GROUP BY 1)
    SELECT scope, total_chars::BIGINT AS total_chars, CASE WHEN total_chars <= 50000 THEN 'full_context' ELSE 'retrieval' END AS mode FROM t"""
)
def full_context_mode(spark, sf_dir):
    docs = scoped_documents(spark, sf_dir).drop("scope")
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.concat_ws(":", "lang", "source").alias("scope"))
    return context.context_mode(docs.join(langs, "document_id"), "scope").select("scope", F.col("total_chars").cast("long").alias("total_chars"), "mode")


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS position FROM
    (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6)""")
def chat_history_last_n(spark, sf_dir):
    return context.last_turns(table(spark, sf_dir, "conversations"), 6).select("conv_id", "turn", "role", "position")


@query("""SELECT conv_id, string_agg((CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END) || substring(text, 1, 500), chr(10) ORDER BY turn) AS history FROM
    (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY 1""")
def history_prompt(spark, sf_dir):
    return context.history_text(table(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, substring(q, 1, 50) || CASE WHEN length(q) > 50 THEN '...' ELSE '' END AS title FROM
    (SELECT conv_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY 1)""")
def session_title(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    return first.select("conv_id", tx.session_title(F.col("q")).alias("title"))


@query("SELECT source, count(*) AS n_chunks FROM documents GROUP BY 1")
def chunk_count(spark, sf_dir):
    return context.chunk_counts(table(spark, sf_dir, "documents"), "source")


@query("""SELECT lang, array_to_string(list(source ORDER BY p), ',') AS sources FROM
    (SELECT lang, source, min(doc_id) AS p FROM documents GROUP BY 1, 2) GROUP BY 1""")
def source_dedup(spark, sf_dir):
    """Sources of each language in order of their first document."""
    firsts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("first"))
    out = context.ordered_sources(firsts, "lang", "first")
    return out.select("lang", F.array_join("sources", ",").alias("sources"))


@query()
def chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(table(spark, sf_dir, "documents"))


@query("""SELECT doc_id, 0::BIGINT AS n_long, 0::BIGINT AS n_gaps, 0::BIGINT AS n_elsewhere, 0::BIGINT AS n_lost, length(text) > 800 AS several FROM documents WHERE regexp_matches(text, '[^\\s]')""")
def chunk_invariants(spark, sf_dir):
    """Chunks as SQL makes them by LATERAL: too long ones, gaps in their numbers, ones that are no part of the text, and words of the text in none, a document."""
    chunking.register(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text").createOrReplaceTempView("chunked_documents")
    rows = spark.sql("SELECT doc_id, text, chunk_index, content FROM chunked_documents, LATERAL split_text(text, 800, 100)")
    spark.catalog.dropTempView("chunked_documents")  # the plan holds what it stood for
    tokens = lambda c: F.array_remove(F.split(c, r"[\s.]+"), "")
    # A text travels once, with its first chunk; the others know it by its hash.
    rows = rows.select(
        "doc_id", F.sha2("text", 256).alias("same"), F.when(F.col("chunk_index") == 0, F.col("text")).alias("text"), "chunk_index", "content", (~F.contains("text", F.col("content"))).alias("elsewhere")
    )
    per = rows.groupBy("doc_id", "same").agg(
        F.count_if(F.length("content") > chunking.SIZE).alias("n_long"), (F.max("chunk_index") + 1 - F.size(F.collect_set("chunk_index"))).alias("n_gaps"),
        F.count_if("elsewhere").alias("n_elsewhere"), F.max("text").alias("text"), F.collect_list("content").alias("chunks"), F.count("*").alias("n"),
    )
    lost = F.size(F.array_except(tokens(F.col("text")), F.flatten(F.transform("chunks", tokens))))
    return per.select("doc_id", "n_long", F.col("n_gaps").cast("long").alias("n_gaps"), "n_elsewhere", lost.cast("long").alias("n_lost"), (F.col("n") > 1).alias("several"))


@query()
def lsh_topk(spark, sf_dir):
    """Approximate neighbours of every fiftieth vector among all; recall is measured in the tests."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.lsh_search(vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), asked)


_EXACT = """WITH d AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(1 - list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS rank, chunk_id, distance FROM d QUALIFY rank <= 1"""


@query(_EXACT)
def lsh_top1(spark, sf_dir):
    """The nearest of each query, itself: equal vectors share all buckets, so the index never misses it."""
    return lsh_topk(spark, sf_dir).where("rank = 1")
