"""Many questions at once: the inverted index, the automaton and the neighbour graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaro.functions import text as tx
from tessaro.operators import keyword_scan, neighbour_graph, postings
from tessaro.plans.catalog import query
from tessaro.plans.retrieval_queries import plain_chunks
from tessaro.session import table

_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_SCORES = f"""kw AS (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{3,}}'), lambda x: x NOT IN ({_STOP}))[1:5]) AS w FROM benchmark),
scored AS (SELECT item_id, doc_id AS chunk_id, sum(CASE WHEN contains(lower(d.text), w) THEN 1 ELSE 0 END)::INT AS score
    FROM kw, documents d GROUP BY 1, 2 HAVING bool_or(d.text ILIKE '%' || w || '%'))"""


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


@query(f"WITH {_SCORES} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, score FROM scored QUALIFY rank <= 120")
def keyword_index_search(spark, sf_dir):
    """The index is built over all documents, then answers every question."""
    chunks = plain_chunks(spark, sf_dir)
    return postings.search(postings.build(chunks), chunks, questions(spark, sf_dir))


@query(f"WITH {_SCORES} SELECT item_id, chunk_id, score FROM scored")
def keyword_scan_all(spark, sf_dir):
    """Every document that holds a keyword of a question, for all questions, in one pass over the texts."""
    return keyword_scan.keyword_scores(plain_chunks(spark, sf_dir), postings.question_words(questions(spark, sf_dir)))


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{3,}')) AS token FROM documents)
    SELECT token, count(*) AS n_documents FROM t GROUP BY 1""")
def token_postings(spark, sf_dir):
    """The index's first level: how many documents every token stands in."""
    held = postings.build(plain_chunks(spark, sf_dir)).postings
    return held.groupBy("token").agg(F.count("*").alias("n_documents"))


@query()
def graph_topk(spark, sf_dir):
    """About the 40 nearest of every fiftieth vector among all, by walks over neighbour graphs; recall is measured in the tests."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    return neighbour_graph.search(neighbour_graph.build(vectors), asked)
