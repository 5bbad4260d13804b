"""Keyword search of many questions over an inverted index.

A keyword consists of letters, digits and underscores, so wherever a text holds it, it
lies inside one token: a longest stretch of such characters.  The index has two levels:

* postings: distinct (token, chunk_id), dealt and sorted by ranges of both, so a frequent
  token is spread over files and no list is ever one value;
* grams: (gram, token, n_tokens) for every three characters of the distinct tokens.

A search looks up the rarest grams of each keyword, keeps the tokens that have all of them
and hold the keyword, and reads their postings.  No text is read.  A keyword with an
underscore matches any character there, so it may cross tokens: those few are scanned for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaro.functions import text as tx
from tessaro.functions.binding import let
from tessaro.operators.keyword_scan import scan_words
from tessaro.sources.shared import new_folder, written

#: How many of a keyword's grams are looked up, and rows of a side that is broadcast (a word and a token each).
RAREST, BROADCAST_ROWS = 3, 200_000
#: What one task sorts or counts, in postings; a posting comes of about so many characters of text, or more.
TASK_ROWS, CHARACTERS = 500_000, 8


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    grams: DataFrame


def grams(word: Column) -> Column:
    """The distinct stretches of three characters of a word."""
    three = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 2), lambda i: F.concat(F.get(c, i - 1), F.get(c, i), F.get(c, i + 1)))
    return let(F.split(word, ""), lambda c: F.when(F.size(c) >= 3, F.array_distinct(three(c))).otherwise(F.array().cast("array<string>")))


def _tasks(spark: SparkSession, rows: int) -> int:
    """How many tasks rows are dealt to: as many as shuffles have, more where a task's share would grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def build(chunks: DataFrame, folder: str | None = None) -> Index:
    """Writes the index of chunks (chunk_id, content) under folder, a new shared one by default.  Null contents and ids are not indexed."""
    spark = chunks.sparkSession
    folder = folder or new_folder(spark, "postings")
    held = chunks.where("chunk_id is not null").agg(F.sum(F.length("content").cast("long"))).first()[0] or 0
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(tx.WORD), 0))
    rows = chunks.where("chunk_id is not null and content is not null").select("chunk_id", F.explode(tokens).alias("token"))
    # Rows of equal ids can repeat a pair: pairs are made distinct in the order in which they are sorted, not in a table of them.
    again = F.row_number().over(Window.partitionBy("token", "chunk_id").orderBy("chunk_id"))
    dealt = rows.repartitionByRange(_tasks(spark, held // CHARACTERS), "token", "chunk_id").withColumn("again", again).where("again = 1")
    postings = written(dealt.select("token", "chunk_id"), f"{folder}/postings")
    per = postings.select("token").distinct().select("token", F.explode(grams(F.col("token"))).alias("gram"))
    held = written(per.repartitionByRange(_tasks(spark, postings.count()), "gram", "token").sortWithinPartitions("gram", "token").select("gram", "token"), f"{folder}/grams")
    return Index(postings, held)


def load(spark: SparkSession, folder: str) -> Index:
    return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/grams"))


def question_words(questions: DataFrame) -> DataFrame:
    """(item_id, word, times) of questions (item_id, text): the keywords of each, repeats counted."""
    words = questions.select("item_id", F.explode(tx.keywords(F.col("text"))).alias("word"))
    return words.groupBy("item_id", "word").agg(F.count("*").cast("int").alias("times"))


def _side(rows: DataFrame) -> DataFrame:
    """rows, a written table, for a join without a shuffle of the other side while they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def matching_tokens(index: Index, words: DataFrame) -> DataFrame:
    """(word, token): every indexed token that holds a word of words(word)."""
    asked = words.select("word", F.explode(grams(F.col("word"))).alias("gram"))
    asked = written(asked, new_folder(words.sparkSession, "asked"))
    counts = index.grams.join(_side(asked.select("gram").distinct()), "gram").groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no token has leaves its word without any: it ranks first.
    ranked = asked.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("n", "gram"))
    rarest = ranked.withColumn("rank", rank).where(F.col("rank") <= RAREST).select("word", "gram", "rank")
    rarest = written(rarest, new_folder(words.sparkSession, "rarest"))
    needed = rarest.groupBy("word").agg(F.count("*").alias("needed"))
    met = index.grams.join(_side(rarest.select("word", "gram")), "gram").repartition(_tasks(words.sparkSession, index.grams.count()), "token").groupBy("word", "token").agg(F.count("*").alias("had"))
    return met.join(needed, "word").where((F.col("had") == F.col("needed")) & F.contains("token", F.col("word"))).select("word", "token")


def search(index: Index, chunks: DataFrame, questions: DataFrame, k: int = 40) -> DataFrame:
    """Up to 3 k chunks a question, those of most keywords first, then by id: item_id, rank, chunk_id, score.

    As ``retrieval.keyword_search`` finds them for each of the questions (item_id, text).
    Questions without keywords, null texts among them, have no rows.
    """
    spark = chunks.sparkSession
    asked = written(question_words(questions.where("item_id is not null")), new_folder(spark, "words"))
    words = asked.select("word").distinct()
    plain, open_words = words.where(~F.contains("word", F.lit("_"))), words.where(F.contains("word", F.lit("_")))
    tokens = written(matching_tokens(index, plain), new_folder(spark, "tokens"))
    # All that is counted of a chunk is counted in the task that its pairs are dealt to.
    tasks = _tasks(spark, index.postings.count())
    pairs = index.postings.join(_side(tokens), "token").select("word", "chunk_id").repartition(tasks, "chunk_id")
    found = pairs.distinct().select("word", "chunk_id", F.lit(1).alias("literal"))
    if not open_words.isEmpty():
        found = found.unionByName(scan_words(chunks, open_words).select("word", "chunk_id", F.col("literal").cast("int"))).repartition(tasks, "chunk_id")
    scores = found.join(_side(asked), "word").groupBy("item_id", "chunk_id").agg(F.sum(F.col("literal") * F.col("times")).cast("int").alias("score"))
    best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "chunk_id"))
    return scores.withColumn("rank", best).where(F.col("rank") <= 3 * k).select("item_id", "rank", "chunk_id", "score")
