"""The operators' queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaro.llm import merkle, mixing, ngram_join, ordinal_quality, packing, passages, periodic, quality_rules, sharding, topk_search, toxicity, turns, url_filter
from tessaro.llm._work import table


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.grade_quality(table(spark, sf_dir, "documents"), ordinal_quality.ratings_of(table(spark, sf_dir, "labels")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_report(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.tree_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors.where("vec_id % 100 = 0"), vectors)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turns.repair_report(conversations, turns.damaged(conversations))


def op13_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(table(spark, sf_dir, "documents"))


# Parts and invariants of the results above that SQL can say, over the same whole tables.


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the counts and the base rules."""
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    counts = quality_rules.text_counts(table(spark, sf_dir, "documents"), "doc_id")
    return counts.select(*columns, quality_rules.base_failed().alias("base_failed"))


def line_dedup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: how many words go from each document."""
    return op3_line_dedup(spark, sf_dir).select("doc_id", "removed_words")


def packing_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: documents packed, last pieces, sequences over capacity, and sequences whose pieces leave a gap or overlap."""
    packed = op5_best_fit_packing(spark, sf_dir)
    ends = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("at"), F.count("*").alias("pieces"))
    wrong = ends.agg(F.count_if(F.col("n") > packing.CAPACITY).alias("n_over"), F.count_if((F.col("n") != F.col("end")) | (F.col("at") != F.col("pieces"))).alias("n_gaps"))
    documents = packed.agg(F.count_if(F.col("start") == 0).alias("n_documents"), F.count_if((F.col("length") > packing.CAPACITY) | (F.col("length") < 1)).alias("n_bad_pieces"))
    return documents.crossJoin(F.broadcast(wrong))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: sizes and targets of every document's source."""
    return op6_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def mixing_near_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: sources, and how many miss their target by more than half of their largest document, or take one more than twice."""
    mixed = op6_source_mixing(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    per = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("largest"), F.count_if(F.col("taken") > 2 * F.col("size")).alias("over"))
    missed = F.abs(F.col("taken") - F.col("target")) > F.greatest(F.lit(12.0), F.col("largest") / 2, F.col("target") * 0.01)
    return per.agg(F.count("*").alias("n_sources"), F.count_if(missed).alias("n_missed"), F.sum("over").alias("n_over"))


def shard_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: rows, bytes, shards without rows, gaps in slots, and groups of equal texts that are split though they fit a shard."""
    placed = op9_tree_sharding(spark, sf_dir)
    per = placed.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"), F.sum("size").alias("bytes"))
    shards = per.agg(F.sum("n").alias("n_rows"), F.sum("bytes").alias("n_bytes"), (24 - F.count("*")).alias("n_empty"), F.count_if((F.col("last") + 1 != F.col("n")) | (F.col("slots") != F.col("n"))).alias("n_gaps"))
    texts = placed.join(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text")), "doc_id")
    groups = texts.groupBy("text").agg(F.count_distinct("shard").alias("places"), F.sum("size").alias("bytes"))
    split = groups.crossJoin(F.broadcast(shards.select("n_bytes"))).agg(F.count_if((F.col("places") > 1) & (F.col("bytes") * 24 <= F.col("n_bytes"))).alias("n_split"))
    return shards.crossJoin(F.broadcast(split))
