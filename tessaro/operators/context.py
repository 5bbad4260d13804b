"""Texts in order, conversation history, prompts and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaro.functions import text as tx

FULL_CONTEXT_CHARS = 50_000


def ordered_concat(value: Column, order: Column, separator: str) -> Column:
    """An aggregate: values joined in order."""
    sorted_rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(sorted_rows, lambda r: r["v"]), separator)


def numbered(rows: DataFrame, keys: list[str], block: Column, order: list[Column]) -> DataFrame:
    """rows with position: from 1 for each keys, by block, then by order; no key's rows meet in one task, only a block's."""
    rows = rows.withColumn("_block", block)
    sizes = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    inner = rows.withColumn("_inner", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)))
    same = [inner[k].eqNullSafe(sizes[f"_{k}"]) for k in keys] + [inner["_block"].eqNullSafe(sizes["_at"])]
    return inner.join(sizes, same).withColumn("position", F.col("_inner") + F.col("_before")).select(*[c for c in rows.columns if c != "_block"], "position")


def full_text(chunks: DataFrame, scope: str, most: int = FULL_CONTEXT_CHARS) -> DataFrame:
    """Per scope of at most so many characters: all chunks by (document_id, chunk_index), a heading before each document; text and chars.

    A heading is a line with the document's source, or the first eight characters of its
    id.  Longer scopes, whose texts are never joined, and null ones give no row.
    """
    short = context_mode(chunks, scope, most).where("mode = 'full_context'").select(scope)
    chunks = chunks.join(short, scope, "left_semi")
    name = F.coalesce(F.col("source"), F.substring(F.col("document_id").cast("string"), 1, 8))
    first = F.col("chunk_index") == F.min("chunk_index").over(Window.partitionBy(scope, "document_id"))
    piece = F.when(first, F.concat(F.lit("\n--- "), name, F.lit(" ---\n"), F.lit("\n"), F.col("content"))).otherwise(F.col("content"))
    joined = chunks.select(scope, "document_id", "chunk_index", piece.alias("piece")).groupBy(scope)
    text = joined.agg(ordered_concat(F.col("piece"), F.struct("document_id", "chunk_index"), "\n").alias("full_text"))
    return text.withColumn("n_chars", F.length("full_text"))


def context_mode(chunks: DataFrame, scope: str, most: int = FULL_CONTEXT_CHARS) -> DataFrame:
    """Per scope whether its whole text is short enough to be given at once: from sizes alone, no text is joined."""
    name = F.length(F.coalesce(F.col("source"), F.substring(F.col("document_id").cast("string"), 1, 8)))
    per = chunks.groupBy(scope, "document_id").agg(F.sum(F.length("content") + 1).alias("chars"), F.max(name).alias("name"))
    # A heading "\n--- name ---\n" and its line end per document; one separator fewer than pieces.
    total = per.groupBy(scope).agg((F.sum(F.col("chars") + F.col("name") + 11) - 1).alias("total_chars"))
    return total.withColumn("mode", F.when(F.col("total_chars") <= most, "full_context").otherwise("retrieval"))


def last_turns(messages: DataFrame, n: int, keys: tuple[str, ...] = ("conv_id",), order: str = "turn") -> DataFrame:
    """Each conversation's last n messages, with position from 1 in time order."""
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    kept = messages.withColumn("_latest", latest).where(F.col("_latest") <= n).drop("_latest")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def history_text(messages: DataFrame, n: int = 6) -> DataFrame:
    """Per conversation: its last n messages as lines of a prompt."""
    lines = last_turns(messages, n).withColumn("line", tx.history_line(F.col("role"), F.col("text")))
    return lines.groupBy("conv_id").agg(ordered_concat(F.col("line"), F.col("position"), "\n").alias("history"))


def retrieval_context(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: the ranked results as numbered blocks of a prompt, and their distinct sources in order.

    Results are already cut to a bounded number.
    """
    rows = results.join(chunks.select("chunk_id", "source", "content"), "chunk_id")
    block = tx.context_block(F.col("position"), F.col("source"), F.col("content"))
    ranked = F.array_sort(F.collect_list(F.struct("position", "source")))
    return rows.agg(
        F.coalesce(F.nullif(ordered_concat(block, F.col("position"), "\n\n---\n\n"), F.lit("")), F.lit("No relevant documents found.")).alias("context"),
        F.array_distinct(F.transform(ranked, lambda r: r["source"])).alias("sources"),
    )


def prompt(question: str, context: Column, history: Column | None = None, files: list[str] | None = None) -> Column:
    """What a language model is asked: context, recent turns and the question, in our own words."""
    head = f"Answer from the complete text of: {', '.join(files)}." if files else "Answer from the documents below."
    past = F.when(F.coalesce(history, F.lit("")) != "", F.concat(F.lit("\n\nEARLIER TURNS:\n"), history)).otherwise("") if history is not None else F.lit("")
    ending = f"\n\nQUESTION: {question}\n\nUse the language of the question, be brief, and keep numbers and names as they are.\nANSWER:"
    return F.concat(F.lit(head + "\n\nDOCUMENTS:\n"), context, past, F.lit(ending))


def ordered_sources(rows: DataFrame, key: str, order: str, source: str = "source") -> DataFrame:
    """Per key: its sources in order, each once at its first place."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(source).alias("s"))))
    return rows.groupBy(key).agg(F.array_distinct(F.transform(listed, lambda r: r["s"])).alias("sources"))


def chunk_counts(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"))
