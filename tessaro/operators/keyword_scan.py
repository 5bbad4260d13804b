"""Which of many keywords every text holds, in one pass: an Aho-Corasick automaton of all of them runs over each text once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the words that one automaton holds; more words are looked for in several passes.
MOST_CHARACTERS = 16_000_000


@cache
def _automaton(words: tuple[str, ...]) -> tuple[ahocorasick.Automaton, list[tuple[int, re.Pattern]]]:
    """Once a Python worker: the words, and patterns of those with an underscore, where it stands for any character."""
    found = ahocorasick.Automaton()
    for i, w in enumerate(words):
        found.add_word(w, i)
    found.make_automaton()
    open_words = [(i, re.compile(re.escape(w).replace("_", "."), re.DOTALL)) for i, w in enumerate(words) if "_" in w]
    return found, open_words


def _passes(words: DataFrame) -> Iterator[tuple[str, ...]]:
    """The distinct words in groups that fit an automaton, each group's size checked before the driver takes it."""
    distinct = words.select("word").where("word <> ''").distinct()
    characters = distinct.agg(F.sum(F.length("word"))).first()[0] or 0
    groups = -(-characters // MOST_CHARACTERS)
    for g in range(groups):
        if group := tuple(sorted(r["word"] for r in distinct.where(F.pmod(F.xxhash64("word"), F.lit(groups)) == g).collect())):
            yield group


def scan_words(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """(word, chunk_id, literal) for every word of words(word) that a chunk's content holds, case aside.

    An underscore in a word stands for any character; literal tells whether the content
    holds it as it is.  Null contents hold nothing.
    """
    lowered = chunks.where("content is not null").select("chunk_id", F.lower("content").alias("content"))
    out = None
    for group in _passes(words):
        found = lowered.mapInArrow(_looker(group, lowered.schema["chunk_id"].dataType), f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, found array<struct<word:string,literal:boolean>>")
        rows = found.select("chunk_id", F.explode("found").alias("w")).select("w.word", "chunk_id", "w.literal")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return lowered.select(F.lit("").alias("word"), "chunk_id", F.lit(True).alias("literal")).limit(0)
    return out


def _looker(words: tuple[str, ...], kind):
    pairs = pa.list_(pa.struct([("word", pa.string()), ("literal", pa.bool_())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, open_words = _automaton(words)
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                literal = {i for _, i in automaton.iter(text)}
                loose = {i for i, pattern in open_words if i not in literal and pattern.search(text)}
                found.append([{"word": words[i], "literal": i in literal} for i in sorted(literal | loose)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pairs)], ["chunk_id", "found"])

    return look


def keyword_scores(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """(item_id, chunk_id, score) of every chunk that holds a keyword of asked(item_id, word, times)."""
    found = scan_words(chunks, asked).join(asked, "word")
    return found.groupBy("item_id", "chunk_id").agg(F.sum(F.col("literal").cast("int") * F.col("times")).cast("int").alias("score"))
