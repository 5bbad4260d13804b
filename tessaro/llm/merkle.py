"""Document fingerprints by Merkle trees over pieces, paragraphs and sections.

A paragraph is a line with its line end; a section begins with a heading, after a blank
line, and after SECTION lines at the latest.  Paragraphs, sections and the root are SHA-256
digests of what lies below them, so equal roots tell equal texts.  Below a paragraph lie
pieces of some words, cut at punctuation: numbers that hold a hash and the piece's length.
Two trees are compared from the top: only sections that the other tree lacks are opened,
then their paragraphs, then their pieces, which locates what was edited.  All of it is
column functions over one row; documents meet their neighbours in blocks of the order.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaro.llm._work import let, settle

#: Lines of a section, and characters of a piece before its punctuation.
SECTION, PIECE = 16, 32
_PIECE = r"[^.,;:!?]{1,32}[.,;:!?]{0,16}|[.,;:!?]{1,16}"
#: Documents of one block of the order; blocks at most: the first document of each is known to all tasks.
BLOCK_DOCS, MOST_BLOCKS = 1_000, 16_384


def paragraphs(text: Column) -> Column:
    """The lines of a text, each with its line end: joined they are the text."""
    ended = lambda lines: F.transform(lines, lambda x, i: F.when(i < F.size(lines) - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    return F.filter(let(F.split(text, "\n"), ended), lambda x: x != "")


def pieces(paragraph: Column) -> Column:
    """Numbers of a paragraph's pieces: 56 bits of hash above eight of length, which stays below 256."""
    found = F.regexp_extract_all(paragraph, F.lit(_PIECE), 0)
    return F.transform(found, lambda x: F.shiftleft(F.xxhash64(x), 8).bitwiseOR(F.length(x).cast("long")))


def tree(text: Column) -> Column:
    """The Merkle tree of a text: struct<root, sections: array<struct<digest, paragraphs: array<struct<digest, length, pieces>>>>>."""
    node = lambda x: F.struct(F.sha2(x, 256).alias("digest"), F.length(x).alias("length"), pieces(x).alias("pieces"))

    def grown(lines: Column) -> Column:
        blank = lambda i: F.trim(F.get(lines, i)) == "\n"
        begins = lambda i: (i % SECTION == 0) | F.get(lines, i).startswith("#") | (blank(i - 1) & ~blank(i))
        places = F.when(F.size(lines) > 0, F.filter(F.sequence(F.lit(0), F.size(lines) - 1), begins)).otherwise(F.array().cast("array<int>"))

        def cut(starts: Column) -> Column:
            ends = lambda k: F.coalesce(F.get(starts, k + 1), F.size(lines))
            section = lambda at, k: F.transform(F.slice(lines, at + 1, ends(k) - at), node)
            digest = lambda below: F.sha2(F.array_join(F.transform(below, lambda p: p["digest"]), ""), 256)
            whole = lambda below: F.struct(digest(below).alias("digest"), below.alias("paragraphs"))
            return F.transform(F.transform(starts, section), whole)

        return let(places, cut)

    sections = let(paragraphs(text), grown)
    return let(sections, lambda s: F.struct(F.sha2(F.array_join(F.transform(s, lambda x: x["digest"]), ""), 256).alias("root"), s.alias("sections")))


def _lacking(nodes: Column, other: Column) -> Column:
    """The nodes whose digest other nodes lack."""
    digests = lambda x: F.transform(x, lambda n: n["digest"])
    kept = lambda x, gone: F.filter(x, lambda n: F.array_contains(gone, n["digest"]))
    return let(nodes, lambda x: let(F.array_except(digests(x), digests(other)), lambda gone: kept(x, gone)))


def _opened(a: Column, b: Column) -> Column:
    """The paragraphs of those sections of tree a that tree b has nowhere."""
    return F.flatten(F.transform(_lacking(a["sections"], b["sections"]), lambda s: s["paragraphs"]))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """The paragraphs of tree a that tree b has nowhere: only a's sections that b lacks are opened."""
    return _lacking(_opened(a, b), F.flatten(F.transform(b["sections"], lambda s: s["paragraphs"])))


def _pieces(nodes: Column) -> Column:
    return F.flatten(F.transform(nodes, lambda p: p["pieces"]))


def _characters(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND(F.lit(255)))


def likeness(a: Column, b: Column) -> Column:
    """How much of the different pieces of two trees both have, by characters: 1 for equal roots, 0 where nothing is shared."""
    every = lambda t: F.array_distinct(F.flatten(F.transform(t["sections"], lambda s: _pieces(s["paragraphs"]))))
    lost = lambda x, y, of_y: _characters(F.array_except(_pieces(_opened(x, y)), of_y))
    shared = lambda p, q: 1.0 - (lost(a, b, q) + lost(b, a, p)) / (_characters(p) + _characters(q)).cast("double")
    unequal = let(every(a), lambda p: let(every(b), lambda q: F.when((F.size(p) == 0) | (F.size(q) == 0), 0.0).otherwise(shared(p, q))))
    return F.when(a["root"] == b["root"], 1.0).otherwise(unequal)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint, tree) a row: the root and the tree below it.

    Null text counts as empty; the empty text has a root and no sections.  Repeated rows
    and null ids give rows like any other, empty tables none; other columns are not read.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"], F.length(text).cast("long").alias("n_chars"), tree(text).alias("tree"))
    return rows.select("doc_id", "n_chars", F.col("tree.root").alias("fingerprint"), "tree")


def edits(pairs: DataFrame, a: str = "tree", b: str = "other") -> DataFrame:
    """pairs with ``removed`` and ``added``: the paragraphs (digest, length, pieces) of one tree that the other has nowhere."""
    return pairs.withColumn("removed", changed_paragraphs(F.col(a), F.col(b))).withColumn("added", changed_paragraphs(F.col(b), F.col(a)))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text) a row: documents by descending doc_id, null last, then by hash of the text; after the last comes the first.

    Rows of one id and text are one document.  Documents are dealt into blocks of the
    order; the first of each block also closes the block before it.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    keys = settle(rows.groupBy("doc_id", "key").agg(F.count("*").alias("n")))
    n, most = keys.agg(F.count("*"), F.max("n")).first()
    if most is not None and most > 1:  # rows alike all over: texts of one of them go on
        rows = rows.groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.count("*").cast("int").alias("n"))
    else:
        rows = rows.withColumn("n", F.lit(1))
    order = F.struct(F.col("doc_id").isNull().alias("late"), F.bitwise_not("doc_id").alias("low"), F.col("key").alias("key"))
    blocks = max(1, min(n // BLOCK_DOCS, MOST_BLOCKS))
    ranges = keys.select(order.alias("o")).repartitionByRange(blocks, "o").groupBy(F.spark_partition_id()).agg(F.min("o").alias("o"))
    firsts = sorted(({"late": r["o"]["late"], "low": r["o"]["low"], "key": r["o"]["key"]} for r in ranges.collect()), key=lambda x: (x["late"], x["low"] or 0, x["key"]))
    # Two steps: the group of bounds, then the bound in it.
    width = max(1, math.isqrt(len(firsts)))
    listed = lambda rows, kind: F.from_json(F.lit(json.dumps(rows)), kind)
    kind = "struct<late: boolean, low: bigint, key: bigint>"
    heads = listed(firsts[::width], f"array<{kind}>")
    groups = listed([firsts[i : i + width] for i in range(0, len(firsts), width)], f"array<array<{kind}>>")
    below = lambda bounds: F.size(F.filter(bounds, lambda x: x <= F.col("o"))) - 1
    block = let(below(heads), lambda g: g * width + below(F.get(groups, g)))
    placed = rows.withColumn("o", order).withColumn("block", block)
    last = max(0, len(firsts) - 1)
    is_first = F.col("o") == F.get(F.get(groups, F.floor(F.col("block") / width).cast("int")), F.col("block") % width)
    own = F.struct(F.col("block").alias("block"), F.lit(0).alias("edge"))
    before = F.struct(F.when(F.col("block") == 0, last).otherwise(F.col("block") - 1).alias("block"), F.lit(1).alias("edge"))
    placed = placed.select("doc_id", "text", "n", "o", F.explode(F.when(is_first, F.array(own, before)).otherwise(F.array(own))).alias("at"))
    following = Window.partitionBy("block").orderBy("edge", "o")
    met = placed.select("*", "at.*").repartition("block").withColumn("next_text", F.lead("text").over(following)).where("edge = 0")
    return met.select("doc_id", "text", "next_text", "n")


def edit_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, fingerprint, and how alike it is to that of the edited text and of the next document.

    The edited text has the next document's beginning instead of its own last third.
    """
    n_chars = F.length("text")
    tail = F.floor(n_chars / 3).cast("int")
    met = with_next(docs).withColumn("n_chars", n_chars.cast("long"))
    met = met.withColumn("edited", F.concat(F.substring("text", F.lit(1), n_chars - tail), F.substring("next_text", F.lit(1), tail)))
    grown = met.select("doc_id", "n_chars", "n", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("a"), tree(F.col("edited")).alias("b"), tree(F.col("next_text")).alias("c"))
    out = grown.select(
        "doc_id", "n_chars", "edited_sha256", F.col("a.root").alias("fingerprint"), F.col("b.root").alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"), "n",
    )
    return out.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
