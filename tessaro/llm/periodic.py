"""Periodic runs of words in whole texts, and texts with each run collapsed to its first period.

A run of at least 12 words whose period is at most half of it holds every one of its
words in some six words that it holds again.  So only stretches that six-word repeats
cover without a gap, each repeat inside its own stretch, can hold runs (repeats are told
by hashes: an accident makes a stretch longer, never shorter).  These stretches go to the
suffix tree of ``tandem``; most texts have none.  There is no shuffle: a text is a row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaro.llm import tandem

#: A run's least length in words, and the words of a repeat that every such run consists of.
LEAST, GRAM = 12, 6
#: Characters of texts after which a batch of results leaves.
FLUSH = 8_000_000
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FACTORS = np.random.default_rng(5).integers(1, 2**63, GRAM, dtype=np.uint64) | np.uint64(1)


def repeating_stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the stretches that can hold runs, narrowed until every six-word repeat lies in its stretch."""
    if len(ids) < LEAST:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    n = len(ids) - GRAM + 1
    gram = sum(mixed[j : n + j] * f for j, f in enumerate(_FACTORS))
    at, stretch = np.arange(n), np.zeros(n, dtype=np.uint64)
    stretches, before = [], None
    while True:
        key = gram[at] + stretch * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = at[twice]
        if not len(at):
            return []
        # Places whose six words touch or overlap are one stretch.
        cut = np.flatnonzero(np.diff(at) > GRAM)
        begins, ends = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + GRAM
        stretches = list(zip(begins.tolist(), ends.tolist()))
        if len(at) == before:
            return [(a, b) for a, b in stretches if b - a >= LEAST]
        before = len(at)
        stretch = np.repeat(np.arange(len(begins), dtype=np.uint64), np.diff(np.r_[0, cut + 1, len(at)]))


def find_runs(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``least`` (12 or more) words, by start, then period."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    return [(a + s, m, p) for a, b in repeating_stretches(ids) for s, m, p in tandem.runs(ids[a:b].tolist()) if m >= least]


def repeats_in(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    steps = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) > 0


def plant_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of all documents, told by their ids, turn periodic from some word on; the others stay."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def run_table(docs: DataFrame, least: int = LEAST, planted: bool = False) -> DataFrame:
    """(doc_id, runs, collapsed) a row: all runs (start, length, period) in words, and the words that stay, joined by a space.

    Words are split at ASCII white space.  Null, empty and blank texts have no runs and
    an empty collapsed text.  A null doc_id is an id like any other, but plants nothing.
    Repeated rows each give a row, empty tables none, and other columns are not read.
    planted: the text is first made periodic by ``plant_period``.
    """
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words are not looked for")
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = {name: [] for name in schema.names}, 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                words = plant_period(words, doc_id) if planted else words
                found = find_runs(words, least)
                kept = [w for w, gone in zip(words, repeats_in(found, len(words))) if not gone] if found else words
                out["doc_id"].append(doc_id)
                out["runs"].append([{"start": s, "length": m, "period": p} for s, m, p in found])
                out["collapsed"].append(b" ".join(kept).decode())
                held += len(out["collapsed"][-1])
                if held > FLUSH:
                    yield pa.RecordBatch.from_pydict(out, schema)
                    out, held = {name: [] for name in schema.names}, 0
            yield pa.RecordBatch.from_pydict(out, schema)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(find, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_report(docs: DataFrame, least: int = LEAST, planted: bool = True) -> DataFrame:
    """Per row: doc_id, n_runs, the longest run (ties: least start, then period; else nulls) and digests of all runs and of the collapsed text."""
    found = run_table(docs, least, planted)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    length = -F.col("longest.less")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", length.alias("length"), "longest.period",
        F.expr("-1000 * longest.less div longest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def collapse_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents with every run cut to its first period, all columns kept; texts without runs, null among them, stay to the last white space."""

    @F.pandas_udf("string")
    def collapsed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            words = (text or "").encode().split()
            found = find_runs(words, least)
            return b" ".join(w for w, gone in zip(words, repeats_in(found, len(words))) if not gone).decode() if found else text

        return texts.map(one)

    return docs.withColumn("text", collapsed(docs["text"]))
