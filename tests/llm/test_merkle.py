import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessaro.llm import merkle
from tessaro.llm.merkle import edit_report, edits, fingerprints, tree, with_next

from .corpus import SCHEMA, corpus, frame, sentence


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root(text):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    sections = []
    for i, x in enumerate(lines):
        if i % 16 == 0 or x.startswith("#") or (lines[i - 1].strip(" ") == "\n" != x.strip(" ")):
            sections.append("")
        sections[-1] += sha(x)
    return sha("".join(map(sha, sections)))


def parts(text):
    return {p for x in re.findall(r"[^\n]*\n|[^\n]+", text) for p in re.findall(r"[^.,;:!?]{1,32}[.,;:!?]{0,16}|[.,;:!?]{1,16}", x)}


def near(a, b):
    if a == b:
        return 1.0
    p, q = parts(a), parts(b)
    n = lambda s: sum(map(len, s))
    return 1 - (n(p - q) + n(q - p)) / (n(p) + n(q)) if p and q else 0.0


def expected(rows):
    """By plain Python: documents of different ids go by id, from the largest down, null last."""
    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    following = {r: order[(i + 1) % len(order)][1] for i, r in enumerate(order)}
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        after, tail = following[doc_id, text], len(text) // 3
        edited = text[: len(text) - tail] + after[:tail]
        out.append((doc_id, len(text), sha(edited), root(text), root(edited), near(text, edited), near(text, after)))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    structured = "# One\n" + "\n".join(sentence(rng, 9) + "." for _ in range(40)) + "\n\n  \nTwo\n\n# Three\n" + sentence(rng, 30) + "\n"
    # One text an id: the order of several is by hash, which plain Python has not.
    return [*{r[0]: r for r in corpus(2, 70) if r[0] is not None}.values(), (500, structured, "en", "s", 1), (501, structured + "x", "en", "s", 1), (502, "漢字かな, " * 9 + "\r\n\n", "en", "s", 1), (None, "last.", "en", "s", 1)]


@pytest.mark.parametrize("docs, most", [(1_000, 16_384), (7, 16_384), (1, 9)])
def test_report_against_plain_python(spark, rows, monkeypatch, docs, most):
    monkeypatch.setattr(merkle, "BLOCK_DOCS", docs)
    monkeypatch.setattr(merkle, "MOST_BLOCKS", most)
    got = Counter(tuple(r) for r in edit_report(frame(spark, rows)).drop("n").collect())
    assert got == expected(rows)


def test_repeated_rows_are_one_document(spark, rows):
    twice = [*rows, rows[3], rows[3], rows[-1]]
    assert Counter(tuple(r) for r in edit_report(frame(spark, twice)).collect()) == expected(twice)
    alike = frame(spark, [(1, "a", None, None, 0)] * 3 + [(1, "b", None, None, 0)])
    assert sorted((r["text"], r["next_text"], r["n"]) for r in with_next(alike).collect()) == [("a", "b", 3), ("b", "a", 1)]


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(4, "only one", "en", "s", 8)], SCHEMA)
    row = edit_report(one).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == sha("only o" + "on")
    assert edit_report(one.limit(0)).count() == 0 and fingerprints(one.limit(0)).count() == 0


def test_differing_branches_locate_edits(spark):
    rng = random.Random(4)
    lines = [sentence(rng, 12) + ".\n" for _ in range(80)]
    changed = lines[:30] + [sentence(rng, 12) + ".\n"] + lines[31:] + ["end"]
    df = spark.createDataFrame([("".join(lines), "".join(changed))], "a string, b string").select(tree(F.col("a")).alias("tree"), tree(F.col("b")).alias("other"))
    row = edits(df).first()
    assert [p["digest"] for p in row["removed"]] == [sha(lines[30])]
    assert [p["digest"] for p in row["added"]] == [sha(changed[30]), sha("end")]
    assert [p["length"] for p in row["added"]] == [len(changed[30]), 3]


def test_roots_tell_texts_apart(spark):
    texts = ["", "a", "a\n", "\na", "a\n\n", "a b", "a  b", "A b", "# a\nb", "a\nb"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*texts, *texts])], SCHEMA)
    found = fingerprints(df).collect()
    assert len({r["fingerprint"] for r in found}) == len(texts)
    assert {r["n_chars"] for r in found} == set(map(len, texts))
