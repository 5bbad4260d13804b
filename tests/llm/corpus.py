"""Small corpora for the operators' tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 7))) for _ in range(n))


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """Documents with exact copies, near copies, a shared passage, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(seed)
    passage = sentence(rng, 55)
    texts: list[str | None] = []
    for i in range(n):
        lines = [sentence(rng, rng.randint(3, 14)) for _ in range(rng.randint(2, 6))]
        if i % 7 == 0:
            lines.insert(1, passage)
        texts.append("\n".join(lines))
    texts += [texts[3], texts[3], texts[4].upper(), texts[5] + " tail", texts[5] + " other tail"]
    texts += [None, "", " \n\t ", "one", "one", "two words", sentence(rng, 6000), "é ü 漢字 " * 12]
    rows = [(i, t, ["en", "fr", None][i % 3], ["src0", "src1", "src2", None][min(i % 5, 3)], len(t) if t else None) for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, texts[1], "en", "src0", None), (None, None, None, None, None)]


def frame(spark, rows=None, clash=True):
    """The corpus as a DataFrame; with clash, also columns named like the operators' own."""
    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
    if clash:
        for name in ("size", "h", "tie", "block", "node", "row", "before", "cuts", "sig", "copies", "node_id", "kept", "rule", "text_hash"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()
