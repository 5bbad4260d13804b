import re

from tessaro.llm.quality_rules import FEATURES, judge_quality, keep_good, learn_rules, rejected_by, text_counts, with_features

from .corpus import SCHEMA, corpus, frame, sentence, words

import random


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by the plain definitions."""
    text = text or ""
    w = [x.decode() for x in words(text)]
    lines = [x for x in text.split("\n") if words(x)]
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    inside = {i + k for found in places.values() if len(found) > 1 for i in found for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def labelled(n=240, seed=2):
    """Good prose, and texts poor by symbols, bars, capitals or repeats."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = "\n".join(sentence(rng, rng.randint(8, 14)).capitalize() + "." for _ in range(rng.randint(3, 6)))
        kind = i % 8
        if kind == 0:
            text = re.sub(r"(\w+)", r"\1$$$", text)
        elif kind == 1:
            text = text.replace(" ", " | ")
        elif kind == 2:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, "en", "s", len(text)))
        if i % 3:
            labels.append((i, 0 if kind < 3 else 1, 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_counts_match_definitions(spark):
    eight = "a b c d e f g h"
    extra = [f"{eight} {eight}", f"{eight} x {eight} y\n{eight}", "a a a a a a a a a a", "a\nb\na\n\n \na", "#|<> $%&* é漢 x", " ".join(["r"] * 3000), "a b c d e f g", eight]
    rows = [*corpus(), *[(900 + i, t, "en", "s", 0) for i, t in enumerate(extra)]]
    got = text_counts(frame(spark, rows).drop("n_words"), "doc_id").collect()
    want = sorted(((r[0], *counts(r[1])) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=repr) == want


def test_learned_list_rejects_poor_and_keeps_good(spark):
    rows, labels = labelled()
    df, known = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    got = judge_quality(df, known).collect()
    poor = {r[0] for r in rows if r[0] % 8 < 3}
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert len(kept & poor) <= 0.1 * len(poor)
    assert kept >= {r[0] for r in rows} - poor
    out = keep_good(df, known)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == kept
    again = learn_rules(df, known)
    assert again == learn_rules(df, known) and all(1 <= len(r.conditions) <= 3 and r.precision >= 0.97 for r in again)


def test_verdicts_follow_the_rules_in_order(spark):
    rows, labels = labelled()
    df, known = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    rules = learn_rules(df, known)
    table = with_features(text_counts(df, "doc_id")).withColumn("rule", rejected_by(rules)).collect()
    for r in table:
        meets = [i for i, rule in enumerate(rules, 1) if all((r[c.feature] > c.threshold) == c.above for c in rule.conditions)]
        assert r["rule"] == (meets[0] if meets else 0)
    assert set(FEATURES) <= set(table[0].asDict())


def test_edges(spark):
    none = spark.createDataFrame([], LABELS)
    empty = spark.createDataFrame([], SCHEMA)
    assert judge_quality(empty, none).count() == 0
    odd = spark.createDataFrame([(None, 0, 0), (1, None, None), (2, 1, 0), (2, 0, 0)], LABELS)
    rows = corpus()
    for labels in (none, odd):
        for r in judge_quality(frame(spark, rows), labels).collect():
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert r["kept"] == (not r["base_failed"])
