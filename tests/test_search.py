import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaro.operators import keyword_scan, neighbour_graph, postings, retrieval
from tessaro.operators.intervals import in_rectangles
from tessaro.sources import variants

TEXTS = [
    "The Quick brown_fox\njumps", "quick-brown foxes", None, "", "über ÜBERGANG naïve_word", "naive word, naiveXword", "a" * 3000 + "needle" + "b" * 3000,
    "needle needle", "ab c", "世界人民 是", "Bound_ary", "bound-ary boundXary", "İstanbul",
]
QUESTIONS = [(1, "quick brown needle needle"), (2, "naïve_word übergang"), (3, "世界人民"), (4, "bound_ary"), (5, "the and"), (6, None), (7, "absentword"), (8, "istanbul"), (9, "anbul ove row xjum")]


def _frames(spark):
    chunks = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "chunk_id long, content string, source string")
    return chunks, spark.createDataFrame(QUESTIONS, "item_id long, text string")


def test_index_scan_and_single_questions_agree(spark):
    chunks, questions = _frames(spark)
    found = {(r["item_id"], r["chunk_id"]): (r["rank"], r["score"]) for r in postings.search(postings.build(chunks), chunks, questions).collect()}
    want = {}
    for item, text in QUESTIONS:
        if text is not None:
            rows = retrieval.keyword_search(chunks, text).orderBy(F.desc("score"), "chunk_id").collect()
            want |= {(item, r["chunk_id"]): (i, r["score"]) for i, r in enumerate(rows, 1)}
    assert found == want and (1, 6) in want and (4, 11) in want
    scanned = keyword_scan.keyword_scores(chunks, postings.question_words(questions)).collect()
    assert {(r["item_id"], r["chunk_id"]): r["score"] for r in scanned} == {k: s for k, (_, s) in want.items()}


def test_postings_are_distinct(spark):
    rows = [(i % 7, "common words of equal ids") for i in range(60)] + [(8, "common common"), (None, "common"), (9, None)]
    held = postings.build(spark.createDataFrame(rows, "chunk_id long, content string")).postings
    pairs = [tuple(r) for r in held.select("token", "chunk_id").collect()]
    assert sorted(pairs) == sorted({(w, i) for i, t in rows if i is not None and t for w in t.split() if len(w) > 2})


def test_tasks_grow_with_the_input(spark, monkeypatch):
    chunks, questions = _frames(spark)
    rows = lambda: sorted(map(tuple, postings.search(postings.build(chunks), chunks, questions).collect()))
    want = rows()
    monkeypatch.setattr(postings, "TASK_ROWS", 2)
    built = postings.build(chunks)
    assert len(built.postings.inputFiles()) > 4 and len(built.grams.inputFiles()) > 4 and rows() == want
    found = postings.search(built, chunks, questions.where("item_id <> 4"))
    assert re.search(r"hashpartitioning\(chunk_id#\d+L?, \d{2,}\), REPARTITION_BY_NUM", found._jdf.queryExecution().executedPlan().toString())


def test_limit_and_joins_of_large_sides(spark, monkeypatch):
    monkeypatch.setattr(postings, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(keyword_scan, "MOST_CHARACTERS", 6)
    chunks = spark.createDataFrame([(i, f"common words {i}") for i in range(50)], "chunk_id long, content string")
    questions = spark.createDataFrame([(1, "common words"), (2, "wor 17 common")], "item_id long, text string")
    index = postings.build(chunks)
    rows = postings.search(index, chunks, questions, k=3).orderBy("item_id", "rank").collect()
    assert [(r["item_id"], r["chunk_id"], r["score"]) for r in rows] == [(i, c, 2) for i in (1, 2) for c in range(9)]
    assert keyword_scan.keyword_scores(chunks, postings.question_words(questions)).count() == 100
    empty = chunks.limit(0)
    assert postings.search(postings.build(empty), empty, questions).count() == 0
    assert keyword_scan.keyword_scores(chunks, postings.question_words(questions.limit(0))).count() == 0


@pytest.mark.parametrize("kind", ["spread", "clustered"])
def test_graph_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbour_graph, "SHARD_ROWS", 900)
    rng = np.random.default_rng(6)
    m = rng.normal(size=(2_500, 48)) if kind == "spread" else np.repeat(rng.normal(size=(50, 48)), 50, axis=0) + 0.05 * rng.normal(size=(2_500, 48))
    chunks = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "chunk_id long, embedding array<double>")
    asked = chunks.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    index = neighbour_graph.build(chunks)
    assert sum(len(np.frombuffer(r["ids"], np.int64)) for r in index.collect()) == 2_500 and index.count() == 3
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    exact = np.argsort(-(unit[::50] @ unit.T), axis=1)[:, :40]
    got = {}
    for r in neighbour_graph.search(index, asked).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["chunk_id"], r["distance"])
    recalls = [len({c for c, _ in got[50 * i].values()} & set(e.tolist())) / 40 for i, e in enumerate(exact)]
    assert np.mean(recalls) >= 0.9 and all(sorted(g) == list(range(1, 41)) for g in got.values())
    assert all(got[50 * i][1] == (50 * i, 0.0) for i in range(50)) or kind == "clustered"


def test_graph_takes_what_has_a_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1e200, 1e200]), (6, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "query_id long, query array<double>")
    got = neighbour_graph.search(neighbour_graph.build(chunks), asked, k=5).orderBy("rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["distance"]) for r in got] == [(1, 1, 0.0), (1, 8, 0.0), (1, 5, 0.292893)]
    assert neighbour_graph.search(neighbour_graph.build(chunks.limit(0)), asked).count() == 0
    assert neighbour_graph.search(neighbour_graph.build(chunks), asked.limit(0)).count() == 0


def test_points_in_rectangles(spark):
    rng = random.Random(3)
    points = [(rng.choice("ab"), rng.randint(0, 300), rng.randint(0, 90)) for _ in range(800)] + [(None, 1, 1), ("a", None, 1)]
    boxes = [(rng.choice("ab"), r, c, r + rng.choice([0, 1, 5, 150]), c + rng.choice([0, 2, 70])) for r, c in ((rng.randint(0, 300), rng.randint(0, 90)) for _ in range(40))]
    boxes += [("a", 5, 5, 4, 9), (None, 0, 0, 400, 400), ("a", None, 0, 9, 9)]
    p = spark.createDataFrame(points, "sheet string, row int, col int")
    b = spark.createDataFrame(boxes, "sheet string, row int, col int, row2 int, col2 int")
    met = in_rectangles(p, b, ["sheet"])
    got = sorted(tuple(r) for r in met.collect())
    inside = lambda x, y: None not in x and None not in y and x[0] == y[0] and y[1] <= x[1] <= y[3] and y[2] <= x[2] <= y[4]
    assert got == sorted((*x, *y[1:]) for x in points for y in boxes if inside(x, y)) and len(got) > 500
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_json_of_unknown_shape(spark):
    texts = [
        ("a", '[{"x": 1, "y": {"z": 2.5, "w": "t"}, "l": [1, {"m": 2}]}, {"x": "s", "q q": null, "y": {}}, 7]'), ("b", '{"x": 3, "y": {"z": 4, "deep": {"er": true}}, "y.z": 9}'),
        ("c", "[1, 2"), ("d", None), ("e", "5"), ("f", "[]"), ("g", '{"y": 12}'),
    ]
    df = spark.createDataFrame(texts, "path string, text string")
    every = variants.records(df, "text")
    assert sorted((r["path"], r["at"]) for r in every.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("e", 0), ("g", 0)]
    wide = variants.columns(every)
    assert wide.columns == ["path", "at", "l", "q q", "x", "y", "y.z"]  # y is mixed, so it stays JSON
    rows = {(r["path"], r["at"]): r for r in wide.collect()}
    assert rows["a", 0]["x"] == "1" and rows["a", 1]["x"] == '"s"' and rows["b", 0]["y.z"] == 9 and rows["e", 0]["x"] is None
    assert rows["a", 0]["l"] == '[1,{"m":2}]' and rows["g", 0]["y"] == "12"
    stats = {(r["path"], r["field"]): tuple(r)[2:] for r in variants.field_statistics(every, ["path"]).collect()}
    assert stats["a", "x"] == (2, 1, 1.0, 1.0, 1.0) and stats["a", "q q"] == (0, 0, None, None, None) and stats["b", "y.deep.er"][:2] == (1, 0)
    assert stats["g", "y"] == (1, 1, 12.0, 12.0, 12.0) and stats["a", "y.z"][2] == 2.5
    inside = variants.elements(every, ("l",))
    assert [(r["path"], r["pos"]) for r in inside.orderBy("pos").collect()] == [("a", 0), ("a", 1)]
    assert variants.fields(every.where("path = 'e'")).count() == 0 and variants.columns(every.limit(0)).columns == ["path", "at"]
