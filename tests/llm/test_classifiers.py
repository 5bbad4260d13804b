import random
import zlib

import numpy as np

import pytest

from tessaro.llm import hashed_text, ordinal_quality, toxicity
from tessaro.llm.ordinal_quality import grade_quality, ratings_of, tails, thresholds
from tessaro.llm.toxicity import logit, score_toxicity

from .corpus import SCHEMA, corpus, frame, sentence

LABELS = "doc_id long, quality int, toxic int"


def toxic_corpus(n=600, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = sentence(rng, rng.randint(20, 60)).split()
        toxic = i % 4 == 0
        if toxic:
            for bad in rng.sample(["vilewort", "scumbagel", "foulish"], 2):
                w[rng.randrange(len(w))] = bad + rng.choice(["", "!", "..."])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    got = score_toxicity(frame(spark, [*rows, rows[0], (None, "x", None, None, None), (5000, "", None, None, 0), (5001, None, None, None, 0)]), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    known = {d: t for d, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in known]
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in held]) > 0.95
    assert len({r["score"] for r in got if r["doc_id"] in (5000, 5001)}) == 1


def test_interactions_that_weights_alone_cannot_learn(spark):
    """Either term alone is harmless; together they are not."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(800):
        w = sentence(rng, 20).split()
        a, b = i % 2, i // 2 % 2
        w += ["zork"] * a + ["blim"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, a & b))
    got = score_toxicity(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    known = {d: t for d, _, t in labels}
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in got if r["held_out"]]) > 0.9


def test_without_labels_and_rows(spark):
    none, empty = spark.createDataFrame([], LABELS), spark.createDataFrame([], SCHEMA)
    got = score_toxicity(frame(spark), none).collect()
    assert len(got) == len(corpus()) and all(0 <= r["score"] <= 1 for r in got)
    assert score_toxicity(empty, none).count() == 0
    graded = grade_quality(frame(spark), ratings_of(none)).collect()
    assert len(graded) == len(corpus())
    assert grade_quality(empty, ratings_of(none)).count() == 0
    odd = spark.createDataFrame([(None, 0, 0), (1, None, 1), (2, 5, 0), (3, 1, None)], LABELS)
    assert ratings_of(odd).where("grade is not null").collect()[0]["grade"] == 0
    assert grade_quality(frame(spark), ratings_of(odd)).count() == len(corpus())


def test_ordinal_grades(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        w = sentence(rng, 30).split()
        grade = i % 3
        if grade == 0:
            w = [x + "###" for x in w]
        elif grade == 1:
            w[3] = "vilewort"
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(grade > 0), int(grade == 1)))
    train, test = labels[:450], labels[450:]
    got = {r["doc_id"]: r for r in grade_quality(frame(spark, rows), ratings_of(spark.createDataFrame(train, LABELS))).collect()}
    means = [np.mean([got[d]["expected_grade"] for d, *_ in test if d % 3 == g]) for g in range(3)]
    assert means[0] + 0.4 < means[1] and means[1] + 0.3 < means[2]
    assert np.mean([got[d]["kept"] == (d % 3 > 0) for d, *_ in test]) > 0.97
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got.values())


def test_thresholds_are_ordered():
    t = thresholds(np.array([-1.0, -3.0, 0.5]), 3)
    assert (np.diff(t) > 0).all()


def test_terms():
    cells, values = hashed_text.terms("Trash### trash, TRASH a a")
    assert len(cells) == len(values) == len(np.unique(cells)) and len(cells) == 2 + len(hashed_text.SHAPE_CELLS)
    for nothing in (None, "", " \n"):
        assert len(hashed_text.terms(nothing)[0]) == 0


class OneBatch:
    """All rows as one batch, as an epoch sees them."""

    def __init__(self, texts, y):
        self.parts = (np.repeat(np.arange(len(y)), [len(p) for p, _ in texts]), np.concatenate([p for p, _ in texts]), np.concatenate([x for _, x in texts]), np.array(y))

    def batches(self, size, rng):
        yield self.parts


def sparse_rows(rng, cells):
    texts = []
    for _ in range(7):
        at = np.sort(rng.choice(cells, rng.integers(0, 5), replace=False))
        texts.append((at, rng.normal(size=len(at))))
    return texts


def numeric_gradient(loss, params):
    out = np.zeros(len(params))
    for i in range(len(params)):
        up, down = params.copy(), params.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        out[i] = (loss(up) - loss(down)) / 2e-6
    return out


def gradient_of_step(before, after, step):
    """AdaGrad's first step from a start of 0.01, turned back into its gradient."""
    r = (before - after) / step
    return 0.1 * r / np.sqrt(1 - r**2)


def test_factorization_machine_against_all_pairs():
    rng = np.random.default_rng(2)
    m, k = 6, toxicity.FACTORS
    params = rng.normal(0, 0.3, 1 + m * (1 + k))
    w, v = params[1 : 1 + m], params[1 + m :].reshape(m, k)

    def plain(p, at, x):
        w, v = p[1 : 1 + m], p[1 + m :].reshape(m, k)
        pairs = sum(float(v[a] @ v[b]) * x[i] * x[j] for i, a in enumerate(at) for j, b in enumerate(at) if i < j)
        return p[0] + sum(w[a] * x[i] for i, a in enumerate(at)) + pairs

    texts, y = sparse_rows(rng, m), [0, 1, 0, 1, 1, 0, 1]
    for at, x in texts:
        assert logit(params, at, x) == pytest.approx(plain(params, at, x))

    def loss(p):
        mean = np.mean([np.log1p(np.exp(-(2 * t - 1) * plain(p, at, x))) for (at, x), t in zip(texts, y)])
        return mean + toxicity.SHRINK / 2 * float((p[1:] ** 2).sum())

    after = toxicity._epoch(OneBatch(texts, y), params.copy(), 0)
    assert gradient_of_step(params, after, toxicity.STEP) == pytest.approx(numeric_gradient(loss, params), rel=1e-3, abs=1e-6)


def test_cumulative_link_against_its_definition():
    rng = np.random.default_rng(3)
    m, cuts = 6, 3
    params = rng.normal(0, 0.5, cuts + m)

    def probabilities(p, at, x):
        first, steps, w = p[0], p[1:cuts], p[cuts:]
        edges, score = [first], sum(w[a] * x[i] for i, a in enumerate(at))
        for s in steps:
            edges.append(edges[-1] + np.exp(s))
        above = [1.0, *[1 / (1 + np.exp(e - score)) for e in edges], 0.0]
        return [above[g] - above[g + 1] for g in range(cuts + 1)], above[1:-1]

    texts, y = sparse_rows(rng, m), [0, 1, 2, 3, 3, 0, 1]
    for at, x in texts:
        assert tails(params, cuts, at, x).tolist() == pytest.approx(probabilities(params, at, x)[1])

    def loss(p):
        return -np.mean([np.log(probabilities(p, at, x)[0][g]) for (at, x), g in zip(texts, y)]) + ordinal_quality.SHRINK / 2 * float((p[cuts:] ** 2).sum())

    after = ordinal_quality._epoch(cuts)(OneBatch(texts, y), params.copy(), 0)
    assert gradient_of_step(params, after, ordinal_quality.STEP) == pytest.approx(numeric_gradient(loss, params), rel=1e-3, abs=1e-6)


def test_one_document_a_labelled_id(spark):
    from tessaro.llm.hashed_text import labelled_terms

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, None), (2, "b"), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 1)], "doc_id long, y int")
    assert sorted(r["y"] for r in labelled_terms(docs, labels, 100, 4).collect()) == [0, 1]
