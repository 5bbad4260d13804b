from collections import Counter, defaultdict

import numpy as np
import pytest

from tessaro.llm import mixing
from tessaro.llm.mixing import mix_documents, mix_report, rates

from .corpus import SCHEMA, corpus, frame, words


def targets(sizes, weights=(5, 2, 1), share=1.5, ceiling=2.0):
    """Excess over the ceiling reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(ceiling * sizes[s] for s in full)
        open_w = sum(w[s] for s in names if s not in full)
        out = {s: ceiling * sizes[s] if s in full else rest * w[s] / open_w for s in names}
        over = {s for s in names if s not in full and out[s] > ceiling * sizes[s]}
        if not over:
            return out
        full |= over


def test_targets_and_takes(spark):
    rows = corpus(n=200)
    got = mix_report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = targets(sizes)
    by_id = {r[0]: r for r in rows if r[0] is not None}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        if r["doc_id"] is not None:
            row = by_id[r["doc_id"]]
            assert r["size"] == len(words(row[1])) and r["source_size"] == sizes[row[3]]
            assert abs(r["target"] - want[row[3]]) < 1e-6 * max(1, want[row[3]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        source = next(s for s in sizes if sizes[s] == r["source_size"])
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 0.5 * largest[s] if largest[s] > 1000 else 12)
    again = mix_report(frame(spark, rows)).collect()
    assert Counter(again) == Counter(got)


def test_documents_are_repeated_as_reported(spark):
    rows = corpus()
    df = frame(spark, rows)
    report = Counter()
    for r in mix_report(df).collect():
        report[r["doc_id"]] += r["copies"] if r["size"] else 1
    out = mix_documents(df)
    assert out.columns == df.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +report


def test_empty_and_wordless(spark):
    assert mix_report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mix_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(1, "", None, None, 0), (2, None, None, "a", None)], SCHEMA)
    assert [(r["size"], r["taken"], r["target"]) for r in mix_report(only).collect()] == [(0, 0, 0.0)] * 2


def raked(cells, rows, columns):
    """Iterative proportional fitting of words to row and column targets, by plain loops."""
    mass = {k: float(w) for k, w in cells.items()}
    for _ in range(5000):
        for at, aims in ((0, rows), (1, columns)):
            for v, aim in aims.items():
                now = sum(m for k, m in mass.items() if k[at] == v)
                mass = {k: m * aim / now if k[at] == v and now else m for k, m in mass.items()}
    return {k: mass[k] / cells[k] for k in cells}


def test_coupled_constraints_match_raking(spark):
    rng = np.random.default_rng(4)
    sources, langs = ["a", "b", "c", None], ["en", "fr", None]
    cells = {(s, x): int(rng.integers(50, 900)) for s in sources for x in langs if (s, x) != ("b", "fr")}
    tilt = {k: float(np.exp(rng.normal(0, 0.6))) for k in cells}
    rows = {s: sum(cells[k] * tilt[k] for k in cells if k[0] == s) for s in sources}
    columns = {x: sum(cells[k] * tilt[k] for k in cells if k[1] == x) for x in langs}
    df = spark.createDataFrame([(*k, w) for k, w in cells.items()], "source string, lang string, words long")
    targets = spark.createDataFrame(list(rows.items()), "source string, target double")
    got = {(r["source"], r["lang"]): r["rate"] for r in rates(df, "source", targets, {"lang": columns}).collect()}
    want = raked(cells, rows, columns)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-5) for k in want)
    # The entropy condition: the logarithm of the rates is a sum of a source's and a language's dual.
    assert np.log(got["a", "en"] / got["a", "fr"]) == pytest.approx(np.log(got["c", "en"] / got["c", "fr"]), rel=1e-5)


def test_three_families_and_impossible_targets(spark, monkeypatch):
    cells = [(s, x, z, 10 * (i + 1)) for i, (s, x, z) in enumerate((s, x, z) for s in "ab" for x in "pq" for z in "uv")]
    df = spark.createDataFrame(cells, "source string, lang string, kind string, words long")
    true = {c: np.exp(0.3 * (c[0] == "a") - 0.5 * (c[1] == "p") + 0.2 * (c[2] == "u")) for c in [c[:3] for c in cells]}
    aim = lambda at: {v: float(sum(w * true[s, x, z] for s, x, z, w in cells if (s, x, z)[at] == v)) for v in {c[at] for c in cells}}
    targets = spark.createDataFrame(list(aim(0).items()), "source string, target double")
    got = rates(df, "source", targets, {"lang": aim(1), "kind": aim(2)}).collect()
    assert all(r["rate"] == pytest.approx(true[r["source"], r["lang"], r["kind"]], rel=1e-6) for r in got)
    monkeypatch.setattr(mixing, "STEPS", 8)
    with pytest.raises(RuntimeError):
        rates(df, "source", targets, {"lang": {"p": 1.0, "q": 2.0}}).collect()


def test_rates_are_those_of_one_family_alone(spark):
    df = spark.createDataFrame([("a", 100), ("b", 50), ("c", 0), (None, 7)], "source string, words long")
    targets = spark.createDataFrame([("a", 20.0), ("b", 100.0), ("c", 0.0), (None, 7.0)], "source string, target double")
    got = {r["source"]: r["rate"] for r in rates(df, "source", targets).collect()}
    assert got == {"a": pytest.approx(0.2), "b": pytest.approx(2.0), "c": 0.0, None: pytest.approx(1.0)}
