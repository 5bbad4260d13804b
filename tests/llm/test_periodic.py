import hashlib
import random
import zlib
from collections import Counter

import pytest

from tessaro.llm import tandem
from tessaro.llm.periodic import collapse_runs, find_runs, run_report, run_table

from .corpus import SCHEMA, corpus, frame, sentence, words


def plain_runs(x, least=2):
    """Every stretch of every period, by definition."""
    out = []
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least and not any(all(x[a] == x[a + d] for a in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_against_their_definition():
    rng = random.Random(1)
    for _ in range(3000):
        k = rng.choice([1, 2, 2, 3, 4])
        x = [rng.randrange(k) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.4:
            a, p = rng.randint(0, 20), [rng.randrange(k) for _ in range(rng.randint(1, 9))]
            x[a:a] = p * rng.randint(2, 4)
        assert tandem.runs(x) == plain_runs(x), x


def test_only_repeating_stretches_matter():
    rng = random.Random(2)
    for _ in range(300):
        x = [rng.randrange(3000) for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 4)):
            a, p = rng.randint(0, len(x)), [rng.randrange(rng.choice([2, 3000])) for _ in range(rng.randint(1, 30))]
            x[a:a] = (p * 5)[: rng.randint(1, 5 * len(p))]
        x += x[: rng.randint(0, 60)]
        assert find_runs([b"%d" % i for i in x]) == plain_runs(x, 12)


def test_long_sequences_stay_linear():
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    assert tandem.runs([0] * 20_000) == [(0, 20_000, 1)]
    assert tandem.runs(list(range(20_000)) * 2) == [(0, 40_000, 20_000)]
    assert len(tandem.runs(b)) == 21_889  # as many as lengths of such strings have


def expected(doc_id, text, planted=True):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    # Long texts of these tests repeat nothing by themselves.
    found = plain_runs(w, 12) if len(w) < 2000 else []
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in found), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_report(spark):
    rng = random.Random(3)
    rows = corpus(5, 150)
    unit = sentence(rng, 7)
    rows += [(900 + i, f"{sentence(rng, i)} {' '.join([unit] * (i + 1))}\t{sentence(rng, 3)}", "en", "s", 0) for i in range(40)]
    rows = [r for r in rows if not (len(words(r[1])) >= 2000 and zlib.crc32(str(r[0]).encode()) % 10 == 0)]
    got = Counter(tuple(r) for r in run_report(frame(spark, rows)).collect())
    assert got == Counter(expected(r[0], r[1]) for r in rows)
    assert sum(r[1] > 0 for r in got) > 40 and any(r[0] is None for r in got)


def test_collapse_keeps_rows_and_columns(spark):
    text = "a b c " * 6 + "d"
    df = frame(spark, [(1, text, "en", "s", 1), (2, "x  y\n", None, None, None), (3, None, "en", "s", 0), (1, text, "en", "s", 1)])
    out = collapse_runs(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, "a b c d"), (1, "a b c d"), (2, "x  y\n"), (3, None)]
    runs = run_table(df).where("doc_id = 1").first()["runs"]
    assert [tuple(r) for r in runs] == [(0, 18, 3)]


def test_empty_table_and_bounds(spark):
    assert run_report(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        run_table(spark.createDataFrame([], SCHEMA), least=4)
