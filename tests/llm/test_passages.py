import random
from collections import Counter

import pytest

from tessaro.llm.passages import dedup_passages, passage_report

from .corpus import SCHEMA, corpus, frame, words


def brute(rows, least):
    """The words left, by the plain rule: a run of ``least`` words goes if its first occurrence, in id order, lies wholly before it."""
    first, left = {}, {}
    for doc_id, text in sorted(rows):
        w = words(text)
        gone = set()
        for i in range(len(w) - least + 1):
            where, at = first.setdefault(tuple(w[i : i + least]), (doc_id, i))
            if where != doc_id or at + least <= i:
                gone.update(range(i, i + least))
        left[doc_id] = [x for i, x in enumerate(w) if i not in gone]
    return left


@pytest.mark.parametrize("least,most", [(1, 10**6), (6, 10**6), (15, 10**6), (50, 10**6), (6, 0), (50, 0)])
def test_matches_all_runs(spark, least, most):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(r[0], r[1]) for r in corpus(n=30) if r[0] is not None][:-1]
    extra = [f"{a} {b} {c}", f"x {a}\n{b}\n\n{c} y", f"p q {b}\n{c} {a} r\ns", f"{a} {a}\n{a} {a}", "u v w " * 40, f"x {a}\n{b}\n\n{c} y", f"\n \n{a} {b}\n{c}\n", "z " * 120, f"{c} {b} " * 4]
    rows += [(1000 + i, t) for i, t in enumerate(extra)]
    got = passage_report(frame(spark, [(d, t, "en", "s", 0) for d, t in rows]), least, bitmap_most=most).collect()
    want = brute(rows, least)
    assert {r["doc_id"]: words(r["text"]) for r in got} == want
    assert {r["doc_id"]: r["removed_words"] for r in got} == {d: len(words(t)) - len(want[d]) for d, t in rows}
    assert all(r["text"] == dict(rows)[r["doc_id"]] for r in got if not r["removed_words"])


@pytest.mark.parametrize("seed", range(6))
def test_random_words_of_few_kinds(spark, seed):
    """Few kinds of words: runs overlap, nest, meet others' ends and repeat in their own text."""
    rng = random.Random(seed)
    pool = [[rng.choice("abcd") for _ in range(rng.randint(3, 25))] for _ in range(6)]
    rows = [(d, " ".join(" ".join(rng.choice(pool)) for _ in range(rng.randint(1, 9)))) for d in range(60)]
    got = passage_report(frame(spark, [(d, t, "en", "s", 0) for d, t in rows]), 10).collect()
    assert {r["doc_id"]: words(r["text"]) for r in got} == brute(rows, 10)


def test_the_first_of_overlapping_repeats_stays(spark):
    line = " ".join(f"w{i}" for i in range(25))
    got = passage_report(frame(spark, [(1, "\n".join([line] * 10), "en", "s", 0)])).collect()
    assert got[0]["text"] == f"{line}\n{line}" and got[0]["removed_words"] == 200


def test_passage_inside_a_line(spark):
    p = [f"w{i}" for i in range(60)]
    run = " ".join(p)
    broken = " ".join(p[:30]) + "\n\n" + " ".join(p[30:])
    rows = [(1, f"one {run} two", "en", "s", 0), (2, f"  three {run}  four ", "en", "s", 0), (3, f"five {broken} six\nend", "en", "s", 0), (4, run, "en", "s", 0), (5, None, None, None, None), (None, "", "en", "s", 0)]
    df = frame(spark, rows)
    report = {r["doc_id"]: (r["text"], r["removed_lines"], r["removed_words"]) for r in passage_report(df).collect()}
    assert report == {1: (rows[0][1], 0, 0), 2: ("  three four ", 0, 60), 3: ("five\nsix\nend", 1, 60), 4: ("", 1, 60), 5: (None, 0, 0), None: ("", 0, 0)}
    out = dedup_passages(df)
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} == {1, 2, 3, 5, None}


def test_repeated_rows_and_null_ids(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(7, line, "en", "s", 0)] * 2 + [(None, line + " z", "en", "s", 0), (8, "y " + line, "en", "s", 0)]
    got = Counter((r["doc_id"], r["text"]) for r in passage_report(frame(spark, rows)).collect())
    assert got == Counter({(None, line + " z"): 1, (7, ""): 2, (8, "y"): 1})
    assert passage_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_and_stage_cut_inside_lines(spark, tmp_path):
    import corpus_pipeline
    from tessaro.llm.queries import op3_line_dedup

    run = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"one {run} two", "en", "s", 0), (2, f"three {run} four", "en", "s", 0)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["removed_words"] for r in op3_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 60}
    assert {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, str(tmp_path)).collect()}[2] == "three four"


def test_words_of_many_texts_are_hashed_at_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tessaro.llm import passages

    rng = random.Random(4)
    texts = [rng.choice(["", " \n", "a", "ab", "ü b", "x" * 300])] + ["".join(rng.choice("ab \n\té") for _ in range(rng.randint(0, 400))) for _ in range(80)] + [None, "y" * 90 + " z"]
    batch = pa.record_batch({"text": pa.array(texts)})
    known, seen = {}, 0
    monkeypatch.setattr(passages, "SEGMENT", 64)
    data = [(t or "").encode() for t in texts]
    for group in (data, *[[t] for t in data]):
        hashes, counts = passages.word_hashes(np.frombuffer(b"".join(group), np.uint8), np.cumsum([0, *map(len, group)]))
        want = [w for t in group for w in t.split()]
        assert counts.tolist() == [len(t.split()) for t in group] and len(hashes) == len(want)
        assert all(known.setdefault(w, h) == h for w, h in zip(want, hashes.tolist()))
    assert len(set(known.values())) == len(known)
    for least in (3, 10):
        found = []
        for size in (1, 500, 2**20):
            monkeypatch.setattr(passages, "GROUP", size)
            rows = [x for low, _, s in passages._texts(batch, least) for x in zip((low + s.row).tolist(), s.first.tolist(), s.last.tolist(), s.fingerprints.tolist(), s.wholes.tolist())]
            found.append(rows)
            seen += len(rows)
        assert found[0] == found[1] == found[2]
        assert {r[0] for r in found[0]} == {i for i, t in enumerate(data) if len(t.split()) >= least}
    assert seen > 500


def test_only_texts_with_cuts_travel(spark):
    run = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"one {run}", "en", "s", 0), (2, f"two {run}", "en", "s", 0)] + [(i, f"text {i}", "en", "s", 0) for i in range(3, 400)]
    report = passage_report(frame(spark, rows))
    assert {r["doc_id"]: r["text"] for r in report.collect()} == {1: rows[0][1], 2: "two"} | {r[0]: r[1] for r in rows[2:]}
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Join") == 1 and plan.count("ArrowEvalPython") == 2
