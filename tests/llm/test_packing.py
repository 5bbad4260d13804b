import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessaro.llm.packing import _ids, crossover, evolve, fitted, pack, token_bytes, tokenizer_path

from .corpus import SCHEMA, corpus, frame

TOKENIZER = Tokenizer.from_file(tokenizer_path())


def reference_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize(
    "text",
    [None, "", " ", "plain words", "don't I'll x's|| it's", "12a.b é", "Á x̀y İ \xa0 a\x1cb  z ǅ", "A<|endoftext|>b <|ENDOFTEXT|> c", "thoner$$$ to%%% (the&&& \"a\"!?", "漢字 ｗｉｄｅ   line", "#### ...", "é É"],
)
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(token_bytes(text, _ids(tokenizer_path())), "<u4").tolist() == reference_ids(text)


def test_every_piece_once_and_gapless(spark):
    rows = corpus(n=120)
    capacity = 512
    got = pack(frame(spark, rows), capacity=capacity).collect()
    want = defaultdict(int)
    for r in rows:
        ids = reference_ids(r[1])
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4").tobytes()
            want[r[0], k, at, len(part) // 4, zlib.crc32(part)] += 1
    have = defaultdict(int)
    sequences = defaultdict(list)
    for r in got:
        have[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r["length"] for r in got) // capacity)
    assert len(sequences) <= least + 1


def test_empty(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def plan(lengths, capacity, seed):
    return fitted(np.random.default_rng(seed).permutation(len(lengths)), lengths, capacity)


def test_crossover_keeps_every_piece_and_capacity():
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.integers(1, 100, 300))[::-1].astype(np.int64)
    a, b = plan(lengths, 100, 1), plan(lengths, 100, 2)
    for g in range(1, 20):
        child = crossover(a, b, lengths, 100, rng, g)
        assert len(child.bins) == 300 and 0 < child.fill.min() and child.fill.max() <= 100 and child.fill.sum() == lengths.sum()
        assert child.born.max() == g and len(child.born) == child.count
        a, b = b, child


def triplets(n):
    """Pieces that fill n bins exactly by threes: best fit decreasing needs more."""
    rng = np.random.default_rng(0)
    out = []
    for _ in range(n):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1000 - a) // 2 + 1))
        out += [a, b, 1000 - a - b]
    return np.sort(np.array(out))[::-1].astype(np.int64)


def test_crossover_lowers_the_count_of_the_first_population():
    rng = np.random.default_rng(1)
    for lengths, capacity in ((np.sort(rng.integers(1, 300, 2000))[::-1].astype(np.int64), 1000), (triplets(200), 1000)):
        first = min(fitted(np.random.default_rng([9, 0, 2]).permutation(len(lengths)), lengths, capacity).count, *[plan(lengths, capacity, s).count for s in range(4)])
        elite = [evolve(lengths, 2, [], capacity, 0, 9)]
        assert elite[0].count < first and (elite[0].born > 0).any()
        for epoch in (1, 2):
            elite = [evolve(lengths, 2, elite, capacity, epoch, 9)]
        greedy = fitted(np.arange(len(lengths)), lengths, capacity)
        assert elite[0].count <= greedy.count


def test_crossover_beats_best_fit_decreasing():
    lengths = triplets(200)
    greedy = fitted(np.arange(len(lengths)), lengths, 1000)
    elites = [evolve(lengths, i, [], 1000, 0, 3) for i in range(3)]
    for epoch in range(1, 12):
        elites = [evolve(lengths, i, [elites[i], elites[(i + 1) % 3]], 1000, epoch, 3) for i in range(3)]
    assert min(e.count for e in elites) < greedy.count


def test_the_plan_comes_from_offspring(spark):
    sizes = np.random.default_rng(2).integers(3, 90, 600).tolist()
    rows = [(i, " ".join(["word"] * n), "en", "s", 0) for i, n in enumerate(sizes)]
    got = pack(spark.createDataFrame(rows, SCHEMA), capacity=128).collect()
    born = {r["sequence_id"]: r["born"] for r in got}
    assert sum(b > 0 for b in born.values()) > len(born) / 4
    least = -(-sum(r["length"] for r in got) // 128)
    assert len(born) <= least + 1
    again = pack(spark.createDataFrame(rows, SCHEMA).repartition(5), capacity=128).collect()
    assert sorted(again) == sorted(got)


def test_pieces_that_fill_a_sequence_stay_outside_the_groups(spark, monkeypatch):
    from tessaro.llm import packing

    seen = []
    whole = packing._applier
    monkeypatch.setattr(packing, "BLOCK_PIECES", 10)
    monkeypatch.setattr(packing, "_applier", lambda capacity: seen.append(capacity) or whole(capacity))
    long = " ".join(f"word{i}" for i in range(900))
    rows = [(i, long, "en", "s", 0) for i in range(12)] + [(99, "short", "en", "s", 0)]
    got = pack(frame(spark, rows), capacity=32).collect()
    full = [r for r in got if r["length"] == 32]
    assert len(full) > 500 and all(r["offset"] == 0 and r["born"] is None and r["sequence_id"] < 0 for r in full)
    assert len({r["sequence_id"] for r in full}) == len(full) and seen == [32]
    rest = [r for r in got if r["length"] < 32]
    assert {r["doc_id"] for r in rest} <= {*range(12), 99} and all(r["born"] is not None and r["sequence_id"] >= 0 for r in rest)
