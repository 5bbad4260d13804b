import math

import numpy as np

from tessaro.llm import topk_search
from tessaro.llm.topk_search import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def whole(score):
    return max(-(2**63), min(2**63 - 1, score))


def component(x):
    return math.floor(max(-(2.0**62), min(2.0**62, 1024 * float(np.float32(x)))))


def brute(queries, rows, k):
    ok = [(i, [component(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted(set(queries)):
        for vq in [v for i, v in ok if i == q][:1]:
            found = sorted((-whole(sum(a * b for a, b in zip(vq, v))), i) for i, v in ok if i != q and len(v) == len(vq))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return out


def run(spark, rows, k):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    got = top_k(df.where("vec_id % 10 = 0"), df, k).orderBy("query_id", "rank").collect()
    return [tuple(r) for r in got], [i for i, _ in rows if i is not None and i % 10 == 0]


def test_matches_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(80)]
    rows[7] = (7, rows[6][1])
    rows[21] = (21, None)
    rows[22] = (22, [1.0, None, 0.0, 0.0, 0.0, 0.0])
    rows[30] = (30, [float("nan")] * 6)
    rows[31] = (31, [float("inf")] * 6)
    rows[33] = (None, rows[1][1])
    rows[34] = (34, [1.0, 2.0])
    rows += [(12, rows[12][1]), (40, rows[40][1])]
    got, queries = run(spark, rows, 10)
    assert got == brute(queries, rows, 10)


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    got, queries = run(spark, rows, 10)
    assert got == brute(queries, rows, 10) and len(got) == 2
    assert run(spark, [(0, [1.0])], 10)[0] == []
    assert run(spark, [(None, None)], 10)[0] == []
    empty = spark.createDataFrame([], SCHEMA)
    assert top_k(empty, empty).count() == 0


def test_large_values_stay_exact(spark):
    rows = [(i, [2e6 - i, 1e6 + i]) for i in range(12)] + [(20 + i, [2.9e6 - i, 1.0 * i]) for i in range(2)]
    got, queries = run(spark, rows, 3)
    assert got == brute(queries, rows, 3)


def test_values_beyond_64_bits_count_as_the_last_that_fit(spark):
    big = [3e38, -3e38, 1e20, -1e20, 1.0, -1.0]
    rows = [(i, [a, b]) for i, (a, b) in enumerate((a, b) for a in big for b in big)]
    got, queries = run(spark, rows, 5)
    assert got == brute(queries, rows, 5) and {s for *_, s in got} >= {2**63 - 1}


def test_grid_of_many_tiles_and_shards(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=70)]) for i in range(300)]
    for name, value in (("TILE_ROWS", 4), ("SHARD_ROWS", 8), ("CELL_TILES", 2), ("CELL_SHARDS", 3)):
        monkeypatch.setattr(topk_search, name, value)
    got, queries = run(spark, rows, 7)
    assert got == brute(queries, rows, 7)


def test_of_several_queries_of_one_id_the_least_asks(spark):
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (1, [-1.0, 0.0]), (1, [-1.0, 5.0])], "vec_id long, embedding array<double>")
    candidates = spark.createDataFrame([(5, [1.0, 0.0]), (6, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in top_k(queries, candidates, k=1, scale=1).collect()] == [(6, 1)]
