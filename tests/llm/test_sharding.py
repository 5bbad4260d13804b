import math
import zlib
from collections import Counter, defaultdict

from tessaro.llm.sharding import tree_shards

from .corpus import SCHEMA, corpus, frame


def test_sizes_slots_and_groups(spark):
    rows = [r for r in corpus(n=900, seed=3) if not (r[1] and len(r[1]) > 5000)]
    got = tree_shards(frame(spark, rows), 24).collect()
    assert len(got) == len(rows)
    bytes_of = Counter()
    slots = defaultdict(list)
    shards_of = defaultdict(set)
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for r in got:
        bytes_of[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        shards_of[r["text_crc32"]].add(r["shard"])
    mean = sum(bytes_of.values()) / 24
    assert set(bytes_of) == set(range(24))
    assert all(0.85 * mean < b < 1.15 * mean for b in bytes_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards_of.values())


def test_copies_too_many_for_a_shard_are_told_apart(spark):
    rows = [(i, "the same text " * 20, "en", "s", 0) for i in range(400)] + [(1000 + i, f"text {i} " * 30, "fr", "t", 0) for i in range(200)]
    got = tree_shards(frame(spark, rows), 8).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.2 * min(sizes.values()) and len(sizes) == 8


def test_few_rows_and_none(spark):
    assert tree_shards(spark.createDataFrame([], SCHEMA)).count() == 0
    few = tree_shards(spark.createDataFrame([(1, "a", None, None, 1), (None, None, None, None, None)], SCHEMA)).collect()
    assert len(few) == 2 and all(0 <= r["shard"] < 24 for r in few)
    alike = tree_shards(spark.createDataFrame([(1, "a", "en", "s", 1)] * 5, SCHEMA)).collect()
    assert len(alike) == 5
    no_metadata = tree_shards(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).collect()
    assert len(no_metadata) == 2


def cut(rows, leaves, dims, widths, first=0):
    """The plain k-d tree: rows of (coordinates, tie, size); returns {row number: shard}."""
    if leaves == 1 or not rows:
        return {r[0]: first for r in rows}
    spread = [(max(r[1][d] for r in rows) - min(r[1][d] for r in rows)) / (widths[d] or 1.0) for d in range(dims)]
    d = max(range(dims), key=lambda i: (spread[i], -i))
    left, goal, run, last = leaves // 2, sum(r[3] for r in rows) * (leaves // 2) / leaves, 0, None
    cells = defaultdict(int)
    for _, x, tie, size in rows:
        cells[x[d], tie] += size
    for code in sorted(cells):
        run += cells[code]
        if run >= goal:
            last = code if run - goal <= goal - (run - cells[code]) else None
            break
        last_before = code
    if last is None:
        last = last_before if run > cells[code] else (float("-inf"), 0)
    lower = [r for r in rows if (r[1][d], r[2]) <= last]
    upper = [r for r in rows if (r[1][d], r[2]) > last]
    return cut(lower, left, dims, widths, first) | cut(upper, leaves - left, dims, widths, first + left)


def test_cuts_are_those_of_the_plain_tree(spark):
    """Distinct texts of one weight class, long names that differ late, two dimensions of strings: shards as by plain recursion."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(7)
    rows = [(i, f"{i} " + "w" * rng.randint(1, 90), rng.choice(["en", "fr", "de", None]), f"https://site{rng.randint(0, 12):02d}.example.com", 0) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["shard"] for r in tree_shards(df, 12, ("source", "lang")).collect()}
    limit = sum(len(r[1]) + 8 for r in rows) / 12
    hashes = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    ranks = [{v: i for i, v in enumerate(sorted({r[c] for r in rows}, key=lambda v: (v is None, v)))} for c in (3, 2)]
    plain = []
    for i, text, lang, source, _ in rows:
        size = len(text) + 8
        weight = min(15, math.floor(math.log2(limit / size)))
        tie = (weight << 20) + ((hashes[i] & (2**64 - 1)) >> 44)
        plain.append((i, (ranks[0][source], ranks[1][lang]), tie, size))
    assert got == cut(plain, 12, 2, [len(r) - 1 for r in ranks])


def test_long_names_separate_as_short_ones_do(spark):
    rows = [(i, f"text {i} " * 9, "en", f"{i % 10}", 0) for i in range(400)]
    short = tree_shards(spark.createDataFrame(rows, SCHEMA), 4, ("source",)).collect()
    long = tree_shards(spark.createDataFrame([(i, t, x, f"https://the-same-beginning.example/{s}", n) for i, t, x, s, n in rows], SCHEMA), 4, ("source",)).collect()
    assert {(r["doc_id"], r["shard"]) for r in long} == {(r["doc_id"], r["shard"]) for r in short}
    places = defaultdict(set)
    for r in long:
        places[r["doc_id"] % 10].add(r["shard"])
    assert max(map(len, places.values())) <= 2 and sum(len(p) > 1 for p in places.values()) <= 3


def test_copies_stay_together_up_to_a_shard(spark):
    rows = [(i, f"one text of its own {i} " * 5, "en", f"s{i % 3}", 0) for i in range(300)]
    rows += [(1000 + i, "copied " * 17, "en", f"s{i % 3}", 0) for i in range(30)]
    got = tree_shards(spark.createDataFrame(rows, SCHEMA), 8).collect()
    assert len({r["shard"] for r in got if r["doc_id"] >= 1000}) == 1
