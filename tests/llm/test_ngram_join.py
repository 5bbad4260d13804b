import random
from collections import Counter

from tessaro.llm import ngram_join
from tessaro.llm.ngram_join import TrieJoin, keep_one, ngram_components

from .corpus import SCHEMA, corpus, frame, sentence, words


def shingles(text, n):
    w = [x.lower() for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows, n, percent):
    """(doc_id, size, component) of every row."""
    sets = [shingles(r[1], n) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), (r[0] if not sets[i] else min(ids) if ids else None)))
    return out


def near_copies(seed=1):
    rng = random.Random(seed)
    rows = []
    for group in range(12):
        base = sentence(rng, rng.choice([4, 9, 40, 120])).split()
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = sentence(rng, 1)
            rows.append((" ".join(copy),))
    rng.shuffle(rows)
    return [(i, t, "en", "s", len(t)) for i, (t,) in enumerate(rows)]


def run(spark, rows, n, percent):
    return Counter(tuple(r) for r in ngram_components(frame(spark, rows), n, percent).collect())


def test_matches_all_pairs(spark):
    for rows, n, percent in ((corpus(), 4, 85), (near_copies(), 4, 85), (near_copies(2), 5, 80), (near_copies(3), 2, 60)):
        assert run(spark, rows, n, percent) == Counter(brute(rows, n, percent))


def test_blocks_of_several_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_ELEMENTS", 150)
    rows = near_copies(4)
    assert run(spark, rows, 4, 85) == Counter(brute(rows, 4, 85))


def test_empty_table(spark):
    assert ngram_components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one(spark):
    rows = [*corpus(), *[(1000 + r[0], *r[1:]) for r in near_copies()]]
    df = frame(spark, rows)
    out = keep_one(df, 5, 80)
    assert out.columns == df.columns
    found = brute(rows, 5, 80)
    want = {c for d, n, c in found if n} | {d for d, n, _ in found if not n}
    got = [r["doc_id"] for r in out.collect()]
    assert set(got) == want and len([d for d in got if d is not None]) == len(want - {None})


def test_trie_links_connect_what_pairs_connect():
    rng = random.Random(9)
    for percent in (50, 80, 85):
        sets = []
        for _ in range(6):
            base = rng.sample(range(200), rng.randint(1, 30))
            sets += [sorted(set(base) - set(rng.sample(base, rng.randint(0, len(base) // 5))) | set(rng.sample(range(200), rng.randint(0, 3)))) for _ in range(12)]
        sets = sorted((s for s in {tuple(x) for x in sets} if s), key=len)
        trie = TrieJoin(percent)
        for s in sets:
            trie.add(list(s))
        parent = list(range(len(sets)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b)):
                    parent[find(i)] = find(j)
        together = lambda f: {(i, j) for i in range(len(sets)) for j in range(i) if f(i) == f(j)}
        assert together(trie.find) == together(find)
        for a, b in trie.links:
            x, y = set(sets[a]), set(sets[b])
            assert 100 * len(x & y) >= percent * len(x | y)


def test_equal_rows_are_verified_once(spark):
    from pyspark.sql import functions as F

    from tessaro.llm.ngram_join import _one_row_each

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text)] * 300 + [(2, text + " end"), (3, None), (3, None), (None, "a b"), (None, "a b"), (4, "x")]
    read = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    one = _one_row_each(read, read.select("doc_id", "text_hash"))
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in one.collect()))) == sorted(map(str, set(rows)))
    got = {(r["doc_id"], r["component_id"]) for r in ngram_components(read.drop("text_hash"), n=4, percent=85).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (None, None), (4, 4)}


def test_only_texts_in_blocks_travel(spark, monkeypatch):
    seen, whole = [], ngram_join._all_links
    monkeypatch.setattr(ngram_join, "_all_links", lambda docs, members, join: seen.append(docs.count()) or whole(docs, members, join))
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, " ".join(f"{i}x{k}" for k in range(30)), "en", "s", 0) for i in range(300)] + [(1000, text, "en", "s", 0), (1001, text + " end", "en", "s", 0)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_components(frame(spark, rows), 4, 85).collect()}
    assert got == {r[0]: min(r[0], 1000) for r in rows} and 2 <= seen[0] < 20


def test_only_rows_of_groups_travel_when_one_is_kept(spark, monkeypatch):
    seen, whole = [], ngram_join.join_on

    def join_on(left, right, *more):
        seen.extend([left.count()] if "row" in left.columns else [])
        return whole(left, right, *more)

    monkeypatch.setattr(ngram_join, "join_on", join_on)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, " ".join(f"{i}x{k}" for k in range(30)), "en", "s", 0) for i in range(300)] + [(1000, text, "en", "s", 0), (1001, text + " end", "en", "s", 0)]
    rows += [(2000, "a b", "en", "s", 0), (2000, "a b", "fr", "s", 0), (2001, None, "en", "s", 0), (2001, None, "en", "t", 0), (None, None, "en", "s", 0)]
    got = [r["doc_id"] for r in keep_one(spark.createDataFrame(rows, SCHEMA), 4, 85).collect()]
    assert sorted(got, key=str) == sorted([*range(300), 1000, 2000, 2001, None], key=str) and 5 <= seen[-1] < 20


def test_counts_of_one_byte_and_more():
    import numpy as np
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array(["a b c d"] * 300 + ["e f g h"])})
    sent = list(ngram_join._counter(4, 21)(iter([batch])))
    assert sorted(len(x) for b in sent for x in b.column(1).to_pylist()) == [2**14, 2**16]
    levels = [x for b in ngram_join._adder(iter(sent + sent)) for x in b.column(1).to_pylist()]
    assert sorted(max(x) for x in levels) == sorted(int(12 * np.log2(1 + n)) for n in (2, 600))


def test_what_many_share_chains_no_blocks_where_the_sketch_is_full(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    calls, seen, levels, links = [], [], ngram_join.frequency_levels, ngram_join._all_links

    def first_full(*args):
        calls.append(args)
        return levels(*args) if len(calls) > 1 else np.full(2**21, 99, np.uint8)

    def all_links(docs, members, join):
        seen.append(members.groupBy("block").count().agg(F.max("count")).first()[0])
        return links(docs, members, join)

    monkeypatch.setattr(ngram_join, "frequency_levels", first_full)
    monkeypatch.setattr(ngram_join, "_all_links", all_links)
    rng = random.Random(5)
    often = [" ".join(f"o{i}x{k}" for k in range(6)) for i in range(12)]
    rows = []
    for i in range(60):
        text = " ".join([*(f"{i}x{k}" for k in range(90)), *rng.sample(often, 4)])
        rows += [(2 * i, text, "en", "s", 0), (2 * i + 1, text + " end", "en", "s", 0)]
    assert run(spark, rows, 4, 85) == Counter(brute(rows, 4, 85))
    assert seen[0] <= 4


def test_counts_of_few_places_and_many():
    import numpy as np
    import pyarrow as pa

    for many, size in ((3, 9), (5000, 2**14)):
        counts = np.zeros(2**14, np.uint32)
        counts[np.arange(many) * 3] = np.arange(many) % 255 + 1
        sent = ngram_join._sent(counts, True)
        assert len(sent) == size and (ngram_join._received(pa.py_buffer(sent)) == counts).all()
