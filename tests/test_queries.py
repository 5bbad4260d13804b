"""Every registered query with SQL against DuckDB on small tables made here."""

from __future__ import annotations

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessaro.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _sentence(rng, n):
    return " ".join("".join(rng.choices("abcdehilnorst", k=rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = random.Random(11)
    sf = str(tmp_path_factory.mktemp("sf"))
    day = datetime.datetime(1993, 1, 1)

    def write(name, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{sf}/{name}.parquet")

    docs = []
    for i in range(120):
        text = "\n".join(_sentence(rng, rng.randint(2, 25)) for _ in range(rng.randint(1, 8)))
        text += rng.choice(["", "\n----- | ---", "\n a b c d e", " Clown", " a moron here", " clown moron clown"])
        docs.append((i, text, rng.choice(["en", "fr"]), f"src{i % 12}", len(text)))
    write("documents", "doc_id long, text string, lang string, source string, n_chars long", docs)
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(120)]
    write("embeddings", "vec_id long, embedding array<float>, label int", [(i, v, 0) for i, v in enumerate(vectors)])
    turns = [(c, t, rng.choice(["user", "assistant", "system"]), _sentence(rng, rng.randint(1, 200))) for c in range(20) for t in range(rng.randint(2, 9))]
    write("conversations", "conv_id long, turn long, role string, text string", turns)
    html = '<html><STYLE>p</STYLE><script type="x">var a="<b>";</script><p class=x>{}</p>&amp; end</html>'
    write("pages", "page_id long, url string, html string", [(i, f"http://a.example.com/{i}?a=1&b=2", html.format(_sentence(rng, 9))) for i in range(30)])
    kinds = ["click", "error", "view", "warning", "purchase"]
    events = [(i, day + datetime.timedelta(seconds=7 * i), i % 9, rng.choice(kinds), 1.5, f'{{"k": {i % 5}}}') for i in range(900)]
    write("events", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", events)
    write("labels", "doc_id long, quality int, toxic int", [(i, i % 2, i % 3 % 2) for i in range(80)])
    write("benchmark", "item_id long, text string", [(i, _sentence(rng, 12) + " the And which naïve_word") for i in range(15)])
    write("region", "r_regionkey int, r_name string", [(i, f"R{i}") for i in range(5)])
    write("nation", "n_nationkey int, n_name string, n_regionkey int", [(i, f"N{i}", i % 5) for i in range(25)])
    segments = ["BUILDING", "MACHINERY", "HOUSEHOLD"]
    write("customer", "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(i, f"Customer#{i:09d}", i % 25, i * 37 % 1000 - 99.5, segments[i % 3]) for i in range(1, 150)])
    write("supplier", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(i, f"Supplier#{i}", i % 9, i * 1.5) for i in range(60)])
    write("part", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(i, f"part {i % 50} {i}", f"Brand#{i % 12}", "T", i * 7 % 50, 900 + i / 4) for i in range(200)])
    orders = [(i, i % 99, "FOP"[i % 3], 100000 + i * 311.25, day + datetime.timedelta(days=i * 3), f"{i % 5}-P") for i in range(400)]
    write("orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string", orders)
    items = [(i // 3, i, i, i % 3, float(i % 50), i * 10.25, 0.05, 0.02, "N", "O", day) for i in range(500)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    write("lineitem", schema, items)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    return sf, con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    return float(value) if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, name):
    sf, con = data
    got = catalog.QUERIES[name](spark, sf)
    rows = got.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    pick = sorted(want.columns)
    mine = sorted((tuple(_plain(r[c]) for c in pick) for r in rows), key=repr)
    at = [want.columns.index(c) for c in pick]
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert mine == theirs


def test_lsh_finds_most_neighbours(spark):
    from tessaro.operators import retrieval

    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(500)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").cache()
    asked = chunks.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    near = {(r["query_id"], r["chunk_id"]) for r in retrieval.lsh_search(chunks, asked).collect()}
    exact = set()
    for i, v in rows[::50]:
        one = spark.createDataFrame([(v,)], "query array<float>")
        exact |= {(i, r["chunk_id"]) for r in retrieval.semantic_search(chunks, one).collect()}
    assert len(exact & near) >= 0.9 * len(exact) == 360


def test_profile_takes_every_row(spark, tmp_path):
    n = 10**6 + 7
    spark.range(n).selectExpr("id as c_custkey", "cast(id % 25 as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["column_name"]: (r["n"], r["max_value"]) for r in catalog.QUERIES["csv_profile"](spark, str(tmp_path)).collect()}
    assert got == {"c_custkey": (n, n - 1.0), "c_nationkey": (n, 24.0)}


def test_lsh_leaves_out_vectors_without_a_distance(spark):
    from tessaro.operators import retrieval

    rows = [(i, [0.0, 0.0]) for i in range(5)] + [(5, [-1.0, -2.0, 0.0]), (6, [-1.0, -2.0]), (7, [-1.0, -2.1])]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    one = spark.createDataFrame([(1, [-1.0, -2.0]), (2, None), (None, [1.0, 1.0])], "query_id long, query array<float>")
    got = retrieval.lsh_search(chunks, one, 2).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["chunk_id"]) for r in got] == [(1, 1, 6), (1, 2, 7)]
