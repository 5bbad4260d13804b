"""Cases of the reviewer's findings: results on odd inputs, and steps that grow with their input only."""

from __future__ import annotations

import random
import re

import duckdb
from pyspark.sql import functions as F

from tessaro.functions import cells
from tessaro.operators import retrieval
from tessaro.plans import catalog
from tessaro.sources import text_files


def _tables(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _same_as_sql(spark, folder, query, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES[query](spark, folder).collect())
    assert got == sorted(con.sql(catalog.ORACLE_SQL[query]).fetchall())
    return got


def test_a_negative_price_that_rounds_to_zero_keeps_its_sign(spark, tmp_path):
    prices = (149999.99, 150000.0, 150000.01, 149999.5, 149990.25)
    sf = _tables(spark, tmp_path, orders=([(4 * i + r, p) for i, p in enumerate(prices) for r in range(4)], "o_orderkey long, o_totalprice double"))
    got = dict(_same_as_sql(spark, sf, "currency_format", "orders"))
    assert [got[i] for i in range(4)] == ["$-0.00 USD", "€-0.00", "-0", "-0.0%"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lsh_compares_shards_and_makes_no_row_of_a_pair(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5 if i % 4 else 6)]) for i in range(400)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    asked = chunks.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    whole = sorted(map(tuple, retrieval.lsh_search(chunks, asked, 10).collect()))
    monkeypatch.setattr(retrieval, "SHARD_NUMBERS", 300)
    monkeypatch.setattr(retrieval, "QUERY_NUMBERS", 16)
    parts = retrieval.lsh_search(chunks, asked, 10)
    assert sorted(map(tuple, parts.collect())) == whole
    assert [r[2] for r in whole if r[0] == 1000] == list(range(1000, 1010))  # copies: the smallest ids
    assert "Join" not in _plan(parts)


def test_chunk_invariants_send_a_text_once(spark, tmp_path):
    long = " ".join(f"word{i}." for i in range(3000))
    docs = [(1, long, "en", "s", 1), (2, "short", "en", "s", 5), (3, " ", "en", "s", 1), (3, None, "en", "s", 0)]
    sf = _tables(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    got = _same_as_sql(spark, sf, "chunk_invariants", "documents")
    assert [r[0] for r in got] == [1, 2]
    assert not re.search(r"hashpartitioning\([^)]*text#", _plan(catalog.QUERIES["chunk_invariants"](spark, sf)))


def _fraction_by_all_denominators(value):
    """The method in plain Python: every denominator is tried."""
    if value is None:
        return "0"
    size = abs(value)
    whole = int(size)
    part = size - whole
    errors = [(part, 1, 0)] + [(abs(part - round(part * d) / d), d, round(part * d)) for d in range(2, 101)]
    _, den, num = min((0.0 if d > 1 and e < 1e-9 else e, d, n) for e, d, n in errors)
    sign = "-" if value < 0 else ""
    if value == 0:
        return "0"
    if part < 1e-9:
        return f"{sign}{whole}"
    if num == 0:
        return f"{sign}{whole}" if whole else "0"
    return f"{sign}{whole} {num}/{den}" if whole else f"{sign}{num}/{den}"


def test_fractions_are_those_of_all_denominators_without_trying_each(spark):
    rng = random.Random(8)
    exact = [rng.randint(0, d) / d + s for d in range(2, 101) for s in (0, 3, 1e-10, -1e-10, 1e-16)]
    between = [(a / b + (a + 1) / b) / 2 for b in range(2, 101) for a in (0, 1, b - 2, b - 1)] + [i / 10000 for i in range(0, 10001, 7)]
    values = exact + between + [rng.uniform(-3, 3) for _ in range(3000)] + [None, 0.0, -0.0, 1 - 2**-53, 0.9949, 0.995, 0.9951, 0.005, -0.3]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["x"] for r in rows.select("i", cells.fraction(F.col("v")).alias("x")).collect()}
    assert {i: (values[i], x) for i, x in got.items()} == {i: (v, _fraction_by_all_denominators(v)) for i, v in enumerate(values)}
    assert "sequence" not in str(cells.fraction(F.col("v")))


def test_rows_made_in_python_leave_in_bounded_batches(spark):
    from tessaro.sources import shared

    rows = spark.range(1000, numPartitions=1).select("id", F.lit("x").alias("t"))
    got = shared.each_row(rows, lambda i, t: [(i, k, t, None) for k in range(i % 11)], "i long, k int, t string, none double")
    assert got.count() == sum(i % 11 for i in range(1000)) > shared.MADE
    assert got.where("none is null and k < i % 11").count() == got.count()


def test_workbooks_are_opened_once(spark, tmp_path):
    parts = [(i, f"part {i}", i * 7 % 50) for i in range(1, 95)]
    sf = _tables(spark, tmp_path, part=(parts, "p_partkey long, p_name string, p_size int"))
    for query in ("workbook_rows", "workbook_statistics", "workbook_formulas", "workbook_summary", "workbook_annotations"):
        _same_as_sql(spark, sf, query, "part")
        assert "MapIn" not in _plan(catalog.QUERIES[query](spark, sf))


def test_texts_are_decoded_once_and_only_their_types_are_planned(spark, tmp_path):
    events = [(i, "click", 1) for i in range(130)]
    sf = _tables(spark, tmp_path, events=(events, "event_id long, event_type string, user_id long"))
    _same_as_sql(spark, sf, "ingest_log", "events")
    plan = _plan(catalog.QUERIES["ingest_log"](spark, sf))
    assert "Python" not in plan and "MapIn" not in plan and "Arrow" not in plan


def test_lists_of_json_are_read_by_several_tasks(spark, tmp_path):
    events = [(i, "click", i % 7, i / 2) for i in range(2000)]
    sf = _tables(spark, tmp_path, events=(events, "event_id long, event_type string, user_id long, value double"))
    _same_as_sql(spark, sf, "json_field_statistics", "events")
    plan = _plan(catalog.QUERIES["json_field_statistics"](spark, sf))
    assert re.search(r"hashpartitioning\(file#[^,]*, field#", plan)  # levels met in one partition of lists before


def test_f16_workbooks_are_planned_for_what_they_hold(spark, monkeypatch):
    from tessaro.plans import file_queries
    from tessaro.sources import ooxml, sheets

    cell = lambda r, c, t, kind="s": ("p.xlsx", "S", 1, "cell", r, c, None, t, float(t) if kind == "n" else None, f"{kind}\t\t\tGeneral", None)
    mark = lambda kind, a, b, flags=None: ("p.xlsx", "S", 1, kind, a, b, None, None, None, flags, None)
    cells = [cell(1, 1, "name"), cell(1, 2, "size"), *[cell(r, c, str(r * c), "n") for r in (2, 3, 4) for c in (1, 2)]]
    more = [mark("merge", 2, 1, "3\t1"), mark("hidden_row", 4, None), mark("hidden_col", None, 2)]
    rows = lambda facts, kinds=None: sorted(map(tuple, sheets.row_documents(spark.createDataFrame(facts, ooxml.FACTS), kinds).collect()))
    assert rows(cells) == rows(cells, {"cell"}) and len(rows(cells)) == 3
    marked = rows(cells + more, {"cell", "merge", "hidden_row", "hidden_col"})
    assert marked == rows(cells + more) and "[merged 2x1]" in marked[0][3] and "[HIDDEN COL]" in marked[0][3] and marked[-1][4]
    monkeypatch.setattr(sheets, "merged", lambda facts: 1 / 0)  # there are no merged cells in these workbooks
    out = file_queries.ingest_workbook(spark, "/root/testdata/sf0.001")
    assert out.where("block = 0").count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_csv_summaries_are_of_all_records(spark, tmp_path):
    rows = [(i % 20, f"n{i}", i % 7, "BUILDING" if i % 5 == 4 else "X") for i in range(15_000)] + [(20, "last", 3, "X")]
    sf = _tables(spark, tmp_path, customer=(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"))
    got = dict(_same_as_sql(spark, sf, "ingest_csv_summary", "customer"))
    assert got["n0.csv"].startswith("[CSV Summary: 12000 rows x 3 columns]") and "max=18, avg=9.00, count=12000" in got["n0.csv"]


def test_a_text_that_is_no_csv_near_its_end_has_no_summary():
    made = lambda text: list(text_files._csv_cells("p", ".csv", text))
    lines = ["a,b", *[f"{i},{i}" for i in range(10_500)]]
    assert [r[1:] for r in made("\n".join(lines))[-2:]] == [(10_499, 0, "a", "10499"), (10_499, 1, "b", "10499")]
    assert made("\n".join([*lines, "x\ry,1"])) == []
