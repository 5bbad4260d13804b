"""Headers, closed queries, number formats, stores and files: cases that went wrong before."""

from __future__ import annotations

import duckdb  # noqa: F401
from pyspark.sql import functions as F

from tessaro.functions import cells
from tessaro.operators import context, ingest, store, tabular


def sheet(name, rows):
    return [(name, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]


def test_a_row_without_data_below_is_no_header(spark):
    rows = sheet("s", [["Name", "Total"], ["Ann", "5"], ["Sum", "x", "note"]])
    best = tabular.best_header(spark.createDataFrame(rows, "sheet string, row int, col int, value string")).first()
    assert (best["header_row"], best["n_rows"]) == (0, 1)


def test_underscores_make_names_numeric_in_pairs_only(spark):
    rows = sheet("s", [["1_2", "3_4"], ["a", "b"], ["c", "d"], ["e", "f"]])
    scores = {(r["header_row"], r["n_rows"]): r["score"] for r in tabular.header_scores(spark.createDataFrame(rows, "sheet string, row int, col int, value string")).collect()}
    assert scores[0, 1] == 10 * 2 + 3  # not numeric alone
    only = sheet("t", [["n"]])
    assert tabular.best_header(spark.createDataFrame(only, "sheet string, row int, col int, value string")).first()["header_row"] == 0


def test_extremes_take_the_first_of_equal_rows(spark):
    df = spark.createDataFrame([("x1", "b", 5), ("x0", "a", 5), ("x2", "c", 1), ("x3", "d", None)], "at string, label string, v int")
    assert tabular.run_query(df, tabular.Query("argmax", col="v", label="label", order="at")).first()[0] == "a"
    assert tabular.run_query(df, tabular.Query("argmax", col="v", label="label")).first()[0] == "a"
    assert tabular.extreme(df, "label", "at").first()["answer"] == "a (5)"
    assert tabular.extreme(df, "label", "at", most=False).first()["answer"] == "d (0)"


def test_general_numbers(spark):
    values = [1234567.5, 0.00001234, 123456.5, 999999.5, 0.0001234, -1234567.25, 1e-7, 12.5, 3.0, 1e15]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(cells.general(F.col("v"))).collect()]
    assert got == [str(int(v)) if v == int(v) else f"{v:g}" for v in values]


def test_reembed_keeps_users_apart(spark):
    documents = spark.createDataFrame([("d", "u1", "f"), ("e", "u1", "gone")], "id string, user_id string, file_path string")
    chunks = spark.createDataFrame([("1", "d", "u1", "x", 9), ("2", "d", "u2", "y", 9)], "id string, document_id string, user_id string, content string, embedding int")
    files = spark.createDataFrame([("f",)], "file_path string")
    out, counts = store.reembed(documents.withColumn("chunk_count", F.lit(0)), chunks, files, lambda c: F.length(c))[::-1]
    assert {(r["id"], r["chunk_count"], r["status"]) for r in out.collect()} == {("d", 1, "ok"), ("e", 0, "missing")}
    assert [(r["id"], r["embedding"]) for r in counts.collect()] == [("1", 1)]


def test_reingest_counts_statuses(spark):
    files = spark.createDataFrame([("a.csv", bytearray(b"n\n1\n2\n")), ("b.txt", bytearray(b"  "))], "path string, content binary")
    documents = spark.createDataFrame([("1", "u", "a.csv", 7), ("2", "u", "b.txt", 7), ("3", "u", "c.txt", 7), ("4", "v", "a.csv", 7)], "id string, user_id string, file_path string, chunk_count int")
    out, chunks, counts = store.reingest(documents, files, lambda c: F.array(F.length(c).cast("float")), parsers=("text",))
    assert {(r["id"], r["status"], r["chunk_count"]) for r in out.collect()} == {("1", "ok", 3), ("2", "empty", 0), ("3", "missing", 0), ("4", "ok", 3)}
    rows = chunks.where("content like 'n:%'")  # besides, each file has its statistics
    assert {(r["id"], r["user_id"], r["content"], r["embedding"][0]) for r in rows.collect()} == {(f"{d}-{i}", u, f"n: {i + 1}", 4.0) for d, u in (("1", "u"), ("4", "v")) for i in (0, 1)}
    assert {r["status"]: r["n_documents"] for r in counts.collect()} == {"ok": 2, "empty": 1, "missing": 1}


def test_very_long_csv_fields_and_bad_files_beside_good_ones(spark):
    long = "x" * 200_000
    files = [("long.csv", f"a,b\n{long},2\n"), ("head.csv", "a,b\n"), ("good.csv", "a\n1\n"), ("nul.csv", "a,b\n1,\0\n"), ("l.log", "fine\nERROR one\nwarn two"), ("j.json", '[{"k": 1}, 2]')]
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files], "path string, content binary")
    got = {(r["path"], r["ordinal"]): r["content"] for r in ingest.parse_files(df, ("text",)).collect()}
    assert got["long.csv", 2] == f"a: {long} | b: 2" and got["head.csv", 1] == "a,b\n" and got["good.csv", 2] == "a: 1"
    assert got["l.log", ingest.BESIDE] == "Log issues: 1 errors, 1 warnings\n\nErrors:\nL2: ERROR one\n\nWarnings:\nL3: warn two"
    assert got["j.json", ingest.BESIDE] == "JSON list: 2 records, 2 listed\nFields: k\n  k: min=1, max=1, avg=1.00"
    assert got["good.csv", ingest.BESIDE] == "[CSV Summary: 1 rows x 1 columns]\nColumns: a\n  a: min=1, max=1, avg=1.00, count=1"


def test_only_the_first_cell_of_a_merged_range_speaks(spark):
    from tests.test_operators import REL, zipped
    from tessaro.sources import ooxml, sheets

    text = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    rows = [["A1:Name", "B1:City", "C1:Note"], ["A2:Ann", "B2:hidden", "C2:x"], ["A3:gone", "B3:gone", "C3:y"]]
    data = "".join(f'<row r="{i}">' + "".join(text(*c.split(":")) for c in r) + "</row>" for i, r in enumerate(rows, 1))
    content = zipped({
        "xl/workbook.xml": '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": REL.format('<Relationship Id="rId1" Type="x/worksheet" Target="worksheets/s1.xml"/>'),
        "xl/worksheets/s1.xml": f'<worksheet xmlns="m"><sheetData>{data}</sheetData><mergeCells><mergeCell ref="A2:B3"/></mergeCells></worksheet>',
    })
    files = spark.createDataFrame([("w.xlsx", bytearray(content), "excel")], "path string, content binary, parser string")
    got = {r["row"]: r["content"] for r in sheets.row_documents(ooxml.facts(files)).collect()}
    assert got == {2: "Name: Ann [merged 2x2] | Note: x", 3: "Note: y"}
    old = spark.createDataFrame([("o.xls", bytearray(b"\xd0\xcf"))], "path string, content binary")
    assert "not available" in ingest.parse_files(old, ("excel",)).first()["content"]


def test_images_rules_and_hidden_columns(spark):
    import io
    import zipfile

    from tessaro.sources import ooxml, sheets

    rel = lambda *r: '<Relationships xmlns="r">' + "".join(f'<Relationship Id="r{i}" Type="x/{kind}" Target="{to}"/>' for i, (kind, to) in enumerate(r)) + "</Relationships>"
    rules = (
        '<cfRule type="colorScale"><colorScale><cfvo type="min"/><cfvo type="num" val="5"/><color rgb="FF0000"/><color theme="4"/></colorScale></cfRule>'
        '<cfRule type="iconSet"><iconSet iconSet="3Arrows"><cfvo type="percent" val="33"/></iconSet></cfRule><cfRule type="cellIs" dxfId="2"><formula>5</formula></cfRule>'
    )
    parts = {
        "xl/workbook.xml": '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="One" r:id="r0"/><sheet name="Two" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rel(("worksheet", "worksheets/a.xml"), ("worksheet", "worksheets/b.xml")),
        "xl/worksheets/a.xml": f'<worksheet xmlns="m"><cols><col min="3" max="402" hidden="1"/></cols><sheetData/><conditionalFormatting sqref="A1:A9">{rules}</conditionalFormatting></worksheet>',
        "xl/worksheets/b.xml": '<worksheet xmlns="m"><sheetData/></worksheet>', "xl/worksheets/_rels/a.xml.rels": rel(("drawing", "../drawings/d.xml")),
        "xl/worksheets/_rels/b.xml.rels": rel(("drawing", "../drawings/d.xml")), "xl/drawings/d.xml": "<d/>", "xl/drawings/_rels/d.xml.rels": rel(("image", "../media/i.png")),
        "xl/media/i.png": "12345", "xl/media/lost.png": "1",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    found = ooxml.facts(spark.createDataFrame([("x.xlsx", "excel", bytearray(out.getvalue()))], "path string, parser string, content binary")).cache()
    assert sorted((r["image"], r["bytes"], r["sheet"]) for r in sheets.images(found).where("sheet is not null").collect()) == [("i.png", 5, "One"), ("i.png", 5, "Two")]
    assert [tuple(r)[1:] for r in sheets.images(found).where("sheet is null").collect()] == [("lost.png", 1, None)]
    assert found.where("kind = 'hidden_col'").count() == 400
    said = {r["content"] for r in sheets.annotations(found).where("kind = 'conditional_format'").collect()}
    assert said == {"colorScale colorScale min num=5 FF0000 theme 4 A1:A9", "iconSet iconSet 3Arrows percent=33 A1:A9", "cellIs format 2 A1:A9 5"}


def test_numbers_by_blocks(spark):
    rows = [(i % 3 or None, i // 7, (i * 37) % 101) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, b int, v int")
    got = {(r["k"], r["position"]): (r["b"], r["v"]) for r in context.numbered(df, ["k"], F.col("b"), [F.col("v")]).collect()}
    for k in (None, 1, 2):
        mine = sorted((b, v) for q, b, v in rows if q == k)
        assert [got[k, i + 1] for i in range(len(mine))] == mine


def test_long_scopes_are_not_joined(spark):
    rows = [("short", i, 0, "ab", f"s{i}") for i in range(3)] + [("long", 9, i, "x" * 60, "s") for i in range(3)]
    df = spark.createDataFrame(rows, "scope string, document_id long, chunk_index int, content string, source string")
    got = context.full_text(df, "scope", most=100).collect()
    assert [r["scope"] for r in got] == ["short"] and got[0]["n_chars"] == len(got[0]["full_text"]) == 3 * 15 + 2
    exact = context.full_text(df, "scope", most=got[0]["n_chars"]).collect()
    assert [r["scope"] for r in exact] == ["short"] and not context.full_text(df, "scope", most=got[0]["n_chars"] - 1).collect()


def test_tables_are_created(spark):
    store.create_tables(spark, "made_here")
    try:
        assert {r["tableName"] for r in spark.sql("show tables in made_here").collect()} == set(store.SCHEMAS)
        assert spark.table("made_here.users").first()["id"] == "default" and dict(spark.table("made_here.documents").dtypes)["chunk_count"] == "int"
    finally:
        spark.sql("drop database made_here cascade")
