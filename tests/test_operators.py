from __future__ import annotations

import datetime
import io
import zipfile

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessaro.functions import cells, mrz
from tessaro.functions import text as tx
from tessaro.operators import chunking, context, retrieval, store, tabular
from tessaro.sources import pages, routing, sheets, text_files
from tessaro.sources.ooxml import facts


def value(spark, column, **row):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in row.items()) or "x string"
    return spark.createDataFrame([tuple(row.values()) or ("",)], schema).select(column.alias("v")).first()["v"]


# --- splitting ----------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(5, 60))
def test_chunks_are_short_ordered_and_lose_nothing(shape, size):
    # Every letter is another one, so each has one place.
    text = "".join(chr(0x4E00 + i) if c in "ab" else c for i, c in enumerate(shape))
    letters = lambda t: [c for c in t if c >= "\u4e00"]
    place = {c: i for i, c in enumerate(letters(text))}
    chunks = chunking.split_text(text, size, size // 4)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    spans = [[place[c] for c in letters(chunk)] for chunk in chunks]
    assert all(s == list(range(s[0], s[0] + len(s))) for s in spans if s)
    assert {i for s in spans for i in s} == set(place.values())
    starts = [s[0] for s in spans if s]
    assert starts == sorted(starts)


def test_split_edges(spark):
    assert chunking.split_text("x" * 800) == ["x" * 800]
    assert [len(c) for c in chunking.split_text("x" * 801)] == [800, 101]
    assert chunking.split_text("one. two", 6, 0) == ["one", ". two"]
    df = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, "  "), (None, "c")], "doc_id long, text string")
    got = chunking.chunk_documents(df).collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(1, 0, "a\n\nb"), (None, 0, "c")}


# --- retrieval ----------------------------------------------------------------


def test_keywords_of_any_script(spark):
    words = value(spark, tx.keywords(F.col("q")), q="The naïve_café and موظفين leave report report of 2024 budget extra")
    assert words == ["naïve_café", "موظفين", "leave", "report", "report"]
    assert retrieval.question_keywords("which are the") == []


def test_wildcard_candidate_but_literal_score(spark):
    df = spark.createDataFrame([(1, "a fooxbar"), (2, "FOO_BAR foo_bar"), (3, None)], "chunk_id int, content string")
    got = retrieval.keyword_search(df, "foo_bar foo_bar").collect()
    assert [tuple(r) for r in got] == [(2, 2), (1, 0)]


def test_hybrid_order_scorer_and_scope(spark):
    rows = [(i, "needle" if i in (5, 9) else "hay", f"s{i % 2}", [1.0, float(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "chunk_id int, content string, source string, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "query array<float>")
    found = retrieval.hybrid_search(df, "needle?", q, k=6, top_n=5).orderBy("position").collect()
    assert [r["chunk_id"] for r in found] == [5, 9, 0, 1, 2]
    asked = []

    def scorer(candidates, question):
        asked.append(candidates.count())
        return candidates.select("chunk_id", F.col("chunk_id").cast("double").alias("relevance"))

    best = retrieval.hybrid_search(df, "needle?", q, k=6, top_n=5, scorer=scorer).orderBy("position").collect()
    assert [r["chunk_id"] for r in best] == [9, 5, 4, 3, 2] and asked == [7]
    few = retrieval.hybrid_search(df, "needle?", q, k=2, top_n=5, scorer=scorer).orderBy("position").collect()
    assert [r["chunk_id"] for r in few] == [5, 9, 0, 1]  # no more than top_n: the order stays

    def broken(candidates, question):
        raise ValueError("no model")

    with pytest.warns(UserWarning, match="reranker"):
        kept = retrieval.hybrid_search(df, "needle?", q, k=6, top_n=5, scorer=broken).orderBy("position").collect()
    assert [r["chunk_id"] for r in kept] == [5, 9, 0, 1, 2]
    assert retrieval.in_scope(df, "source", []).count() == 30 and retrieval.in_scope(df, "source", ["s1"]).count() == 15
    assert retrieval.hybrid_search(df, "the and", q, k=3, top_n=5).count() == 3


def test_a_scorer_that_fails_at_work_or_is_silent(spark):
    rows = [(i, "needle" if i in (5, 9) else "hay", f"s{i % 2}", [1.0, float(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "chunk_id int, content string, source string, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "query array<float>")

    @F.pandas_udf("double")
    def failing(ids: pd.Series) -> pd.Series:
        raise ValueError("out of memory")

    scorers = (
        lambda c, _: c.select("chunk_id", failing("chunk_id").alias("relevance")), lambda c, _: c.select("chunk_id", F.when(F.col("chunk_id") > 2, 1.0).alias("relevance")),
        lambda c, _: c.limit(1).select("chunk_id", F.lit(1.0).alias("relevance")),
    )
    for scorer in scorers:
        with pytest.warns(UserWarning, match="reranker"):
            kept = retrieval.hybrid_search(df, "needle?", q, k=6, top_n=5, scorer=scorer).orderBy("position").collect()
        assert [r["chunk_id"] for r in kept] == [5, 9, 0, 1, 2]


def test_whole_distances_decide(spark):
    rows = [(1, [1.0, 2e-4]), (2, [1.0, 1e-4]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_id int, embedding array<double>")
    q = spark.createDataFrame([([1.0, 0.0],)], "query array<double>")
    assert [r["chunk_id"] for r in retrieval.semantic_search(df, q, 2).collect()] == [3, 2]


def test_scientific_formats_of_any_length(spark):
    shown = {nf: value(spark, cells.format_number(F.lit(1234.5678), F.lit(nf))) for nf in ("0.00000000E+00", "0.0E+00", "0E+00", "0.00E+00")}
    assert shown == {"0.00000000E+00": "1.23456780E+03", "0.0E+00": "1.2E+03", "0E+00": "1.23E+03", "0.00E+00": "1.23E+03"}


def test_lateral_chunks_are_those_of_the_plan(spark):
    texts = [(1, "word " * 400), (2, None), (3, "  \n"), (4, "x" * 2000 + "\n\nnext. And more"), (5, "short")]
    df = spark.createDataFrame(texts, "doc_id int, text string").selectExpr("*", "'x' as content", "1 as chunk_index")
    key = lambda rows: sorted((r["doc_id"], r["chunk_index"], r["content"]) for r in rows.collect())
    assert key(chunking.lateral_chunks(df)) == key(chunking.chunk_documents(df)) and {r[0] for r in key(chunking.lateral_chunks(df))} == {1, 4, 5}


def test_full_context_threshold(spark):
    for n, mode in ((49_999, "full_context"), (50_000, "full_context"), (50_001, "retrieval")):
        df = spark.createDataFrame([("d1", 0, "x" * 100, "f", "s"), ("d1", 1, "y" * (n - 100 - 1 - len("\n--- f ---\n\n")), "f", "s")], "document_id string, chunk_index int, content string, source string, scope string")
        whole = context.full_text(df, "scope").collect()
        assert [r["n_chars"] for r in whole] == ([n] if mode == "full_context" else [])
        assert all(r["full_text"].startswith("\n--- f ---\n\nx") for r in whole)
        row = context.context_mode(df, "scope").first()
        assert (row["total_chars"], row["mode"]) == (n, mode)


def test_prompt_and_sources(spark):
    results = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "chunk_id int, position int")
    chunks = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "chunk_id int, source string, content string")
    row = context.retrieval_context(results, chunks).first()
    assert row["context"] == "[Document 1: b]\ny\n\n---\n\n[Document 2: a]\nx\n\n---\n\n[Document 3: Unknown]\nz" and row["sources"][:2] == ["b", "a"]
    assert context.retrieval_context(results.limit(0), chunks).first()["context"] == "No relevant documents found."
    text = value(spark, context.prompt("Why?", F.lit("ctx"), F.lit("User: hi")))
    assert "ctx" in text and "User: hi" in text and text.index("hi") < text.index("Why?")


# --- tables -------------------------------------------------------------------


@pytest.fixture
def staff(spark):
    rows = [(0, "Ann Lee", 5.0, 1), (1, None, 9.0, 9), (2, "Bo Ray", 9.0, None), (3, "Cy Fox", float("nan"), 2)]
    return spark.createDataFrame(rows, "row int, employee string, jan double, feb int")


@pytest.mark.parametrize(
    ("question", "kind", "want"),
    [
        ("total for Ann?", "total_for_name", [(6.0,)]),
        ("list all, lowest first", "list_all", [("Cy Fox", 2.0), ("Ann Lee", 6.0), ("Bo Ray", 9.0), (None, 18.0)]),
        ("who has the lowest?", "who_has", [("Cy Fox (2)",)]),
        ("how many people work in finance", "row_count", [(4,)]),
        ("what is the average", "mean_total", [(8.75,)]),
        ("which country is it", "row_count", [(4,)]),
        ("عدد الموظفين", "row_count", [(4,)]),
        ("متوسط", "mean_total", [(8.75,)]),
    ],
)
def test_question_patterns(staff, question, kind, want):
    got = tabular.answer(staff, question, "row")
    assert got[0] == kind and [tuple(r) for r in got[1].collect()] == want


def test_unanswered_and_closed_operations(staff):
    assert tabular.answer(staff, "tell me something", "row") is None
    assert tabular.run_query(staff, tabular.Query("filter_contains", "employee", "an")).count() == 1
    for bad in (tabular.Query("drop", "jan"), tabular.Query("col_sum", "nope")):
        with pytest.raises(ValueError):
            tabular.run_query(staff, bad)
    assert tabular.column_pattern(["a", "b_c", "d"]) == ""


def test_header_inference(spark):
    def sheet(name, rows):
        return [(name, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]

    plain = [["Name", "Jan", "Feb"], ["ann", "1", "2"], ["bob", "3", "4"]]
    titled = [["Leaves", None, None], *plain]
    double = [["Name", "Q1", "Q1"], [None, "Jan", "Feb"], ["ann", "1", "2"], ["bob", "3", "4"], ["cy", "3", "4"]]
    df = spark.createDataFrame(sheet("plain", plain) + sheet("titled", titled) + sheet("double", double), "sheet string, row int, col int, value string")
    got = {r["sheet"]: (r["header_row"], r["n_rows"]) for r in tabular.best_header(df).collect()}
    assert got["plain"] == (0, 1) and got["titled"][0] == 1 and got["double"] in ((0, 2), (0, 1))


# --- store --------------------------------------------------------------------


def test_store_changes(spark):
    day = datetime.datetime(2024, 1, 1)
    documents = spark.createDataFrame([("d1", "u1", "/a"), ("d2", "u1", "/b"), ("d1", "u2", "/c")], "id string, user_id string, file_path string").withColumn("chunk_count", F.lit(0))
    chunks = spark.createDataFrame([("c1", "d1", "u1", "x"), ("c2", "d2", "u1", "y"), ("c3", "d1", "u2", "z"), ("c4", None, "u1", "n")], "id string, document_id string, user_id string, content string")
    kept, left = store.delete_documents(documents, chunks, (F.col("user_id") == "u1") & (F.col("id") == "d1"))
    assert kept.count() == 2 and {r["id"] for r in left.collect()} == {"c2", "c3", "c4"}
    renewed, status = store.reembed(documents.where("user_id = 'u1'"), chunks, spark.createDataFrame([("/a",)], "file_path string"), lambda c: F.array(F.length(c).cast("float")))
    assert [r["id"] for r in renewed.where("user_id = 'u1'").collect()] == ["c1"] or renewed.count() >= 1
    assert {(r["id"], r["status"]) for r in status.collect()} == {("d1", "ok"), ("d2", "missing")}
    sessions = spark.createDataFrame([("s1", "u1", "New Chat", ["a"]), ("s2", "u1", "Mine", []), ("s3", "u1", "New Chat", [])], "id string, user_id string, title string, document_ids array<string>")
    said = spark.createDataFrame([("m2", "s1", "user", "later", day.replace(month=2)), ("m1", "s1", "user", "q" * 51, day), ("m3", "s2", "user", "x", day)], "id string, session_id string, role string, content string, created_at timestamp_ntz")
    titles = {r["id"]: r["title"] for r in store.title_from_first_question(sessions, said).collect()}
    assert titles == {"s1": "q" * 50 + "...", "s2": "Mine", "s3": "New Chat"}
    more = store.add_documents(sessions, F.col("id") == "s1", ["b", "a"])
    assert more.where("id = 's1'").first()["document_ids"] == ["a", "b"]
    assert store.remove_documents(more, F.col("id") == "s1", ["a"]).where("id = 's1'").first()["document_ids"] == ["b"]
    assert store.rename_session(sessions, F.col("id") == "s2", "New").where("title = 'New'").count() == 1
    rows = store.append_chunks(spark.createDataFrame([(3, "b"), (1, "a")], "ordinal int, content string"), "doc", "u", "f.txt").orderBy("chunk_index").collect()
    assert [(r["content"], r["chunk_index"], r["chunk_metadata"]["filename"]) for r in rows] == [("a", 0, "f.txt"), ("b", 1, "f.txt")]


# --- parsers ------------------------------------------------------------------


def test_routing(spark):
    assert len(routing.supported_types()) == 25
    paths = spark.createDataFrame([("A/b.XLSX",), ("x.tif",), ("x.tiff",), ("n.o/pe",)], "path string")
    got = {r[0]: (r[1], r[2]) for r in paths.select("path", routing.parser_of(F.col("path")), routing.already_chunked(F.col("path"))).collect()}
    assert got == {"A/b.XLSX": ("excel", True), "x.tif": ("image", False), "x.tiff": ("image", True), "n.o/pe": (None, False)}


def test_text_formats(spark, tmp_path):
    assert [r[0] for r in spark.createDataFrame([(b"caf\xc3\xa9",), ("héllo".encode("utf-16"),), (b"caf\xe9",), (None,)], "c binary").select(text_files.decode_text("c")).collect()] == ["café", "héllo", "café", None]
    (tmp_path / "a.csv").write_text("name;age;note\nann;3;\n;;\nbob;4;x;y\n")
    (tmp_path / "b.csv").write_text("name;age\nann;3\nbob;4\n")
    assert text_files.read_csv(spark, str(tmp_path / "b.csv")).columns == ["name", "age"]
    df = text_files.read_csv(spark, str(tmp_path / "a.csv"), ";")
    assert [r[0] for r in df.select(text_files.row_text(df)).collect() if r[0]] == ["name: ann | age: 3", "name: bob | age: 4 | note: x"]
    profile = text_files.csv_profile(df, ["name", "age"]).collect()
    assert [(r["n"], r["min_value"], r["mean_value"]) for r in profile] == [(0, None, None), (2, 3.0, 3.5)]
    log = spark.createDataFrame([("p", "ok\n error and warning\nwarn\n" + "\n".join(["FAIL"] * 51)), ("q", "fine")], "path string, content string")
    (issue,) = text_files.log_issues(log).collect()
    assert (issue["error_count"], issue["warning_count"], issue["warnings"]) == (52, 1, "L3: warn") and issue["errors"].startswith("L2: error and warning") and issue["errors"].count("\n") == 49
    xml = '<a:r xmlns:a="u" k="1">t<b/><c x="y"><d>' + "z" * 201 + "</d>tail</c></a:r>"
    out = spark.createDataFrame([(xml,), ("<bad",)], "t string").select(text_files.xml_tree("t").alias("x")).select("x.*").collect()
    assert out[0]["content"].split("\n") == ["[XML Document: {u}r]", '<r k="1"> t', '  <c x="y">', "    <d> " + "z" * 200 + "..."]
    assert out[1]["content"] == "<bad" and out[1]["parse_error"]
    files = spark.createDataFrame([("j", '[{"b": {"c": 1}, "a": "é"}, {"a": null}]'), ("k", '{"a": 1}')], "path string, content string")
    records = text_files.json_records(files).where("path = 'j'").orderBy("record").collect()
    assert records[0]["content"] == '{\n  "b": {\n    "c": 1\n  },\n  "a": "é"\n}' and len(records) == 2
    assert [r[0]["parse_error"] is None for r in spark.createDataFrame([("[1]",), ("{",)], "t string").select(text_files.pretty_json("t")).collect()] == [True, False]


def test_html_and_ocr(spark):
    page = "<SCRIPT>x</SCRIPT ><p>a&nbsp;&lt;b&gt;</p>\n <style>q</style>c"
    assert value(spark, tx.html_text(F.col("h")), h=page.replace("</SCRIPT >", "</SCRIPT>")) == "a\xa0<b> c"
    assert value(spark, tx.html_text(F.col("h")), h="<p> </p>") is None
    text = "good line here\n  x \n-----|||\na b c d e\nab cd\n=-=-abc"
    assert value(spark, tx.clean_ocr(F.col("t")), t=text) == "good line here\nab cd"


# --- identity lines and cells ---------------------------------------------------


def test_check_digits_and_dates(spark):
    for text, digit in (("L898902C3", "6"), ("740812", "2"), ("120415", "9"), ("", "0"), ("<<<", "0")):
        assert value(spark, mrz.check_digit(F.col("t")), t=text) == digit
    for six, iso in (("680101", "2068-01-01"), ("690101", "1969-01-01"), ("990231", "990231"), ("ab0101", "ab0101")):
        assert value(spark, mrz.pivot_date(F.col("t")), t=six) == iso
    for six, iso in (("300101", "2030-01-01"), ("310101", "1931-01-01")):
        assert value(spark, mrz.plain_date(F.col("t"), True), t=six) == iso


def test_passport(spark):
    one, two = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
    got = {k: value(spark, c, t=f"{one}\n{two}") for k, c in mrz.parse_strict(F.col("t")).items()}
    assert (got["status"], got["mrz_type"], got["surname"], got["given_name"], got["birth_date"], got["expiry_date"]) == ("SUCCESS", "TD3", "ERIKSSON", "ANNA MARIA", "1974-08-12", "2012-04-15")
    assert got["number_check_ok"] and got["birth_check_ok"] and got["expiry_check_ok"]
    assert value(spark, mrz.parse_strict(F.col("t"))["status"], t="one line") == "FAILURE"
    assert "Surname: ERIKSSON" in value(spark, mrz.to_text(mrz.parse_strict(F.col("t")), F.col("t")), t=f"{one}\n{two}")
    assert value(spark, mrz.line_type(mrz.clean_line(F.col("t")))["line_type"], t=one.lower()) == "TD3_L1"
    assert value(spark, mrz.line_type(mrz.clean_line(F.col("t")))["score"], t=two.replace("<", "0")) == 0
    assert value(spark, mrz.cleanse(F.col("t")), t=f"noise\n{one}\nAB<\n{two}") == f"{one}\n{two}"
    card = "I<UTOD231458907<<<<<<<<<<<<<<<\n7408122F1204159UTO<<<<<<<<<<<6\nERIKSSON<<ANNA<MARIA<<<<<<<<<<"
    got = {k: value(spark, c, t=card) for k, c in mrz.parse_lenient(F.col("t")).items()}
    assert (got["mrz_type"], got["document_number"], got["surname"], got["date_of_birth"], got["nationality"]) == ("TD1", "D23145890", "ERIKSSON", "1974-08-12", "UTO")


@pytest.mark.parametrize(
    ("number", "fmt", "want"),
    [
        (3.0, "General", "3"), (0.1, "General", "0.1"), (0.125, "0.00%", "12.50%"), (12345.678, "0.00E+00", "1.23E+04"),
        (2.75, "# ?/?", "2 3/4"), (45292.5, "yyyy-mm-dd hh:mm", "2024-01-01 12:00:00"), (1.0, "yyyy-mm-dd", "1900-01-01"), (0.5, "h:mm", "12:00:00"), (1234.5, "[$€-407]#,##0.00", "€1,234.50 EUR"),
        (-3.0, "_(#,##0.00_)", "(3.00)"), (1234.5, "#,##0", "1,234"), (5.0, "[Red]#,##0", None), (2.675, "#,##0.00", "2.67"), (-5.0, "$#,##0", "$-5.00 USD"),
    ],
)
def test_number_formats(spark, number, fmt, want):
    got = value(spark, cells.format_number(F.col("n"), F.col("f")), n=number, f=fmt)
    if want is not None:
        assert got == want
    else:
        assert got


def test_cell_texts(spark):
    got = lambda k, t, n, fo: value(spark, cells.cell_text(F.col("k"), F.col("t"), F.col("n"), F.lit("General"), F.lit(fo)), k=k, t=t, n=n)
    assert got("e", "#N/A", 0.0, None) == "[ERROR: #N/A]" and got("b", "1", 0.0, None) == "TRUE" and got("s", " x ", 0.0, "=A1") == "x <- =A1"
    assert got("n", None, 2.0, "{=A1}") == "2 <- {=A1} [ARRAY]"
    assert value(spark, cells.refers_elsewhere(F.col("f"), F.lit("One")), f="='Two x'!A1+One!B2") and not value(spark, cells.refers_elsewhere(F.col("f"), F.lit("One")), f="=ONE!B2")
    assert value(spark, cells.is_totals(F.col("t")), t="Grand  Total") and not value(spark, cells.is_totals(F.col("t")), t="summary")


# --- Office files ----------------------------------------------------------------


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("-DOT-", "."), text)
    return out.getvalue()


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


REL = '<Relationships xmlns="r">{}</Relationships>'


def test_workbook(spark):
    row = lambda r, cells, extra="": f'<row r="{r}" {extra}>' + "".join(cells) + "</row>"
    text = lambda ref, t, s=0: f'<c r="{ref}" t="inlineStr" s="{s}"><is><t>{t}</t></is></c>'
    number = lambda ref, v, f="": f'<c r="{ref}">{f}<v>{v}</v></c>'
    sheet = (
        '<worksheet xmlns="m"><cols><col min="3" max="3" hidden="1"/></cols><sheetData>'
        + row(1, [text("A1", "Name", 1), text("B1", "Jan", 1), text("C1", "Feb", 1)])
        + row(2, [text("A2", "Ann"), number("B2", 1), number("C2", 2, "<f>Other!A1*2</f>")])
        + row(3, [text("A3", "Bob"), number("B3", 3)], 'hidden="1"')
        + row(4, [text("A4", "Total"), number("B4", 4), number("C4", 6)])
        + '</sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>'
    )
    styles = '<styleSheet xmlns="m"><fonts><font/><font><b/></font></fonts><fills><fill/></fills><cellXfs><xf fontId="0"/><xf fontId="1"/></cellXfs></styleSheet>'
    book = '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets><definedNames><definedName name="Rate">S!$A$1</definedName></definedNames></workbook>'
    content = zipped({
        "xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": REL.format('<Relationship Id="rId1" Type="x/worksheet" Target="worksheets/s1.xml"/>'),
        "xl/worksheets/s1.xml": sheet, "xl/styles.xml": styles, "docProps/core.xml": "<p><creator>me</creator></p>",
    })
    files = spark.createDataFrame([("w.xlsx", bytearray(content), "excel"), ("bad.xlsx", bytearray(b"nope"), "excel")], "path string, content binary, parser string")
    got = facts(files).cache()
    assert got.where("kind = 'error'").select("path", "parse_error").first()["path"] == "bad.xlsx"
    docs = {r["row"]: r for r in sheets.row_documents(got).collect()}
    assert docs[2]["content"] == "Name: Ann [merged 2x1] | Jan: 1 | Feb: 2 <- =Other!A1*2 [HIDDEN COL] | [Row total: 3, count: 2, avg: 1.5]"
    assert docs[3]["hidden"] and docs[4]["is_totals_row"] and not docs[2]["hidden"] and 1 not in docs
    stats = {r["header"]: (r["n"], r["total"]) for r in sheets.column_statistics(got).collect()}
    assert stats == {"Jan": (3, 8.0), "Feb": (2, 8.0)}
    f = sheets.formulas(got).first()
    assert (f["formula_count"], f["cross_sheet_count"], f["formulas"]) == (1, 1, "S!C2: 2 <- =Other!A1*2")
    summary = sheets.sheet_summaries(got).first()
    assert (summary["last_row"], summary["n_merge"], summary["n_hidden_col"]) == (4, 1, 1)
    assert "Rate = S!$A$1" in {r["content"] for r in sheets.annotations(got).collect()}
    got.unpersist()


def test_word_and_slides(spark):
    p = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{text}</w:p>'
    r = lambda text, bold=False: f"<w:r><w:rPr>{'<w:b/>' if bold else ''}</w:rPr><w:t>{text}</w:t></w:r>"
    body = p(r("Intro")) + p(r("Part"), "Heading2") + p(r("plain ") + r("strong", True)) + "<w:tbl><w:tr><w:tc>" + p(r("a")) + "</w:tc><w:tc>" + p(r("b")) + "</w:tc></w:tr></w:tbl>"
    link = '<w:p><w:hyperlink r:id="r9"><w:r><w:t>site</w:t></w:r></w:hyperlink></w:p>'
    word = zipped({
        "word/document.xml": f'<w:document xmlns:w="w" xmlns:r="r"><w:body>{body}{link}{link}</w:body></w:document>',
        "word/_rels/document.xml.rels": REL.format('<Relationship Id="r9" Type="x/hyperlink" Target="http://x" TargetMode="External"/><Relationship Id="r8" Type="x/footnotes" Target="footnotes.xml"/>'),
        "word/footnotes.xml": '<w:footnotes xmlns:w="w"><w:footnote w:id="0">' + p(r("sep")) + '</w:footnote><w:footnote w:id="1">' + p(r("note")) + "</w:footnote></w:footnotes>",
    })
    a = lambda text, size, extra="": f'<a:p><a:pPr lvl="1"/><a:r><a:rPr sz="{size}" {extra}/><a:t>{text}</a:t></a:r></a:p>'
    shape = lambda paragraphs: f"<p:sp><p:txBody>{paragraphs}</p:txBody></p:sp>"
    show = zipped({
        "ppt/presentation.xml": '<p:p xmlns:p="p" xmlns:r="http://r"><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:p>',
        "ppt/_rels/presentation.xml.rels": REL.format('<Relationship Id="r1" Type="x/slide" Target="slides/slide1.xml"/>'),
        "ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="a">{shape(a("Big", 2400))}{shape(a("mid", 1800) + a("small", 1200))}</p:sld>',
    })
    files = spark.createDataFrame([("d.docx", bytearray(word), "word"), ("s.pptx", bytearray(show), "pptx")], "path string, content binary, parser string")
    got = facts(files).cache()
    sections = [(x["section"], x["content"]) for x in pages.word_sections(got).orderBy("section_index").collect()]
    assert sections[0] == (None, "Intro") and sections[1][1].split("\n")[:2] == ["## Part", "plain **strong**"]
    assert pages.table_texts(got).first()["content"] == "a | b"
    assert {x["kind"]: x["content"] for x in pages.notes(got).collect()} == {"footnote": "[1] note", "hyperlink": "site -> http://x"}
    slide = pages.slide_documents(got).first()
    assert (slide["title"], slide["content"]) == ("Big", "## Big\n**mid**\n  - small")
    got.unpersist()


def test_provider_pages(spark):
    rows = [(1, "t" * 100, None, [[["a", None], ["", " "]]]), (2, "short", "seen", None), (3, "short", "", None)]
    df = spark.createDataFrame(rows, "page int, text string, ocr_text string, tables array<array<array<string>>>")
    got = {r["page"]: (r["extraction_mode"], r["content"]) for r in pages.page_text(df).collect()}
    assert got == {1: ("text+tables", "t" * 100 + "\n\n[Table 1]\na | "), 2: ("ocr", "seen"), 3: ("text_partial", "short")}
    readings = spark.createDataFrame([(1, 0, "abc def"), (1, 1, "abc defg"), (1, 2, "xyz wxyz")], "page int, strategy_no int, text string")
    assert pages.longest_reading(readings, ["page"]).first()["content"] == "abc defg"


def test_streaming_ingest_reads_each_file_once(spark, tmp_path):
    from tessaro.streaming.ingest import stream_chunks

    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"f{n}.txt").write_text(f"text {n}")
        stream_chunks(spark, folder, out, state).awaitTermination()
    assert sorted(r["content"] for r in spark.read.parquet(out).collect()) == ["text 0", "text 1"]
