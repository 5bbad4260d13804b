from pyspark.sql import functions as F

from tessaro.operators import answers, tabular
from tessaro.operators.ingest import ingest, parse_files, rejected

from .test_operators import REL, zipped


def cells(spark, rows):
    return spark.createDataFrame([("s", r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], "sheet string, row int, col int, value string")


def test_sheet_to_answers(spark):
    raw = [["Leaves 2025", None, None, None], ["Name", "Jan", "Jan", "Note"], ["Ann Lee", "1", "2", "x"], [None, None, " ", None], ["Bo Ray", "4", "5.5", "y"]]
    df = answers.sheet_table(cells(spark, raw), "s")
    assert df.columns == ["_row", "Name", "Jan", "Jan.1", "Note"]
    assert [tuple(r)[1:] for r in df.orderBy("_row").collect()] == [("Ann Lee", 1.0, 2.0, "x"), ("Bo Ray", 4.0, 5.5, "y")]
    plain = df.toDF("_row", "Name", "Jan", "Jan2", "Note")
    assert answers.ask(plain, "total for Ann", "_row") == {"answer": "3", "plan": "total_for_name", "success": True}
    assert answers.ask(plain, "who has the most", "_row")["answer"] == "Bo Ray (9)"
    assert not answers.ask(plain, "tell me", "_row")["success"]
    asked = []

    def planner(question, about):
        asked.append(question)
        return tabular.Query("col_sum", "Nope" if len(asked) == 1 else "Jan")

    assert answers.ask(plain, "tell me", "_row", planner)["answer"] == "5" and "no column Nope" in asked[1]
    text = answers.summary(plain, "s", "_row")
    assert "Rows: 2, Columns: 4" in text and "'Name' values: Ann Lee (1), Bo Ray (1)" in text
    assert answers.answer_text(plain.limit(0)) == "No results found."
    assert answers.answer_text(spark.range(1).select(F.lit(float("nan")).alias("x"))) == "nan"
    assert answers.answer_text(spark.range(25)).endswith("(25 rows in all)")


def test_wide_summary(spark):
    names = [f"M{m}_W{w}" for m in range(4) for w in range(4)]
    df = spark.createDataFrame([(0, "a", *range(16))], ["row", "who", *names])
    text = answers.summary(df, "wide", "row")
    assert "M0__M3 x W0__W3 (16 columns: M0_W0...M3_W3)" in text and "Row total a: 120" in text


def test_ingest(spark):
    files = [
        ("/in/a.csv", b"name,age\nann,3\n,\nbob,4\n"), ("/in/b.TXT", ("word " * 400).encode()), ("/in/c.json", b'[{"a": 1}, {"a": 2}]'), ("/in/d.html", b"<p>hi &amp; bye</p>"),
        ("/in/e.xml", b"<r>t</r>"), ("/in/f.xlsx", b"broken"), ("/in/g.zzz", b"?"), ("/in/h.md", b"  \n"),
    ]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    documents, chunks = ingest(df, "u", embed=lambda c: F.array(F.length(c).cast("float")))
    counts = {r["filename"]: r["chunk_count"] for r in documents.collect()}
    assert counts == {"a.csv": 3, "b.TXT": 3, "c.json": 3, "d.html": 1, "e.xml": 1, "f.xlsx": 0, "h.md": 0}
    by = {}
    for r in chunks.orderBy("document_id", "chunk_index").collect():
        by.setdefault(r["chunk_metadata"]["filename"], []).append((r["chunk_index"], r["content"], r["embedding"]))
    summary = "[CSV Summary: 3 rows x 2 columns]\nColumns: name, age\n  age: min=3, max=4, avg=3.50, count=2"
    assert [c for _, c, _ in by["a.csv"]] == ["name: ann | age: 3", "name: bob | age: 4", summary]
    assert [i for i, _, _ in by["b.TXT"]] == [0, 1, 2] and all(len(c) <= 800 and e == [float(len(c))] for _, c, e in by["b.TXT"])
    assert [c for _, c, _ in by["c.json"]][:2] == ['{\n  "a": 1\n}', '{\n  "a": 2\n}'] and by["c.json"][2][1] == "JSON list: 2 records, 2 listed\nFields: a\n  a: min=1, max=2, avg=1.50"
    assert [(r["path"], r["error"][:28]) for r in rejected(df).collect()] == [("/in/g.zzz", "Unsupported file type: .zzz.")]
    assert by["d.html"][0][1] == "hi & bye" and by["e.xml"][0][1] == "[XML Document: r]\n<r> t"


def test_what_is_no_record_is_kept(spark):
    files = [
        ("/in/head.csv", b"name,age\n"), ("/in/head.tsv", b"name\tage\n\t\n"), ("/in/long.csv", b"a,b\n" + b"x" * 200_000 + b",1\n"), ("/in/full.csv", b"a,b\n1,2\n"),
        ("/in/bad.json", b'[{"a": 1}, {"a"'), ("/in/after.json", b"[1] tail"), ("/in/good.json", b'[{"a": 1}]'),
    ]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    got = {}
    for r in parse_files(df).orderBy("path", "ordinal").collect():
        got.setdefault(r["path"].removeprefix("/in/"), []).append(r["content"])
    assert got.pop("long.csv")[0].count("x") == 200_000
    assert got.pop("good.json")[0].split() == ["{", '"a":', "1", "}"]
    summary = "[CSV Summary: 1 rows x 2 columns]\nColumns: a, b\n  a: min=1, max=1, avg=1.00, count=1\n  b: min=2, max=2, avg=2.00, count=1"
    assert got == {"head.csv": ["name,age\n"], "head.tsv": ["name\tage\n\t\n"], "full.csv": ["a: 1 | b: 2", summary], "bad.json": ['[{"a": 1}, {"a"'], "after.json": ["[1] tail"]}


def test_word_parts_are_kept(spark):
    p = lambda text: f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"
    link = '<w:p><w:hyperlink r:id="r9"><w:r><w:t>site</w:t></w:r></w:hyperlink></w:p>'
    word = zipped({
        "word/document.xml": f'<w:document xmlns:w="w" xmlns:r="r"><w:body>{p("Intro")}<w:tbl><w:tr><w:tc>{p("celltext")}</w:tc></w:tr></w:tbl>{link}</w:body></w:document>',
        "word/_rels/document.xml.rels": REL.format('<Relationship Id="r9" Type="x/hyperlink" Target="http://x" TargetMode="External"/><Relationship Id="r8" Type="x/footnotes" Target="footnotes.xml"/>'),
        "word/footnotes.xml": f'<w:footnotes xmlns:w="w"><w:footnote w:id="1">{p("footsaid")}</w:footnote></w:footnotes>',
    })
    files = spark.createDataFrame([("/d.docx", bytearray(word))], "path string, content binary")
    got = [r["content"] for r in parse_files(files).orderBy("ordinal").collect()]
    assert got == ["Intro\nsite", "celltext", "[1] footsaid", "site -> http://x"]
