"""Ingest of files: the fixture tables written as CSV, JSON, logs and Office files of bounded size, then parsed."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaro.functions import cells
from tessaro.functions import text as tx
from tessaro.operators import ingest, store
from tessaro.operators.context import ordered_concat
from tessaro.plans.catalog import query
from tessaro.session import table
from tessaro.sources import ooxml, pages, sheets
from tessaro.sources.routing import parser_of
from tessaro.sources.shared import each_row, new_folder, written

#: Rows of a table that one made file holds.
FILE_ROWS = 20
TEXT = ("text",)
_BESIDE = ingest.BESIDE


def files_of(rows: DataFrame, key: str, line: Column, path: Column, head: str, between: str, tail: str = "", charset: str = "utf-8") -> DataFrame:
    """(path, content): FILE_ROWS rows a file by key, a line each."""
    made = rows.select(F.floor(F.col(key) / FILE_ROWS).alias("file"), F.col(key).alias("at"), line.alias("line"))
    texts = made.groupBy("file").agg(F.concat(F.lit(head), ordered_concat(F.col("line"), F.col("at"), between), F.lit(tail)).alias("text"))
    return texts.select(path.alias("path"), F.encode("text", charset).alias("content"))


_CUSTOMER_FILE = f"(c_custkey // {FILE_ROWS})"


@query(
    f"""SELECT 'c' || f || CASE WHEN f % 2 = 0 THEN '.csv' ELSE '.tsv' END AS path, (row_number() OVER (PARTITION BY f ORDER BY c_custkey) + 1)::BIGINT AS ordinal,
    'name: ' || c_name || ' | segment: ' || c_mktsegment AS content FROM (SELECT *, {_CUSTOMER_FILE}::BIGINT AS f FROM customer)
    UNION ALL SELECT 'c' || f || CASE WHEN f % 2 = 0 THEN '.csv' ELSE '.tsv' END, {_BESIDE}, '[CSV Summary: ' || count(*) || ' rows x 3 columns]' || chr(10) || 'Columns: name, none, segment'
    FROM (SELECT {_CUSTOMER_FILE}::BIGINT AS f FROM customer) GROUP BY f"""
)
def ingest_csv(spark, sf_dir):
    """Semicolons are sniffed in .csv files, tabs given in .tsv files; blank values are left out."""
    customers = table(spark, sf_dir, "customer")
    made = []
    for odd, sep, ext in ((0, ";", ".csv"), (1, "\t", ".tsv")):
        some = customers.where(F.floor(F.col("c_custkey") / FILE_ROWS) % 2 == odd)
        line = F.concat_ws(sep, "c_name", F.lit(" "), "c_mktsegment")
        made.append(files_of(some, "c_custkey", line, F.concat(F.lit("c"), F.col("file"), F.lit(ext)), f"name{sep}none{sep}segment\n", "\n"))
    return ingest.parse_files(made[0].unionByName(made[1]), TEXT)


@query(
    f"""WITH c AS (SELECT *, {_CUSTOMER_FILE}::BIGINT AS f FROM customer), s AS (SELECT f, count(*) AS n, min(c_custkey) AS a, max(c_custkey) AS b, avg(c_custkey) AS m,
    min(c_nationkey) AS low, max(c_nationkey) AS high, avg(c_nationkey) AS mean FROM c WHERE c_mktsegment <> 'BUILDING' GROUP BY f)
    SELECT 'n' || f || '.csv' AS path, '[CSV Summary: ' || n || ' rows x 3 columns]' || chr(10) || 'Columns: key, name, nation' || chr(10)
    || '  key: min=' || a || ', max=' || b || ', avg=' || format('{{:.2f}}', m) || ', count=' || n || chr(10)
    || '  nation: min=' || low || ', max=' || high || ', avg=' || format('{{:.2f}}', mean) || ', count=' || n AS content FROM s"""
)
def ingest_csv_summary(spark, sf_dir):
    """The statistics that a CSV file's rows are followed by; blank lines are no rows."""
    customers = table(spark, sf_dir, "customer")
    line = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.concat_ws(",", "c_custkey", "c_name", "c_nationkey"))
    some = customers.withColumn("file", F.floor(F.col("c_custkey") / FILE_ROWS)).where("c_mktsegment <> 'BUILDING'").select("file").distinct()
    made = files_of(customers, "c_custkey", line, F.concat(F.lit("n"), F.col("file"), F.lit(".csv")), "key,name,nation\n", "\n")
    out = ingest.parse_files(made.join(some.select(F.concat(F.lit("n"), F.col("file"), F.lit(".csv")).alias("path")), "path"), TEXT)
    return out.where(F.col("ordinal") == _BESIDE).select("path", "content")


@query(f"""SELECT 'h' || n_nationkey || '.csv' AS path, 1::BIGINT AS ordinal, 'key,' || n_name AS content FROM nation""")
def ingest_csv_header_only(spark, sf_dir):
    """A CSV file without a record is one text."""
    nation = table(spark, sf_dir, "nation")
    return ingest.parse_files(nation.select(F.concat(F.lit("h"), "n_nationkey", F.lit(".csv")).alias("path"), F.encode(F.concat(F.lit("key,"), "n_name"), "utf-8").alias("content")), TEXT)


_EVENT_FILES = f"e AS (SELECT *, event_id // {FILE_ROWS} AS f FROM events)"


@query(
    f"""WITH {_EVENT_FILES} SELECT 'e' || f || '.json' AS path, row_number() OVER (PARTITION BY f ORDER BY event_id)::BIGINT AS ordinal,
    '{{' || chr(10) || '  "id": ' || event_id || ',' || chr(10) || '  "kind": "' || event_type || '"' || chr(10) || '}}' AS content FROM e
    UNION ALL SELECT 'e' || f || '.json', {_BESIDE}, 'JSON list: ' || count(*) || ' records, ' || count(*) || ' listed' || chr(10) || 'Fields: id, kind'
    || chr(10) || '  id: min=' || min(event_id) || ', max=' || max(event_id) || ', avg=' || format('{{:.2f}}', avg(event_id)) FROM e GROUP BY f"""
)
def ingest_json(spark, sf_dir):
    line = F.concat(F.lit('{"id":'), "event_id", F.lit(',"kind":"'), "event_type", F.lit('"}'))
    return ingest.parse_files(files_of(table(spark, sf_dir, "events"), "event_id", line, F.concat(F.lit("e"), F.col("file"), F.lit(".json")), "[", ",", "]"), TEXT)


@query(
    f"""WITH {_EVENT_FILES}, l AS (SELECT f, row_number() OVER (PARTITION BY f ORDER BY event_id) AS n, CASE event_id % 3 WHEN 0 THEN 'Error ' WHEN 1 THEN 'warning ' ELSE 'fine ' END || event_id AS line FROM e)
    SELECT 'l' || f || '.log' AS path, 1::BIGINT AS ordinal, string_agg(line, chr(10) ORDER BY n) AS content FROM l GROUP BY f
    UNION ALL SELECT 'l' || f || '.log', {_BESIDE}, 'Log issues: ' || count(*) FILTER (line LIKE 'E%') || ' errors, ' || count(*) FILTER (line LIKE 'w%') || ' warnings'
    || coalesce(chr(10) || chr(10) || 'Errors:' || chr(10) || string_agg('L' || n || ': ' || line, chr(10) ORDER BY n) FILTER (line LIKE 'E%'), '')
    || coalesce(chr(10) || chr(10) || 'Warnings:' || chr(10) || string_agg('L' || n || ': ' || line, chr(10) ORDER BY n) FILTER (line LIKE 'w%'), '') FROM l GROUP BY f HAVING count(*) FILTER (line NOT LIKE 'f%') > 0"""
)
def ingest_log(spark, sf_dir):
    """Log files in UTF-16, which their marks tell: the text, then its issues."""
    word = F.when(F.col("event_id") % 3 == 0, "Error ").when(F.col("event_id") % 3 == 1, "warning ").otherwise("fine ")
    return ingest.parse_files(files_of(table(spark, sf_dir, "events"), "event_id", F.concat(word, "event_id"), F.concat(F.lit("l"), F.col("file"), F.lit(".log")), "", "\n", charset="utf-16"), TEXT)


@query(
    """SELECT 'd' || doc_id || '.md' AS filename, '.md' AS file_type, octet_length(encode(text))::BIGINT AS file_size FROM documents
    UNION ALL SELECT 'x' || c_nationkey || '.csv', '.csv', sum(length(c_name) + 1)::BIGINT + 4 FROM customer GROUP BY c_nationkey"""
)
def ingest_documents(spark, sf_dir):
    """The documents' half of an ingest: names, types and sizes."""
    texts = table(spark, sf_dir, "documents").select(F.concat(F.lit("in/d"), "doc_id", F.lit(".md")).alias("path"), F.encode("text", "utf-8").alias("content"))
    some = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(ordered_concat(F.col("c_name"), F.col("c_custkey"), "\n").alias("t"))
    sheets_ = some.select(F.concat(F.lit("in/x"), "c_nationkey", F.lit(".csv")).alias("path"), F.encode(F.concat(F.lit("name\n"), "t"), "utf-8").alias("content"))
    documents, _ = ingest.ingest(texts.unionByName(sheets_), "u", parsers=TEXT)
    return documents.select("filename", "file_type", F.col("file_size").cast("long").alias("file_size"))


@query(
    f"""SELECT 'c' || f || '.csv' AS filename, (row_number() OVER (PARTITION BY f ORDER BY c_custkey) - 1)::INT AS chunk_index, 'name: ' || c_name AS content
    FROM (SELECT *, {_CUSTOMER_FILE}::BIGINT AS f FROM customer)
    UNION ALL SELECT 'c' || f || '.csv', count(*)::INT, '[CSV Summary: ' || count(*) || ' rows x 1 columns]' || chr(10) || 'Columns: name' FROM (SELECT {_CUSTOMER_FILE}::BIGINT AS f FROM customer) GROUP BY f"""
)
def ingest_chunks(spark, sf_dir):
    """The chunks' half: a record a chunk, numbered in order."""
    made = files_of(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_name"), F.concat(F.lit("c"), F.col("file"), F.lit(".csv")), "name\n", "\n")
    _, chunks = ingest.ingest(made, "u", parsers=TEXT)
    return chunks.select(F.col("chunk_metadata")["filename"].alias("filename"), "chunk_index", "content")


# --- Office files ------------------------------------------------------------

_REL = '<Relationships xmlns="r"><Relationship Id="r1" Type="x/{kind}" Target="{target}"/></Relationships>'


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def packed(rows: DataFrame, parts: Callable[[str], dict[str, str]]) -> DataFrame:
    """(path, content): a zip file of rows(path, xml), with the parts that its XML stands in."""
    return each_row(rows.select("path", "xml"), lambda path, xml: [(path, _zipped(parts(xml)))], "path string, content binary")


def _book(rows: str) -> dict[str, str]:
    """A workbook of one sheet from its rows' XML."""
    book = '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="Parts" sheetId="1" r:id="r1"/></sheets><definedNames><definedName name="Rate">Parts!$A$1</definedName></definedNames></workbook>'
    return {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": _REL.format(kind="worksheet", target="worksheets/s.xml"), "xl/worksheets/s.xml": f'<worksheet xmlns="m"><sheetData>{rows}</sheetData></worksheet>'}


def _word_file(body: str) -> dict[str, str]:
    return {"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'}


def _slide(body: str) -> dict[str, str]:
    head = '<p:p xmlns:p="p" xmlns:r="http://r"><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:p>'
    return {"ppt/presentation.xml": head, "ppt/_rels/presentation.xml.rels": _REL.format(kind="slide", target="slides/slide1.xml"), "ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="a">{body}</p:sld>'}


def books(spark, sf_dir) -> DataFrame:
    """Workbooks of FILE_ROWS parts: name, size, a formula of the size, and nothing else."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.floor(F.col("p_partkey") / FILE_ROWS).alias("file"))
    placed = part.withColumn("row", F.col("p_partkey") % FILE_ROWS + 2)
    cell = lambda column, inner, kind="": F.concat(F.lit(f'<c r="{column}'), F.col("row"), F.lit(f'"{kind}>'), *inner, F.lit("</c>"))
    name = cell("A", [F.lit("<is><t>"), F.col("p_name"), F.lit("</t></is>")], ' t="inlineStr"')
    size = cell("B", [F.lit("<v>"), F.col("p_size"), F.lit("</v>")])
    twice = cell("C", [F.lit("<f>B"), F.col("row"), F.lit("*2</f><v>"), 2 * F.col("p_size"), F.lit("</v>")])
    line = F.concat(F.lit('<row r="'), F.col("row"), F.lit('">'), name, size, twice, F.lit("</row>"))
    head = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{t}</t></is></c>' for c, t in zip("ABC", ("Part", "Size", "Twice")))
    rows = placed.groupBy("file").agg(F.concat(F.lit(f'<row r="1">{head}</row>'), ordered_concat(line, F.col("row"), "")).alias("rows"))
    made = packed(rows.select(F.concat(F.lit("b"), F.col("file"), F.lit(".xlsx")).alias("path"), F.col("rows").alias("xml")), _book)
    return made.withColumn("parser", parser_of(F.col("path")))


def book_facts(spark, sf_dir) -> DataFrame:
    """The workbooks' facts as a table: files are made and opened once for all that is derived from them."""
    return written(ooxml.facts(books(spark, sf_dir)), new_folder(spark, "facts"))


_BOOKS = f"p AS (SELECT p_name, p_size, p_partkey // {FILE_ROWS} AS f, p_partkey % {FILE_ROWS} + 2 AS r FROM part)"


@query(
    f"""WITH {_BOOKS} SELECT 'b' || f || '.xlsx' AS path, 'Parts' AS sheet, r::INT AS row, 'Part: ' || p_name || ' | Size: ' || p_size || ' | Twice: ' || 2 * p_size || ' <- =B' || r || '*2'
    || ' | [Row total: ' || 3 * p_size || ', count: 2, avg: ' || format('{{:,.1f}}', 1.5 * p_size) || ']' AS content FROM p"""
)
def workbook_rows(spark, sf_dir):
    return sheets.row_documents(book_facts(spark, sf_dir)).select("path", "sheet", F.col("row").cast("int").alias("row"), "content")


@query(
    f"""WITH {_BOOKS}, b AS (SELECT f, 'b' || f || '.xlsx' AS path, count(*) AS n, max(r) AS last, sum(p_size) AS total, avg(p_size) AS mean, min(p_size) AS low, max(p_size) AS high,
        string_agg('Parts!C' || r || ': ' || 2 * p_size || ' <- =B' || r || '*2', chr(10) ORDER BY r) AS formulas FROM p GROUP BY f),
    s AS (SELECT *, unnest([1, 2]) AS k, unnest(['Size', 'Twice']) AS header FROM b WHERE n >= 2)
    SELECT path, 1 AS block, 'Sheet Parts: ' || last || ' rows, 3 columns; ' || (3 * n + 3) || ' cells' AS content FROM b
    UNION ALL SELECT path, 2, 'Statistics of Parts' || chr(10) || string_agg('  ' || header || ': n=' || n || ' total=' || k * total || ' mean=' || regexp_replace(round(k * mean, 2)::VARCHAR, '\\.0$', '')
        || ' low=' || k * low || ' high=' || k * high, chr(10) ORDER BY k) FROM s GROUP BY path
    UNION ALL SELECT path, 3, 'Annotations of the workbook' || chr(10) || 'named_range: Rate = Parts!$A$1' FROM b
    UNION ALL SELECT path, 4, n || ' formulas, 0 to other sheets' || chr(10) || formulas FROM b
    UNION ALL SELECT 'b' || f || '.xlsx', 0, 'Part: ' || p_name || ' | Size: ' || p_size || ' | Twice: ' || 2 * p_size || ' <- =B' || r || '*2'
        || ' | [Row total: ' || 3 * p_size || ', count: 2, avg: ' || format('{{:,.1f}}', 1.5 * p_size) || ']' FROM p"""
)
def ingest_workbook(spark, sf_dir):
    """All that ingest makes of workbooks: rows, then each sheet's summary and statistics, annotations and formulas."""
    out = ingest.parse_files(books(spark, sf_dir).drop("parser"), ("excel",))
    return out.select("path", F.floor(F.col("ordinal") / _BESIDE).cast("int").alias("block"), "content")


@query(
    f"""WITH {_BOOKS}, n AS (SELECT f, 'Size' AS header, p_size AS v FROM p UNION ALL SELECT f, 'Twice', 2 * p_size FROM p)
    SELECT 'b' || f || '.xlsx' AS path, header, count(*) AS n, round(sum(v), 2)::DOUBLE AS total, round(avg(v), 2) AS mean, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high FROM n GROUP BY f, header HAVING count(*) >= 2"""
)
def workbook_statistics(spark, sf_dir):
    return sheets.column_statistics(book_facts(spark, sf_dir)).select("path", "header", "n", "total", "mean", "low", "high")


@query(
    f"""WITH {_BOOKS} SELECT 'b' || f || '.xlsx' AS path, count(*) AS formula_count, 0::BIGINT AS cross_sheet_count, string_agg('Parts!C' || r || ': ' || 2 * p_size || ' <- =B' || r || '*2', chr(10) ORDER BY r) AS formulas FROM p GROUP BY f"""
)
def workbook_formulas(spark, sf_dir):
    return sheets.formulas(book_facts(spark, sf_dir)).select("path", "formula_count", "cross_sheet_count", "formulas")


@query(
    f"""WITH {_BOOKS} SELECT 'b' || f || '.xlsx' AS path, 'visible' AS visibility, max(r)::INT AS last_row, 3 AS last_col, (3 * count(*) + 3)::BIGINT AS n_cell, 0::BIGINT AS n_merge FROM p GROUP BY f"""
)
def workbook_summary(spark, sf_dir):
    return sheets.sheet_summaries(book_facts(spark, sf_dir)).select("path", "visibility", "last_row", "last_col", "n_cell", "n_merge")


@query(f"""WITH {_BOOKS} SELECT DISTINCT 'b' || f || '.xlsx' AS path, 'named_range' AS kind, 'Rate = Parts!$A$1' AS content FROM p""")
def workbook_annotations(spark, sf_dir):
    return sheets.annotations(book_facts(spark, sf_dir)).select("path", "kind", "content")


def _paragraph(text: Column, style: str = "") -> Column:
    return F.concat(F.lit(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>'), text, F.lit("</w:t></w:r></w:p>"))


def word_files(spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    row = F.concat(F.lit("<w:tbl><w:tr><w:tc>"), _paragraph(F.col("n_name")), F.lit("</w:tc><w:tc>"), _paragraph(F.col("n_regionkey").cast("string")), F.lit("</w:tc></w:tr></w:tbl>"))
    body = F.concat(_paragraph(F.lit("before")), _paragraph(F.col("n_name"), "Heading2"), _paragraph(F.concat(F.lit("key "), "n_nationkey")), row)
    return packed(nation.select(F.concat(F.lit("w"), "n_nationkey", F.lit(".docx")).alias("path"), body.alias("xml")), _word_file)


@query(
    f"""SELECT 'w' || n_nationkey || '.docx' AS path, o::BIGINT AS ordinal, CASE o WHEN 0 THEN 'before' WHEN 1 THEN '## ' || n_name || chr(10) || 'key ' || n_nationkey ELSE n_name || ' | ' || n_regionkey END AS content
    FROM nation, (VALUES (0), (1), ({_BESIDE} + 1)) v(o)"""
)
def ingest_word(spark, sf_dir):
    out = ingest.parse_files(word_files(spark, sf_dir), ("word",))
    return out.select("path", "ordinal", "content")


@query("SELECT 's' || n_nationkey || '.pptx' AS path, 1 AS slide, n_name AS title, '## ' || n_name || chr(10) || '**key ' || n_nationkey || '**' || chr(10) || '- small' AS content FROM nation")
def slide_texts(spark, sf_dir):
    shape = lambda text, size: F.concat(F.lit(f'<p:sp><p:txBody><a:p><a:r><a:rPr sz="{size}"/><a:t>'), text, F.lit("</a:t></a:r></a:p></p:txBody></p:sp>"))
    body = F.concat(shape(F.col("n_name"), 2400), shape(F.concat(F.lit("key "), "n_nationkey"), 1800), shape(F.lit("small"), 1200))
    files = packed(table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), "n_nationkey", F.lit(".pptx")).alias("path"), body.alias("xml")), _slide)
    out = pages.slide_documents(ooxml.facts(files.withColumn("parser", parser_of(F.col("path")))))
    return out.select("path", F.col("slide").cast("int").alias("slide"), "title", "content")


# --- scalars and the service's tables ----------------------------------------


@query("SELECT o_orderkey, format('{:g}', v) AS shown FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice + 0.25 WHEN 1 THEN o_totalprice * 64 + 0.5 ELSE 1 / (o_totalprice * 16 + 0.5) END AS v FROM orders) WHERE v <> floor(v)")
def general_format(spark, sf_dir):
    """Numbers without a format: six digits, an exponent where they are large or small."""
    price = F.col("o_totalprice")
    v = F.when(F.col("o_orderkey") % 3 == 0, price + 0.25).when(F.col("o_orderkey") % 3 == 1, price * 64 + 0.5).otherwise(1 / (price * 16 + 0.5))
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v")).where("v <> floor(v)").select("o_orderkey", cells.general(F.col("v")).alias("shown"))


@query("SELECT conv_id, array_to_string(list_transform(list(role ORDER BY turn), lambda r: '{' || r || '}'), '') AS sources FROM conversations GROUP BY 1 UNION ALL SELECT NULL, ''")
def format_sources(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    lists = conv.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("s"))
    lists = lists.unionByName(spark.range(1).select(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("array<string>").alias("s")))
    return lists.select("conv_id", F.array_join(F.transform(tx.format_sources(F.col("s")), lambda x: F.concat(F.lit("{"), x["filename"], F.lit("}"))), "").alias("sources"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::VARCHAR END, '') AS s FROM customer")
def safe_strings(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tx.safe_string(F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey"))).alias("s"))


def _turns(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    made = conv.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"),
        F.array().cast("array<string>").alias("sources"), F.timestamp_seconds(F.col("turn")).alias("created_at"), "turn",
    )
    first = made.groupBy("session_id").agg(F.min("created_at").alias("created_at"))
    sessions = first.select(F.col("session_id").alias("id"), F.lit("u").alias("user_id"), F.lit(store.NEW_TITLE).alias("title"), F.array().cast("array<string>").alias("document_ids"), "created_at", F.col("created_at").alias("updated_at"))
    return sessions, made


@query(
    """WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS q, max(turn) FILTER (turn > 0) AS last, min(turn) AS first FROM conversations GROUP BY 1)
    SELECT conv_id::VARCHAR AS id, CASE WHEN q IS NULL THEN 'New Chat' ELSE substring(q, 1, 50) || CASE WHEN length(q) > 50 THEN '...' ELSE '' END END AS title, greatest(first, coalesce(last, first))::BIGINT AS updated FROM f"""
)
def append_messages(spark, sf_dir):
    """Turns after the first come as new messages: sessions are touched and get their titles."""
    sessions, made = _turns(spark, sf_dir)
    old, new = made.where("turn = 0").drop("turn"), made.where("turn > 0").drop("turn")
    return store.append_messages(sessions, old, new)[0].select("id", "title", F.unix_timestamp("updated_at").alias("updated"))


@query("SELECT conv_id::VARCHAR AS id, 'New Chat' AS title, '' AS document_ids FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT 'made', 'Mine', 'a,b'")
def create_session(spark, sf_dir):
    sessions, _ = _turns(spark, sf_dir)
    return store.create_session(sessions, "made", "u", ["b", "a", "b"], "Mine").select("id", "title", F.array_join("document_ids", ",").alias("document_ids"))


@query("SELECT doc_id::VARCHAR AS id FROM documents WHERE source = 'src1' ORDER BY n_chars DESC, doc_id::VARCHAR LIMIT 25")
def newest_documents(spark, sf_dir):
    """A user's documents by time (size here), newest first; the first page."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("user_id"), F.timestamp_seconds("n_chars").alias("created_at"))
    return store.list_documents(docs, "src1").limit(25).select("id")


@query(
    f"""SELECT 'd' || f AS id, CASE WHEN f % 3 = 0 THEN 'missing' ELSE 'ok' END AS status, CASE WHEN f % 3 = 0 THEN 0 ELSE count(*) + 1 END::INT AS chunk_count FROM (SELECT {_CUSTOMER_FILE} AS f FROM customer) GROUP BY f"""
)
def reingest_migration(spark, sf_dir):
    """Documents parsed, split and counted again; every third has no file."""
    customers = table(spark, sf_dir, "customer")
    made = files_of(customers, "c_custkey", F.col("c_name"), F.concat(F.lit("c"), F.col("file"), F.lit(".csv")), "name\n", "\n")
    number = F.regexp_extract("path", r"(\d+)", 1)
    documents = made.select(F.concat(F.lit("d"), number).alias("id"), F.lit("u1").alias("user_id"), F.col("path").alias("file_path"), F.lit(0).alias("chunk_count"))
    documents, _, _ = store.reingest(documents, made.where(number.cast("int") % 3 != 0), parsers=TEXT)
    return documents.select("id", "status", "chunk_count")
