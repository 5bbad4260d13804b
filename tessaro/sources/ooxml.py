"""Office files as rows of facts.

Python opens the zip container and lists what is there, one row a fact; everything
that is decided about them (headers, totals, row texts, statistics, sections) is
DataFrame work in sheets.py and pages.py.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame

from tessaro.sources.shared import each_row

#: part: sheet, slide or story; kind: what the fact is; a and b are places (row and column, or order and level).
FACTS = "path string, part string, part_no int, kind string, a int, b int, name string, text string, number double, flags string, parse_error string"
# Fixed value: columns that a sheet can have.
LAST_COLUMN = 16_384


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(node: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in node.iter() if _local(x.tag) == name)


def _attr(node: ET.Element | None, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None) if node is not None else None


class _Package:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def targets(self, name: str) -> dict[str, tuple[str, str]]:
        """Relation id -> (kind, part or url)."""
        folder, file = posixpath.split(name)
        root = self.xml(f"{folder}/_rels/{file}.rels".lstrip("/"))
        out = {}
        for r in root if root is not None else ():
            target = r.attrib.get("Target", "")
            if r.attrib.get("TargetMode") != "External":
                target = posixpath.normpath(posixpath.join(folder, target)) if not target.startswith("/") else target[1:]
            out[r.attrib.get("Id")] = (r.attrib.get("Type", "").rpartition("/")[2], target)
        return out

    def properties(self) -> Iterator[tuple]:
        for part in ("docProps/core.xml", "docProps/app.xml"):
            for node in self.xml(part) if part in self.names else ():
                if node.text and node.text.strip():
                    yield ("", 0, "property", None, None, _local(node.tag), node.text.strip(), None, None)


def _place(ref: str) -> tuple[int, int]:
    """Row and column, from 1, of a reference such as B12."""
    letters, digits = re.match(r"\$?([A-Za-z]*)\$?(\d*)", ref).groups()
    column = 0
    for c in letters.upper():
        column = 26 * column + ord(c) - 64
    return int(digits or 0), column


def _styles(package: _Package) -> list[tuple[bool, bool, str]]:
    """(bold, filled, number format) by style number."""
    root = package.xml("xl/styles.xml")
    if root is None:
        return []
    # Built-in number formats that show something else than General.
    known = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm",
             17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)",
             39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@"}
    formats = known | {int(n.attrib["numFmtId"]): n.attrib.get("formatCode", "General") for n in _all(root, "numFmt")}
    group = lambda name: next(iter(_all(root, name)), ET.Element("none"))
    bold = [any(_local(x.tag) == "b" and x.attrib.get("val", "1") not in ("0", "false") for x in f) for f in group("fonts")]
    filled = [any(p.attrib.get("patternType", "none") not in ("none", "gray125") for p in _all(f, "patternFill")) for f in group("fills")]
    at = lambda values, i: values[i] if i < len(values) else False
    return [
        (at(bold, int(x.attrib.get("fontId", 0))), at(filled, int(x.attrib.get("fillId", 0))), formats.get(int(x.attrib.get("numFmtId", 0)), "General"))
        for x in group("cellXfs")
    ]


def _workbook(package: _Package) -> Iterator[tuple]:
    book, rels = package.xml("xl/workbook.xml"), package.targets("xl/workbook.xml")
    shared_root = package.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in _all(si, "t")) for si in shared_root] if shared_root is not None else []
    styles = _styles(package)
    yield from package.properties()
    if "xl/vbaProject.bin" in package.names:
        yield ("", 0, "property", None, None, "vba", "yes", None, None)
    for node in _all(book, "definedName"):
        yield ("", 0, "named_range", None, None, node.attrib.get("name"), node.text, None, node.attrib.get("localSheetId"))
    for number, sheet in enumerate(_all(book, "sheet"), 1):
        name, part = sheet.attrib.get("name"), rels.get(_attr(sheet, "id"), ("", ""))[1]
        yield (name, number, "sheet", None, None, sheet.attrib.get("state", "visible"), part, None, None)
        root = package.xml(part)
        if root is not None:
            yield from ((name, number, *fact) for fact in _sheet(root, shared, styles))
            for kind, target in package.targets(part).values():
                yield from ((name, number, *fact) for fact in _beside(package, kind, target))
    for part in sorted(n for n in package.names if re.match(r"xl/pivotTables/[^/]+\.xml$", n)):
        root = package.xml(part)
        axes = {kind: len(list(next(iter(_all(root, kind)), []))) for kind in ("rowFields", "colFields", "pageFields", "dataFields")}
        place = next((x.attrib.get("ref") for x in _all(root, "location")), None)
        yield ("", 0, "pivot", None, None, root.attrib.get("name"), place, None, ", ".join(f"{k}={v}" for k, v in axes.items()))
    for part in sorted(n for n in package.names if n.startswith("xl/media/")):
        yield ("", 0, "image", None, None, posixpath.basename(part), None, float(package.zip.getinfo(part).file_size), None)


def _sheet(root: ET.Element, shared: list[str], styles: list[tuple[bool, bool, str]]) -> Iterator[tuple]:
    for row in _all(root, "row"):
        r = int(row.attrib.get("r", 0))
        if row.attrib.get("hidden") in ("1", "true"):
            yield ("hidden_row", r, None, None, None, None, None)
        if int(row.attrib.get("outlineLevel", 0)):
            yield ("row_outline", r, None, None, None, float(row.attrib["outlineLevel"]), None)
        for c in row:
            at, column = _place(c.attrib.get("r", ""))
            raw, formula, kind = None, None, c.attrib.get("t", "n")
            for x in c:
                match _local(x.tag):
                    case "v":
                        raw = x.text
                    case "is":
                        raw = "".join(t.text or "" for t in _all(x, "t"))
                    case "f":
                        formula = ("{=%s}" if x.attrib.get("t") == "array" else "=%s") % (x.text or "")
            if raw is None and formula is None:
                continue
            style = int(c.attrib.get("s", 0))
            bold, filled, fmt = styles[style] if style < len(styles) else (False, False, "General")
            text = shared[int(raw)] if kind == "s" and raw is not None else raw
            number = float(raw) if kind == "n" and raw is not None else None
            code = {"s": "s", "inlineStr": "s", "str": "s", "b": "b", "e": "e"}.get(kind, "n")
            yield ("cell", at, column, formula, text, number, "\t".join([code, "b" if bold else "", "f" if filled else "", fmt]))
    for col in _all(root, "col"):
        for c in range(int(col.attrib["min"]), min(int(col.attrib["max"]), LAST_COLUMN) + 1):
            if col.attrib.get("hidden") in ("1", "true"):
                yield ("hidden_col", None, c, None, None, None, None)
            if int(col.attrib.get("outlineLevel", 0)):
                yield ("col_outline", None, c, None, None, float(col.attrib["outlineLevel"]), None)
    for m in _all(root, "mergeCell"):
        first, _, last = m.attrib["ref"].partition(":")
        (r, c), (r2, c2) = _place(first), _place(last or first)
        yield ("merge", r, c, m.attrib["ref"], None, None, f"{r2}\t{c2}")
    for x in _all(root, "hyperlink"):
        yield ("hyperlink", *_place(x.attrib.get("ref", "")), x.attrib.get("display") or x.attrib.get("ref"), _attr(x, "location") or _attr(x, "id"), None, None)
    for x in _all(root, "dataValidation"):
        yield ("validation", None, None, x.attrib.get("sqref"), next((f.text for f in _all(x, "formula1")), None), None, x.attrib.get("type"))
    for group in _all(root, "conditionalFormatting"):
        for x in _all(group, "cfRule"):
            yield ("conditional_format", None, None, group.attrib.get("sqref"), next((f.text for f in _all(x, "formula")), None), None, _rule(x))
    for x in _all(root, "sparklineGroup"):
        for s in _all(x, "sparkline"):
            texts = [n.text for n in s.iter() if n.text and n.text.strip()]
            yield ("sparkline", None, None, texts[-1] if texts else None, texts[0] if texts else None, None, x.attrib.get("type", "line"))
    for name in ("sheetProtection", "autoFilter", "pane", "tabColor", "pageSetup"):
        for x in _all(root, name):
            yield ("setting", None, None, name, " ".join(f"{_local(k)}={v}" for k, v in sorted(x.attrib.items())), None, None)


def _rule(rule: ET.Element) -> str:
    """A conditional format's type, and its scale, bar or icons with their bounds and colours, or the number of its cell format."""
    said = [rule.attrib.get("type", "")]
    for name in ("colorScale", "dataBar", "iconSet"):
        for x in _all(rule, name):
            bounds = ["=".join(filter(None, (b.attrib.get("type"), b.attrib.get("val")))) for b in _all(x, "cfvo")]
            colours = [c.attrib.get("rgb") or f"theme {c.attrib.get('theme', '')}" for c in _all(x, "color")]
            said.append(" ".join([name, *filter(None, [x.attrib.get("iconSet")]), *bounds, *colours]))
    if "dxfId" in rule.attrib:
        said.append(f"format {rule.attrib['dxfId']}")
    return "\t".join(said)


def _beside(package: _Package, kind: str, target: str) -> Iterator[tuple]:
    """Comments, tables, charts and pictures that a sheet refers to."""
    root = package.xml(target) if target in package.names and target.endswith(".xml") else None
    if root is None:
        return
    if kind == "comments":
        authors = [a.text or "" for a in _all(root, "author")]
        for c in _all(root, "comment"):
            author = authors[int(c.attrib.get("authorId", 0))] if authors else ""
            yield ("comment", *_place(c.attrib.get("ref", "")), author, "".join(t.text or "" for t in _all(c, "t")), None, c.attrib.get("ref"))
    elif kind == "table":
        columns = ", ".join(c.attrib.get("name", "") for c in _all(root, "tableColumn"))
        yield ("table", None, None, root.attrib.get("displayName"), columns, None, root.attrib.get("ref"))
    elif kind == "drawing":
        for inner, part in package.targets(target).values():
            if inner == "image":
                yield ("picture", None, None, posixpath.basename(part), None, None, None)
            chart = package.xml(part) if inner == "chart" else None
            if chart is not None:
                area = next(iter(_all(chart, "plotArea")), chart)
                shape = next((_local(x.tag) for x in area if _local(x.tag).endswith("Chart")), "chart")
                title = next(("".join(t.text or "" for t in _all(x, "t")) for x in _all(chart, "title")), "")
                for ser in _all(area, "ser"):
                    points = [v.text or "" for val in _all(ser, "val") for v in _all(val, "v")][:10]
                    names = [v.text or "" for tx in _all(ser, "tx") for v in _all(tx, "v")]
                    yield ("chart", None, None, title, ", ".join(points), None, "\t".join([shape, *names[:1]]))


def _runs(paragraph: ET.Element) -> list[tuple[str, bool]]:
    """(text, bold) of a paragraph's runs that say something."""
    out = []
    for run in _all(paragraph, "r"):
        text = "".join((x.text or "") if _local(x.tag) == "t" else "\t" if _local(x.tag) == "tab" else "\n" if _local(x.tag) == "br" else "" for x in run)
        bold = any(_local(b.tag) == "b" and (_attr(b, "val") or "1") not in ("0", "false") for p in run if _local(p.tag) == "rPr" for b in p)
        if text:
            out.append((text, bold))
    return out


def _document(package: _Package) -> Iterator[tuple]:
    root, main = package.xml("word/document.xml"), "word/document.xml"
    styles_root = package.xml("word/styles.xml")
    styles = {_attr(s, "styleId"): next((_attr(n, "val") for n in s if _local(n.tag) == "name"), "") for s in _all(styles_root, "style")} if styles_root is not None else {}
    yield from package.properties()
    body = next(iter(_all(root, "body")))
    tables = 0
    for order, node in enumerate(body):
        if _local(node.tag) == "p":
            style = next((_attr(s, "val") for s in _all(node, "pStyle")), None)
            runs = _runs(node)
            yield ("body", 0, "paragraph", order, None, styles.get(style, style or ""), "".join(t for t, _ in runs), None, "\x1f".join(("b" if b else " ") + t for t, b in runs))
        elif _local(node.tag) == "tbl":
            tables += 1
            for r, row in enumerate(x for x in node if _local(x.tag) == "tr"):
                cells = ["\n".join("".join(t for t, _ in _runs(p)) for p in _all(c, "p")).strip() for c in row if _local(c.tag) == "tc"]
                yield ("table", tables, "table_row", r, len(cells), None, " | ".join(cells), None, None)
    for rid, (kind, target) in sorted(package.targets(main).items()):
        part = package.xml(target) if target in package.names and target.endswith(".xml") else None
        if kind in ("header", "footer") and part is not None:
            text = "\n".join(x for x in ("".join(t for t, _ in _runs(p)).strip() for p in _all(part, "p")) if x)
            yield (kind, 0, kind, None, None, rid, text, None, None)
        elif kind in ("footnotes", "endnotes") and part is not None:
            for note in part:
                yield (kind, 0, kind[:-1], int(_attr(note, "id") or 0), None, None, "".join(t for t, _ in _runs(note)).strip(), None, None)
        elif kind == "comments" and part is not None:
            for c in part:
                yield (kind, 0, "comment", int(_attr(c, "id") or 0), None, _attr(c, "author"), "".join(t for t, _ in _runs(c)).strip(), None, (_attr(c, "date") or "")[:10])
    links = package.targets(main)
    for order, link in enumerate(_all(root, "hyperlink")):
        url = links.get(_attr(link, "id"), ("", _attr(link, "anchor") or ""))[1]
        yield ("links", 0, "hyperlink", order, None, url, "".join(t for t, _ in _runs(link)), None, None)
    for part in sorted(n for n in package.names if n.startswith("word/media/")):
        yield ("", 0, "image", None, None, posixpath.basename(part), None, float(package.zip.getinfo(part).file_size), None)


def _slides(package: _Package) -> Iterator[tuple]:
    yield from package.properties()
    show, rels = package.xml("ppt/presentation.xml"), package.targets("ppt/presentation.xml")
    for number, ref in enumerate(_all(show, "sldId"), 1):
        part = rels[next(v for k, v in ref.attrib.items() if k.endswith("}id"))][1]
        root, beside = package.xml(part), package.targets(part)
        order = 0
        for shape in _all(root, "sp"):
            title = any((_attr(p, "type") or "") in ("title", "ctrTitle") for p in _all(shape, "ph"))
            for paragraph in _all(shape, "p"):
                level = next((int(_attr(p, "lvl") or 0) for p in paragraph if _local(p.tag) == "pPr"), 0)
                runs = [(r, next((t.text or "" for t in r if _local(t.tag) == "t"), "")) for r in paragraph if _local(r.tag) == "r"]
                text = "".join(t for _, t in runs).strip()
                props = [p for r, _ in runs for p in r if _local(p.tag) == "rPr"]
                size = max((float(p.attrib["sz"]) / 100 for p in props if "sz" in p.attrib), default=None)
                bold = any(p.attrib.get("b") in ("1", "true") for p in props)
                if text:
                    yield ("slide", number, "text", order, level, "title" if title else None, text, size, "b" if bold else "")
                    order += 1
        for t, table in enumerate(_all(root, "tbl")):
            for r, row in enumerate(_all(table, "tr")):
                cells = [
                    "[merged]" if c.attrib.get("hMerge") or c.attrib.get("vMerge") else "".join(x.text or "" for x in _all(c, "t")).strip() for c in row if _local(c.tag) == "tc"
                ]
                yield ("slide", number, "table_row", t, r, None, " | ".join(cells), None, None)
        for kind, target in beside.values():
            other = package.xml(target) if target in package.names and target.endswith(".xml") else None
            if kind == "notesSlide" and other is not None:
                bodies = [s for s in _all(other, "sp") if any(_attr(p, "type") == "body" for p in _all(s, "ph"))]
                yield ("slide", number, "notes", None, None, None, "\n".join("".join(t.text or "" for t in _all(p, "t")) for s in bodies for p in _all(s, "p")).strip(), None, None)
            elif kind == "comments" and other is not None:
                for c in _all(other, "cm"):
                    yield ("slide", number, "comment", None, None, None, "".join(t.text or "" for t in _all(c, "text")), None, (c.attrib.get("dt") or "")[:10])
            elif kind == "chart" and other is not None:
                for s, ser in enumerate(_all(other, "ser")):
                    values = [v.text or "" for val in _all(ser, "val") for v in _all(val, "v")][:20]
                    labels = [v.text or "" for cat in _all(ser, "cat") for v in _all(cat, "v")][:20]
                    yield ("slide", number, "chart", s, None, ", ".join(labels), ", ".join(values), None, None)
            elif kind == "image" and target in package.names:
                yield ("slide", number, "image", None, None, posixpath.basename(target), None, float(package.zip.getinfo(target).file_size), None)


_READERS = {"excel": _workbook, "word": _document, "pptx": _slides}


def _read(path: str, parser: str, content: bytes) -> list[tuple]:
    try:
        return [(path, *fact, None) for fact in _READERS[parser](_Package(content))]
    except Exception as e:  # a broken file is a row that says so
        return [(path, None, None, "error", None, None, None, None, None, None, f"{type(e).__name__}: {e}")]


def facts(files: DataFrame) -> DataFrame:
    """What there is in Office files(path, content, parser): FACTS, one row a fact.

    Files that cannot be read give one row of kind error.
    """

    def run(path: str, parser: str, content: bytes) -> list[tuple]:
        return _read(path, parser, content)

    return each_row(files.where(files["parser"].isin(*_READERS)).select("path", "parser", "content"), run, FACTS)
