"""Word and spreadsheet files (zipped XML) read with the standard library, in Arrow batches.

Old binary .doc files have to be converted by another program first, and PDF files rendered to text; both then come in
as .docx and as text.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

GRIDS = "array<array<array<string>>>"
PARAGRAPHS = "array<struct<text:string,is_header:boolean>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def read_docx(data: bytes) -> tuple[list[dict], list[list[list[str]]]]:
    """(paragraphs, tables). A paragraph is a header when the size of its style is above the least that occurs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = ET.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None
    sizes: dict[str, float] = {}
    default = 11.0
    for style in styles.iter(f"{_W}style") if styles is not None else ():
        size = style.find(f"{_W}rPr/{_W}sz")
        if size is not None:
            sizes[style.get(f"{_W}styleId")] = float(size.get(f"{_W}val")) / 2
        if style.get(f"{_W}default") == "1" and style.get(f"{_W}type") == "paragraph" and size is not None:
            default = float(size.get(f"{_W}val")) / 2

    def text(p: ET.Element) -> str:
        return "".join("\t" if e.tag == f"{_W}tab" else "\n" if e.tag == f"{_W}br" else e.text or "" for e in p.iter() if e.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))

    found = []
    for p in body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        found.append((text(p), sizes.get(style.get(f"{_W}val"), default) if style is not None else default))
    least = min((s for _, s in found), default=0)
    tables = [[["\n".join(text(p) for p in c.findall(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")] for t in body.findall(f"{_W}tbl")]
    return [{"text": t, "is_header": s > least} for t, s in found], tables


def read_xlsx(data: bytes) -> list[list[list[str]]]:
    """A grid of strings for each sheet, in order; dates as text, blank cells empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [("".join(t.text or "" for t in si.iter(f"{_S}t"))) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        formats: list[bool] = []
        if "xl/styles.xml" in names:
            sheet = ET.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in sheet.iter(f"{_S}numFmt")}
            for xf in sheet.findall(f"{_S}cellXfs/{_S}xf"):
                n = int(xf.get("numFmtId", 0))
                formats.append(n in _DATES or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")).lower())))
        book = ET.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in book.iter(f"{_S}sheet"):
            target = targets[s.get(f"{_R}id")]
            rows: dict[int, dict[int, str]] = {}
            for r, row in enumerate(ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_S}row")):
                at = int(row.get("r", r + 1)) - 1
                for c, cell in enumerate(row.findall(f"{_S}c")):
                    ref = re.match(r"[A-Z]+", cell.get("r", ""))
                    col = _column(ref[0]) if ref else c
                    rows.setdefault(at, {})[col] = _cell(cell, shared, formats)
            width = max((max(r) + 1 for r in rows.values() if r), default=0)
            out.append([[rows[i].get(j, "") for j in range(width)] for i in sorted(rows)])
        return out


def _column(letters: str) -> int:
    n = 0
    for x in letters:
        n = 26 * n + ord(x) - 64
    return n - 1


def _cell(cell: ET.Element, shared: list[str], formats: list[bool]) -> str:
    kind, value = cell.get("t"), cell.find(f"{_S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    raw = value.text if value is not None and value.text is not None else ""
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    style = int(cell.get("s", 0))
    if raw and kind in (None, "n") and style < len(formats) and formats[style]:
        # day 60 is one that never was; days count from the end of 1899
        return str(dt.datetime(1899, 12, 30) + dt.timedelta(days=round(float(raw) * 86400) / 86400))
    return raw


def _reader(schema: str, read: Callable[[bytes], tuple]) -> Callable[[DataFrame, str], DataFrame]:
    def apply(files: DataFrame, content: str = "content") -> DataFrame:
        kept = [f for f in files.schema.fields if f.name != content]
        names = [x.split(" ")[0] for x in schema.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for x in pdf[content]:
                    try:
                        rows.append((*read(bytes(x)), None))
                    except Exception as e:  # noqa: BLE001
                        rows.append((*([None] * (len(names) - 1)), f"{type(e).__name__}: {e}"))
                out = pdf.drop(columns=[content])
                for i, name in enumerate(names):
                    out[name] = pd.Series([r[i] for r in rows], index=out.index, dtype=object)
                yield out

        return files.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), schema]))

    return apply


#: files with paragraphs and grids, or with grids, and parse_error instead of their bytes.
read_word = _reader(f"paragraphs {PARAGRAPHS}, grids {GRIDS}, parse_error string", read_docx)
read_excel = _reader(f"grids {GRIDS}, parse_error string", lambda b: (read_xlsx(b),))


# the same formats written, plain


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def write_docx(paragraphs: list[tuple[str, bool]], tables: list[list[list[str]]] = ()) -> bytes:
    """Paragraphs (text, is_header) and tables as a .docx file."""
    ns = f'xmlns:w="{_W[1:-1]}"'

    def one(text: str, header: bool = False) -> str:
        style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if header else ""
        return f"<w:p>{style}<w:r><w:t xml:space='preserve'>{escape(text)}</w:t></w:r></w:p>"

    grids = "".join("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{one(c)}</w:tc>" for c in row) + "</w:tr>" for row in t) + "</w:tbl>" for t in tables)
    body = "".join(one(*p) for p in paragraphs) + grids
    styles = f'<w:styles {ns}><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:rPr><w:sz w:val="22"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="Heading1"><w:rPr><w:sz w:val="32"/></w:rPr></w:style></w:styles>'
    return _zip({"word/document.xml": f"<w:document {ns}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})


def write_xlsx(sheets: list[list[list[str]]]) -> bytes:
    """Grids of strings as an .xlsx file, a sheet each."""
    ns = f'xmlns="{_S[1:-1]}"'
    files = {
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="{_R[1:-1]}"><sheets>' + "".join(f'<sheet name="s{i}" sheetId="{i}" r:id="r{i}"/>' for i in range(1, len(sheets) + 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>",
    }
    for i, grid in enumerate(sheets, 1):
        rows = "".join(f'<row r="{r}">' + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in row) + "</row>" for r, row in enumerate(grid, 1))
        files[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>"
    return _zip(files)
