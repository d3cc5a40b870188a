"""Article pages to a title, paragraphs, abbreviations and raw tables.

Rules nest (elements in sections in pages), which expressions over arrays can say only at the price of evaluating the
same text again and again; so one Arrow pass parses a page and applies them, and everything after it (types aside) is
Catalyst's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from folioframe.functions.batches import per_document
from folioframe.operators.abbreviations import document_pairs
from folioframe.operators.headings import UNKNOWN, Types
from folioframe.plans.rules import Page
from folioframe.sources.dom import parse_document

PARAGRAPH = "struct<section_heading:string,subsection_heading:string,body:string,section_type:array<struct<iao_name:string,iao_id:string>>,title:string,journal:string,volume:string>"
TABLE = "struct<title:array<string>,caption:array<string>,footer:array<string>,has_body:boolean,grid:array<array<string>>,headers:array<boolean>>"
PAIR = "struct<short:string,long:string,algorithms:array<string>>"
KEYWORDS = ("keywords section", "IAO:0000630")
REFERENCES = "IAO:0000320"


def _rules(config: dict, section: str) -> list[dict]:
    return config.get(section, {}).get("defined-by", [])


def _data(config: dict, section: str, name: str) -> list[dict]:
    return config.get(section, {}).get("data", {}).get(name, [])


class Reader:
    """Applies a config to pages; heading types are remembered between them."""

    def __init__(self, config: dict, ontology=None):
        self.config, self.types = config, Types(ontology)

    def paragraph(self, heading: str, sub: str, body: str, kinds: list[dict], title: str | None = None, journal: str | None = None, volume: str | None = None) -> dict:
        return {"section_heading": heading, "subsection_heading": sub, "body": body, "section_type": kinds, "title": title or None, "journal": journal or None, "volume": volume or None}

    def paragraphs(self, page: Page) -> list[dict]:
        """Keywords, then sections; without empty bodies, of equal ones the first; no heading is the default part."""
        out = []
        if words := page.select(_rules(self.config, "keywords")):
            out.append(self.paragraph("keywords", "", " ".join(map(page.text, words)), [{"iao_name": KEYWORDS[0], "iao_id": KEYWORDS[1]}]))
        for section in page.select(_rules(self.config, "sections")):
            heads = page.select(_data(self.config, "sections", "headers"), section)
            heading = page.text(heads[0]) if heads else ""
            kinds = self.types.of(heading)
            if heading == "Abbreviations" and "abbreviations-table" in self.config:
                out.append(self.paragraph(heading, "", self.abbreviation_table(page, section), kinds))
            elif any(k["iao_id"] == REFERENCES for k in kinds):
                out += [self.reference(page, ref, heading, kinds) for ref in page.select(_rules(self.config, "references"), section)]
            else:
                out += [self.paragraph(heading, sub, body, kinds) for sub, body in self.children(page, section)]
        seen: set[str] = set()
        kept = []
        for p in out:
            if p["body"] and p["body"] not in seen:
                seen.add(p["body"])
                if p["section_heading"] == "":
                    p |= {"section_heading": UNKNOWN[0], "section_type": [{"iao_name": UNKNOWN[0], "iao_id": UNKNOWN[1]}]}
                kept.append(p)
        return kept

    def reference(self, page: Page, ref: dict, heading: str, kinds: list[dict]) -> dict:
        fields = [". ".join(map(page.text, page.select(rules, ref))) if (rules := _data(self.config, "references", name)) else "" for name in ("title", "journal", "volume")]
        return self.paragraph(heading, "", reference_text(page.text(ref)), kinds, *fields)

    def abbreviation_table(self, page: Page, section: dict) -> str:
        """The rows of two cells of the first table, as one text."""
        for table in page.select(_rules(self.config, "abbreviations-table"), section)[:1]:
            rows = [[page.text(td) for td in page.find("td", tr)] for tr in page.find("tr", table)]
            return "; ".join(f"{r[0]}: {r[1]}" for r in rows if len(r) == 2)
        return ""

    def children(self, page: Page, section: dict) -> Iterator[tuple[str, str]]:
        """(subheading, body): paragraphs outside tables and figures and not within one another, each under the last
        heading before it, which is that of a sub-section or an h3 to h5 right before a paragraph."""
        boxes = [b for kind in ("tables", "figures") for b in page.select(_rules(self.config, kind), section)]
        free = [p for p in page.select(_rules(self.config, "paragraphs"), section) if not any(b["pre"] < p["pre"] <= b["last"] for b in boxes)]
        starts = {s["pre"]: s for s in page.select(_rules(self.config, "sub-sections"), section)}
        wanted = {p["pre"] for p in free}
        sub, end = "", -1
        for n in page.below(section):
            if n["pre"] <= end:
                continue
            if n["pre"] in wanted:
                before = self.sibling_before(page, n)
                if before is not None and before["tag"] in ("h3", "h4", "h5"):
                    sub = page.text(before)
                yield sub, page.text(n)
                end = n["last"]
            elif n["pre"] in starts:
                heads = page.select(_data(self.config, "sub-sections", "headers"), n)
                sub = page.text(heads[0]) if heads else ""

    @staticmethod
    def sibling_before(page: Page, n: dict) -> dict | None:
        """The element right before n under the same parent, with nothing but blanks between."""
        i = n["pre"] - 1
        while i >= 0 and page.nodes[i]["parent"] != n["parent"]:
            if i == n["parent"]:
                return None
            i = page.nodes[i]["parent"]
        if i < 0 or page.flat[page.nodes[i]["t1"] : n["t0"]].strip():
            return None
        return page.nodes[i]

    def tables(self, page: Page) -> list[dict]:
        """Tables with title, caption, footer and a grid of cells. Groups of tables are left out, rows of
        class thead-hr too; a table without tbody has no grid."""
        out = []
        header = _data(self.config, "tables", "header-element") or [{"tag": "th"}]
        for t in page.select(_rules(self.config, "tables")):
            if "table-group" in t["attrs"].get("class", "").split():
                continue
            row = {n: [table_text(page.marked_text(x)) for x in page.select(_data(self.config, "tables", n), t)] for n in ("title", "caption", "footer")}
            trs = [tr for tr in page.find("tr", t) if not any("thead-hr" in td["attrs"].get("class", "").split() for td in page.find("td", tr))]
            heads = [bool(page.select(header, tr)) or "thead" in tr["attrs"].get("class", "").split() for tr in trs]
            if not any(heads):
                heads = [i == 0 for i in range(len(trs))]
            cells = [[{"text": page.marked_text(c), "colspan": span(c, "colspan"), "rowspan": span(c, "rowspan")} for c in page.find(("td", "th"), tr)] for tr in trs]
            has_body = bool(page.find("tbody", t))
            out.append(row | {"has_body": has_body, "grid": grid_of(cells) if has_body else [], "headers": heads if has_body else []})
        return out


def grid_of(table) -> list[list[str]]:
    """Rows of (text, colspan, rowspan) as a full grid. The first row says how many columns there are; a cell that spans
    several fills them all, what lies beyond the grid is dropped."""
    if table is None or len(table) == 0:
        return []
    width = sum(max(1, c["colspan"] or 1) for c in table[0])
    out: list[list[str | None]] = [[None] * width for _ in table]
    for r, row in enumerate(table):
        at = 0
        for cell in row:
            while at < width and out[r][at] is not None:
                at += 1
            wide, high = max(1, cell["colspan"] or 1), max(1, cell["rowspan"] or 1)
            for i in range(r, min(r + high, len(out))):
                for j in range(at, min(at + wide, width)):
                    out[i][j] = cell["text"]
            at += wide
    return [["" if x is None else x for x in row] for row in out]


def span(cell: dict, name: str) -> int:
    value = cell["attrs"].get(name, "1").strip()
    return max(1, min(int(value), 1000)) if value.isdigit() else 1


def reference_text(s: str) -> str:
    """Without its jump link and line ends, runs of white space to one blank."""
    for gone in ("Go to:", "\n"):
        s = "".join(s.split(gone))
    return re.sub(r"\s\s+", " ", s)


def table_text(s: str) -> str:
    return re.sub(r"<(?:/?span|hr/)[^>\n]*>?", "", s.strip().replace(" ", " ")).replace("\n", "")


def author_pairs(page: Page) -> list[dict]:
    """(short, long) after the first h2 that speaks of abbreviations and before the next one: of a table (by row, pair by
    pair), a definition list, or a paragraph of more than two parts between semicolons, each cut at the first of colon,
    comma and blank that it has exactly once."""
    heads = page.find("h2")
    about = next((h for h in heads if re.search("abbreviation", page.text(h), re.I)), None)
    if about is None:
        return []
    end = next((h["pre"] for h in heads if h["pre"] > about["last"]), len(page.nodes))
    found: list[tuple[str, str]] = []
    for n in page.nodes[about["last"] + 1 : end]:
        if n["tag"] == "table":
            for tr in page.find("tr", n):
                cells = [page.text(c) for c in page.find(("td", "th"), tr)]
                found += list(zip(cells[::2], cells[1::2], strict=False))
        elif n["tag"] == "dl":
            found = list(zip(map(page.text, page.find("dt", n)), map(page.text, page.find("dd", n)), strict=False))
        elif n["tag"] == "p" and page.text(n).count(";") > 1:
            for part in page.text(n).split(";"):
                sep = next((s for s in ":, " if part.count(s) == 1), None)
                if sep:
                    found.append(tuple(part.split(sep)))
        else:
            continue
        break
    return [{"short": a, "long": b} for a, b in dict(found).items()]


READ = f"title string, paragraphs array<{PARAGRAPH}>, pairs array<{PAIR}>, raw_tables array<{TABLE}>"


def read_pages(pages: DataFrame, config: dict, content: str = "content", ontology=None) -> DataFrame:
    """pages without content, with title, paragraphs, pairs (of abbreviations), raw_tables and parse_error: one pass, no shuffle. A
    page that can't be read gets an error and empty results, a null one empty results."""

    def start():
        reader = Reader(config, ontology)

        def one(x: str) -> tuple:
            page = Page(*parse_document(x))
            titles = page.select(_rules(config, "title"))
            parts = reader.paragraphs(page)
            pairs = document_pairs([p["body"] for p in parts], author_pairs(page))
            return page.text(titles[0]) if titles else "", parts, pairs, reader.tables(page)

        return one

    return per_document(pages, content, READ, start, ("", [], [], []))
