"""JATS XML articles: metadata, titled text of front, body and back, references.

One Arrow pass parses a document once and yields rows of (titles, subtitle, text), already in order, cleaned and freed
of repeats; offsets, infons and the collection are expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.batches import per_document
from folioframe.operators.bioc import TITLE, collection, document, infons, passage, type_infons
from folioframe.operators.headings import Types
from folioframe.plans.rules import Page
from folioframe.sources.dom import parse_document

SOURCE = ("folioframe (XML)", "jats.key")
#: Elements whose text is not text of the article.
DROPPED = frozenset({"fig", "table", "table-wrap", "disp-formula", "inline-formula", "tex-math", "mml:math", "supplementary-material", "inline-supplementary-material", "media", "graphic"})
#: Parts of the back matter and what their text is called without a title of its own.
BACK = (("ack", "Acknowledgments"), ("funding-statement", "Funding Statement"), ("fn-group", "Footnotes"), ("app-group", "document part"), ("notes", None))
PART = "document part"
HOST = "www.ncbi.nlm.nih.gov"
TAG = re.compile("<[^<>]+>")
LEAST = 6
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
READ = "meta map<string,string>, rows array<struct<titles:array<string>,subtitle:string,types:array<struct<iao_name:string,iao_id:string>>,text:string>>, refs array<struct<text:string,journal:string,year:string,volume:string,doi:string,pmid:string>>"


def unescape(s: str) -> str:
    r"""\uXXXX to the character; escapes that aren't four hexadecimal digits stay."""
    return re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), s).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def collapse(s: str) -> str:
    """Runs of blanks to one, then line ends to blanks (in this order)."""
    return re.sub(" {2,}", " ", s).replace("\n", " ")


def decode_entities(s: str) -> str:
    """The five entities of XML, the ampersand last, and no-break spaces to blanks."""
    for name, sign in ENTITIES:
        s = s.replace(name, sign)
    return s.replace(" ", " ")


def repair(s: str) -> str:
    """UTF-8 that was once read as Latin-1, read again; anything else stays as it is."""
    try:
        return s.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return s


def strip_tags(s: str) -> str:
    return TAG.sub("", s)


def clean_text(s: str) -> str:
    """The four steps in this order; one blank at both ends goes."""
    s = repair(decode_entities(collapse(unescape(s))))
    return s[1:-1] if len(s) > 1 and s[0] == s[-1] == " " else s


def clean_heading(s: str) -> str:
    """Without tags, quotes, brackets and a number with a full stop in front."""
    s = re.sub(r"""['"\[\]]""", "", strip_tags(s))
    head, _, rest = s.strip().partition(" ")
    return rest.strip() if rest.strip() and head.endswith(".") and re.sub("[.,]", "", head[:-1]).isdigit() else s


def tidy_reference(s: str) -> str:
    for a, b in ((" ,", ","), (" .", "."), ("..", ".")):
        s = s.replace(a, b)
    return s.strip()


class Jats:
    """One document."""

    def __init__(self, page: Page):
        self.page = page

    def text(self, n: dict | None) -> str:
        return "" if n is None else self.page.text(n)

    def own_title(self, n: dict) -> str | None:
        return next((self.page.text(c) for c in self.page.below(n) if c["parent"] == n["pre"] and c["tag"] == "title"), None)

    def metadata(self) -> dict[str, str]:
        """License, ids, link, journal, kind and year of acceptance, empty where absent; the PMC id with its letters."""
        p = self.page
        get = lambda tag, within=None, **a: self.text(p.first(tag, within, **a)).strip()
        pmc = get("article-id", pub_id_type="pmc") or get("article-id", pub_id_type="pmcid")
        pmc = pmc if not pmc or pmc.startswith("PMC") else f"PMC{pmc}"
        accepted, kinds = p.first("date", date_type="accepted"), p.first("article-categories")
        return {
            "license": collapse(get("license")),
            "pmid": get("article-id", pub_id_type="pmid"),
            "pmcid": pmc,
            "link": f"https://{HOST}/pmc/articles/{pmc}/" if pmc else "",
            "doi": get("article-id", pub_id_type="doi"),
            "journal": get("journal-title") or get("journal-id"),
            "pub_type": get("subject", kinds) if kinds else "",
            "year": get("year", accepted) if accepted else "",
        }

    def rows(self) -> Iterator[tuple[list[str], str, str]]:
        """(titles of parents, own title, text): title, keywords, abstracts, body outside sections, sections, back."""
        p = self.page
        if title := p.first("article-title", p.first("front")):
            yield ["document title"], "document title", self.text(title)
        for g in p.find("kwd-group"):
            name = self.own_title(g)
            if g["attrs"].get("xml:lang", "en") == "en" and "abbr" not in (name or "").lower():
                yield ["keywords"], name or "keywords", "; ".join(self.text(k).strip() for k in p.find("kwd", g))
        for a in p.find("abstract"):
            yield from self.titled(a, "Abstract", ["Abstract"])
        if body := p.first("body"):
            yield from self.outside(body)
            yield from self.sections(body)
        for tag, default in BACK:
            for b in p.find(tag):
                yield from self.titled(b, default)

    def titled(self, n: dict, default: str | None, parents: list[str] | None = None) -> Iterator[tuple[list[str], str, str]]:
        """Under titles a text for each paragraph, labelled by the last of them; else the whole, if it has a name."""
        titles = self.page.find("title", n)
        if not titles:
            if default:
                yield parents or [default], default, self.text(n)
            return
        for q in self.page.find("p", n):
            name = next((self.text(t) for t in reversed(titles) if t["pre"] < q["pre"]), default or PART)
            yield parents or [name], name, self.text(q)

    def outside(self, body: dict) -> Iterator[tuple[list[str], str, str]]:
        """Paragraphs in neither a section nor a box, in runs of neighbours: one alone is a part, several are an
        introduction. Very short ones are dropped."""
        p = self.page
        boxes = p.find(("sec", "boxed-text", "caption"), body)
        free = [q for q in p.find("p", body) if not any(b["pre"] < q["pre"] <= b["last"] for b in boxes)]
        runs: list[list[dict]] = []
        for q in free:
            if runs and runs[-1][-1]["last"] + 1 == q["pre"] and runs[-1][-1]["parent"] == q["parent"]:
                runs[-1].append(q)
            else:
                runs.append([q])
        for run in runs:
            name = "introduction" if len(run) > 1 else PART
            for q in run:
                if len(self.text(q).strip()) >= LEAST:
                    yield [name], name, self.text(q)

    def sections(self, body: dict) -> Iterator[tuple[list[str], str, str]]:
        """Paragraphs of sections, not within another: titles of all sections around, outermost first, without the
        nearest where there are more; and the nearest."""
        p, end = self.page, -1
        sections = p.find("sec", body)
        names = {s["pre"]: self.own_title(s) for s in sections}
        for q in p.find("p", body):
            around = [s for s in sections if s["pre"] < q["pre"] <= s["last"]]
            if not around or q["pre"] <= end:
                continue
            end = q["last"]
            titles = [t for s in around if (t := names[s["pre"]]) is not None]
            yield (titles[:-1] if len(titles) > 1 else titles) or [PART], titles[-1] if titles else PART, self.text(q)

    def references(self) -> Iterator[dict]:
        """Journal citations by their fields, others as their text."""
        p = self.page
        for r in p.find("ref"):
            get = lambda tag, **a: self.text(p.first(tag, r, **a)).strip()  # noqa: B023, E731
            fields = dict.fromkeys(("journal", "year", "volume", "doi", "pmid"), "")
            if p.first("element-citation", r, publication_type="journal") is None:
                yield {"text": tidy_reference(collapse(self.text(r))), **fields}
                continue
            group = p.first("person-group", r, person_group_type="author")
            names = [f"{self.text(p.first('given-names', n))} {self.text(p.first('surname', n))}".strip() for n in p.find("name", group)] if group else []
            authors = ", ".join(names) + (" Et al." if p.first("etal", r) else "")
            fields = {"journal": get("source"), "year": get("year"), "volume": get("volume"), "doi": get("pub-id", pub_id_type="doi"), "pmid": get("pub-id", pub_id_type="pmid")}
            line = get("label") + "".join(sep + x for sep, x in ((" ", authors.strip()), (", ", get("article-title")), (", ", fields["journal"]), (", ", fields["year"])) if x)
            if fields["volume"]:
                line += (";" if fields["year"] else ", ") + fields["volume"]
            yield {"text": tidy_reference(collapse(line)), **fields}


def distinct_by_id(types: list[dict]) -> list[dict]:
    """One type an id: the place of the first, the name of the last."""
    return list({t["iao_id"]: t for t in types}.values())


def read_articles(docs: DataFrame, content: str = "content", ontology=None) -> DataFrame:
    """docs without content, with meta, rows, refs and parse_error; a null or unreadable document has none."""

    def one(x: str, types: Types) -> tuple:
        jats = Jats(Page(*parse_document(x, xml=True, drop_tags=DROPPED)))
        rows, seen, last = [], set(), ([PART], PART)
        for titles, sub, text in jats.rows():
            titles, sub, text = [clean_heading(t) for t in titles], clean_heading(sub), clean_text(text)
            # an empty heading takes that of the row before
            titles, sub = (titles if any(titles) else last[0]), sub or last[1]
            last = (titles, sub)
            if text not in ("", " ") and text not in seen:
                seen.add(text)
                kinds = [{"iao_name": TITLE[0], "iao_id": TITLE[1]}] if titles[0] == TITLE[0] else distinct_by_id(types.of(titles[0]))
                rows.append({"titles": titles, "subtitle": sub, "types": kinds, "text": text})
        return jats.metadata(), rows, list(jats.references())

    def start():
        types = Types(ontology)
        return lambda x: one(x, types)

    return per_document(docs, content, READ, start, ({}, [], []))


def offsets(texts: Column) -> Column:
    """Each begins one after the end of the one before it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(texts, start, lambda s, t: F.struct((s["at"] + F.length(t) + 1).cast("int").alias("at"), F.array_append(s["out"], s["at"]).alias("out")))["out"]


def article(docs: DataFrame, content: str = "content", ontology=None, date: Column | None = None) -> DataFrame:
    """docs without content, with bioc (a collection) and parse_error."""
    df = read_articles(docs, content, ontology)
    text = lambda name: F.transform(name, lambda r: r["text"])
    df = df.withColumn("_at", offsets(F.concat(text("rows"), text("refs"))))

    def titles(r: Column) -> Column:
        path = F.when(F.element_at(r["titles"], -1) == r["subtitle"], r["titles"]).otherwise(F.array_append(r["titles"], r["subtitle"]))
        return F.map_from_entries(F.transform(path, lambda t, i: F.struct(F.concat(F.lit("section_title_"), i + 1).alias("key"), t.alias("value"))))

    def reference(r: Column, at: Column) -> Column:
        named = [(F.lit(f), F.nullif(r[f], F.lit(""))) for f in ("journal", "year", "volume", "doi", "pmid")]
        return passage(at, infons((F.lit("section_title_1"), F.lit("References")), (F.lit("iao_name_1"), F.lit("references section")), (F.lit("iao_id_1"), F.lit("IAO:0000320")), *named), r["text"])

    n = F.size("rows")
    body = F.zip_with("rows", F.slice("_at", 1, n), lambda r, at: passage(at, F.map_concat(titles(r), type_infons(r["types"])), r["text"]))
    refs = F.zip_with("refs", F.slice("_at", n + 1, F.size("refs")), reference)
    path = F.col("path") if "path" in docs.columns else F.lit("")
    doc = document(F.coalesce(F.try_element_at("meta", F.lit("pmcid")), F.lit("")), path, F.concat(body, refs))
    return df.withColumn("bioc", collection(SOURCE, F.array(doc), date, F.col("meta"))).drop("rows", "refs", "meta", "_at")
