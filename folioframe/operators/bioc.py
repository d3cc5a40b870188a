"""BioC collections: passages with offsets, supplementary text and tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE = ("document title", "IAO:0000305")
SUPPLEMENT = ("supplementary material section", "IAO:0000326")
CAPTION, CONTENT = ("caption", "IAO:0000304"), ("table", "IAO:0000306")
ANNOTATION = "struct<id:string,text:string,offset:int,length:int,infons:map<string,string>,locations:array<struct<offset:int,length:int>>>"
RELATION = "struct<id:string,infons:map<string,string>,nodes:array<struct<refid:string,role:string>>>"
SENTENCE = f"struct<text:string,offset:int,infons:map<string,string>,annotations:array<{ANNOTATION}>,relations:array<{RELATION}>>"
PASSAGE = f"struct<offset:int,infons:map<string,string>,text:string,sentences:array<{SENTENCE}>,annotations:array<{ANNOTATION}>,relations:array<{RELATION}>>"
DOCUMENT = f"struct<id:string,inputfile:string,infons:map<string,string>,passages:array<{PASSAGE}>,annotations:array<{ANNOTATION}>,relations:array<{RELATION}>>"
COLLECTION = f"struct<source:string,date:string,key:string,infons:map<string,string>,documents:array<{DOCUMENT}>>"
FULL_TEXT, TABLES, ABBREVIATIONS, SUPPLEMENTARY = ("folioframe (full-text)", "fulltext.key"), ("folioframe (tables)", "tables.key"), ("folioframe (abbreviations)", "abbreviations.key"), ("folioframe (supplementary)", "supplementary.key")


def today() -> Column:
    return F.date_format(F.current_date(), "yyyyMMdd")


def infons(*pairs: tuple[Column, Column]) -> Column:
    """A map of the pairs whose value isn't null."""
    entries = F.array(*[F.struct(k.alias("key"), v.cast("string").alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def passage(offset: Column, info: Column, text: Column) -> Column:
    empty = F.array()
    return F.struct(offset.cast("int").alias("offset"), info.alias("infons"), text.alias("text"), empty.alias("sentences"), empty.alias("annotations"), empty.alias("relations")).cast(PASSAGE)


def type_infons(types: Column) -> Column:
    """iao_name_1, iao_id_1, iao_name_2 ... of an array of types."""
    both = F.flatten(F.transform(types, lambda t, i: F.array(F.struct(F.concat(F.lit("iao_name_"), i + 1).alias("key"), t["iao_name"].alias("value")), F.struct(F.concat(F.lit("iao_id_"), i + 1).alias("key"), t["iao_id"].alias("value")))))
    return F.map_from_entries(both)


def paragraph_infons(p: Column) -> Column:
    """Titles of section and sub-section where not empty, the fields of a reference, and the types."""
    lit = F.lit
    fields = infons((lit("title"), p["title"]), (lit("journal"), p["journal"]), (lit("volume"), p["volume"]), (lit("section_title_1"), F.nullif(p["section_heading"], lit(""))), (lit("section_title_2"), F.nullif(p["subsection_heading"], lit(""))))
    return F.map_concat(fields, type_infons(p["section_type"]))


def title_passage(title: Column) -> Column:
    return passage(F.lit(0), infons((F.lit("section_title_1"), F.lit("document title")), (F.lit("iao_name_1"), F.lit(TITLE[0])), (F.lit("iao_id_1"), F.lit(TITLE[1]))), title)


def passages(title: str = "title", paragraphs: str = "paragraphs") -> Column:
    """The title at 0, then every paragraph: its offset counts the title, all bodies before it and each heading, of
    section or sub-section, once when it is first seen; title and headings share what has been seen."""
    start = F.struct(F.length(title).cast("int").alias("at"), F.array(F.col(title)).alias("seen"), F.array().cast("array<int>").alias("offsets"))

    def add(s: Column, p: Column) -> Column:
        sub, sec = p["subsection_heading"], p["section_heading"]
        seen_sub = F.array_contains(s["seen"], sub)
        with_sub = F.when(seen_sub, s["seen"]).otherwise(F.array_append(s["seen"], sub))
        seen_sec = F.array_contains(with_sub, sec)
        more = F.length(p["body"]) + F.when(seen_sub, 0).otherwise(F.length(sub)) + F.when(seen_sec, 0).otherwise(F.length(sec))
        return F.struct((s["at"] + more).cast("int").alias("at"), F.when(seen_sec, with_sub).otherwise(F.array_append(with_sub, sec)).alias("seen"), F.array_append(s["offsets"], s["at"]).alias("offsets"))

    offsets = F.aggregate(paragraphs, start, add)["offsets"]
    body = F.zip_with(paragraphs, offsets, lambda p, o: passage(o, paragraph_infons(p), p["body"]))
    return F.concat(F.array(title_passage(F.col(title))), body)


def collection(source: tuple[str, str], documents: Column, date: Column | None = None, info: Column | None = None) -> Column:
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    return F.struct(F.lit(source[0]).alias("source"), (date if date is not None else today()).alias("date"), F.lit(source[1]).alias("key"), (info if info is not None else empty).alias("infons"), documents.alias("documents"))


def document(doc_id: Column, inputfile: Column, parts: Column, info: Column | None = None) -> Column:
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    return F.struct(doc_id.alias("id"), inputfile.alias("inputfile"), (info if info is not None else empty).alias("infons"), parts.alias("passages"), F.array().cast(f"array<{ANNOTATION}>").alias("annotations"), F.array().cast(f"array<{RELATION}>").alias("relations"))


def fulltext_collection(doc_id: Column, path: Column, date: Column | None = None) -> Column:
    return collection(FULL_TEXT, F.array(document(doc_id, path, passages())), date)


# supplementary files


def running(parts: Column) -> Column:
    """(offset, text) of texts in order; an offset is the length of all before."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("offsets"))
    offsets = F.aggregate(parts, start, lambda s, p: F.struct((s["at"] + F.length(p)).cast("int").alias("at"), F.array_append(s["offsets"], s["at"]).alias("offsets")))["offsets"]
    return F.zip_with(offsets, parts, lambda o, p: F.struct(o.alias("offset"), p.alias("text")))


def text_passages(text: Column, sep: str = "\n\n") -> Column:
    """Plain text by blank lines, empty parts dropped."""
    parts = F.filter(F.split(text, sep), lambda p: p != "")
    info = infons((F.lit("section_title_1"), F.lit(SUPPLEMENT[0])), (F.lit("iao_name_1"), F.lit(SUPPLEMENT[0])), (F.lit("iao_id_1"), F.lit(SUPPLEMENT[1])))
    return F.transform(running(parts), lambda p: passage(p["offset"], info, p["text"]))


def is_word_title(text: Column, is_header: Column) -> Column:
    return ((text == F.upper(text)) & (text != F.lower(text))) | is_header


def word_passages(paragraphs: Column) -> Column:
    """(text, is_header) of a word file: capitals and headers are titles."""
    clean = F.transform(paragraphs, lambda p: F.replace(p["text"], F.lit("\n"), F.lit("")))

    def one(o: Column, p: Column) -> Column:
        is_title = is_word_title(o["text"], p["is_header"])
        name, iao = F.when(is_title, TITLE[0]).otherwise(SUPPLEMENT[0]), F.when(is_title, TITLE[1]).otherwise(SUPPLEMENT[1])
        return passage(o["offset"], infons((F.lit("section_title_1"), name), (F.lit("iao_name_1"), name), (F.lit("iao_id_1"), iao)), o["text"])

    return F.filter(F.zip_with(running(clean), paragraphs, one), lambda p: p["text"] != "")


CELL = "struct<cell_id:string,cell_text:string>"


def grid_document(grid: Column, index: Column, path: Column) -> Column:
    """A table of strings, its first row the headings: cell ids count tables from 0, rows from 1, headings from 0."""
    head, rows = F.get(grid, F.lit(0)), F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0)))
    cell = lambda r, c, x: F.struct(F.concat_ws(".", index, r, c).alias("cell_id"), x.alias("cell_text"))
    headings = F.transform(head, lambda x, c: cell(F.lit(1), c, x))
    data = F.transform(rows, lambda row, r: F.transform(row, lambda x, c: cell(r + 2, c + 1, x)))
    content = F.struct(
        F.lit(0).alias("offset"),
        infons((F.lit("section_title_1"), F.lit("table_content")), (F.lit("iao_name_1"), F.lit(CONTENT[0])), (F.lit("iao_id_1"), F.lit(CONTENT[1]))).alias("infons"),
        headings.alias("column_headings"),
        F.array(F.struct(F.lit("table_data").alias("table_section_title_1"), data.alias("data_rows"))).alias("data_section"),
    )
    return F.struct(path.alias("inputfile"), (index + 1).cast("string").alias("id"), F.array(content).alias("passages"))


def grids_collection(grids: Column, path: Column, date: Column | None = None) -> Column:
    return collection(SUPPLEMENTARY, F.transform(grids, lambda g, i: grid_document(g, i, path)), date)


def supplementary_text_collection(kind: str, content: Column, path: Column, date: Column | None = None) -> Column:
    """kind word: an array of (text, is_header); else text."""
    parts = word_passages(content) if kind == "word" else text_passages(content)
    return collection(SUPPLEMENTARY, F.array(document(F.lit("1"), path, parts)), date)
