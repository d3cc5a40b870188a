"""BioC as JSON and XML: codecs of the collection struct, writers of files."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.operators.bioc import COLLECTION

PRETTY = {"pretty": "true"}


def to_json(c: Column, pretty: bool = False) -> Column:
    return F.to_json(c, PRETTY) if pretty else F.to_json(c)


def from_json(c: Column) -> Column:
    return F.from_json(c, COLLECTION)


# XML: order and attributes follow the BioC DTD


def _infons(parent: ET.Element, infons) -> None:
    for k, v in dict(infons or {}).items():
        if v is not None:
            ET.SubElement(parent, "infon", key=k).text = v


def _text(parent: ET.Element, tag: str, value) -> None:
    ET.SubElement(parent, tag).text = "" if value is None else str(value)


def _annotation(parent: ET.Element, a) -> None:
    e = ET.SubElement(parent, "annotation", id=a["id"] or "")
    _infons(e, a["infons"])
    spans = a["locations"] if a["locations"] is not None and len(a["locations"]) else [{"offset": a["offset"], "length": a["length"]}]
    for s in spans:
        if s["offset"] is not None:
            ET.SubElement(e, "location", offset=str(s["offset"]), length=str(s["length"] or 0))
    _text(e, "text", a["text"])


def _relation(parent: ET.Element, r) -> None:
    e = ET.SubElement(parent, "relation", id=r["id"] or "")
    _infons(e, r["infons"])
    for n in _list(r["nodes"]):
        ET.SubElement(e, "node", refid=n["refid"] or "", role=n["role"] or "")


def _list(x) -> list:
    return [] if x is None else list(x)


def write_xml(c) -> str:
    """The XML of a collection (a row or dictionary)."""
    root = ET.Element("collection")
    for tag in ("source", "date", "key"):
        _text(root, tag, c[tag])
    _infons(root, c["infons"])
    for d in _list(c["documents"]):
        doc = ET.SubElement(root, "document")
        _text(doc, "id", d["id"])
        _infons(doc, d["infons"])
        for p in _list(d["passages"]):
            e = ET.SubElement(doc, "passage")
            _infons(e, p["infons"])
            _text(e, "offset", p["offset"])
            if not _list(p["sentences"]):
                _text(e, "text", p["text"])
            for s in _list(p["sentences"]):
                x = ET.SubElement(e, "sentence")
                _infons(x, s["infons"])
                _text(x, "offset", s["offset"])
                _text(x, "text", s["text"])
                for a in _list(s["annotations"]):
                    _annotation(x, a)
                for r in _list(s["relations"]):
                    _relation(x, r)
            for a in _list(p["annotations"]):
                _annotation(e, a)
            for r in _list(p["relations"]):
                _relation(e, r)
        for a in _list(d["annotations"]):
            _annotation(doc, a)
        for r in _list(d["relations"]):
            _relation(doc, r)
    return '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE collection SYSTEM "BioC.dtd">\n' + ET.tostring(root, encoding="unicode")


def read_xml(s: str) -> dict:
    """A collection from its XML; infons without text are dropped."""

    def infons(e: ET.Element) -> dict:
        return {i.get("key"): i.text for i in e.findall("infon") if i.text is not None}

    def get(e: ET.Element, tag: str, default: str = "") -> str:
        found = e.find(tag)
        return found.text or default if found is not None else default

    def annotation(e: ET.Element) -> dict:
        spans = [{"offset": int(x.get("offset")), "length": int(x.get("length"))} for x in e.findall("location")]
        first = spans[0] if spans else {"offset": None, "length": None}
        return {"id": e.get("id", ""), "text": get(e, "text"), **first, "infons": infons(e), "locations": spans}

    def relation(e: ET.Element) -> dict:
        return {"id": e.get("id", ""), "infons": infons(e), "nodes": [{"refid": n.get("refid"), "role": n.get("role")} for n in e.findall("node")]}

    def marks(e: ET.Element) -> dict:
        return {"annotations": [annotation(a) for a in e.findall("annotation")], "relations": [relation(r) for r in e.findall("relation")]}

    def sentence(e: ET.Element) -> dict:
        return {"text": get(e, "text"), "offset": int(get(e, "offset", "0")), "infons": infons(e), **marks(e)}

    def passage(e: ET.Element) -> dict:
        return {"offset": int(get(e, "offset", "0")), "infons": infons(e), "text": get(e, "text"), "sentences": [sentence(x) for x in e.findall("sentence")], **marks(e)}

    root = ET.fromstring(s)
    docs = [{"id": get(d, "id"), "inputfile": "", "infons": infons(d), "passages": [passage(p) for p in d.findall("passage")], **marks(d)} for d in root.findall("document")]
    return {"source": get(root, "source"), "date": get(root, "date"), "key": get(root, "key"), "infons": infons(root), "documents": docs}


def to_xml(c: Column) -> Column:
    """The collection struct as XML, batch by batch."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([write_xml(from_text(x)) if x is not None else None for x in s], dtype=object)

    return run(F.to_json(c))


def from_text(s: str) -> dict:
    def filled(x, names: tuple[str, ...]) -> dict:
        return {n: x.get(n) for n in names}

    c = filled(json.loads(s), ("documents", "infons", "key", "source", "date"))
    sub = ("text", "offset", "infons", "annotations", "relations")
    mark = lambda x: {"annotations": [filled(a, ("id", "text", "offset", "length", "infons", "locations")) for a in x["annotations"] or []], "relations": [filled(r, ("id", "infons", "nodes")) for r in x["relations"] or []]}
    docs = []
    for d in c["documents"] or []:
        d = filled(d, ("id", "inputfile", "infons", "passages", "annotations", "relations"))
        passages = []
        for p in d["passages"] or []:
            p = filled(p, ("offset", "infons", "text", "sentences", "annotations", "relations"))
            sentences = [filled(x, sub) for x in p["sentences"] or []]
            passages.append(p | mark(p) | {"sentences": [x | mark(x) for x in sentences]})
        docs.append(d | mark(d) | {"passages": passages})
    return c | {"documents": docs}


def from_xml(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else json.dumps(read_xml(x))
            except (ET.ParseError, ValueError):
                return None

        return s.map(one)

    return F.from_json(run(c), COLLECTION)


# tables: a cell is a number where it holds one


def tables_json(c: Column, pretty: bool = False) -> Column:
    """The tables collection as JSON; cell_num, where not null, takes the place of the text."""
    s = F.to_json(c, PRETTY if pretty else {})
    number = r'"cell_text"\s*:\s*"(?:[^"\\]|\\.)*"\s*,\s*"cell_num"\s*:\s*([-+0-9.Ee]+)'
    return F.regexp_replace(s, number, '"cell_text":$1')


# files


def write_files(articles: DataFrame, out_dir: str, key: str = "key", xml: bool = False) -> DataFrame:
    """The collections of articles (bioc, abbreviations, tables) as files, see write_texts."""
    bioc = to_xml(F.col("bioc")) if xml else to_json(F.col("bioc"), pretty=True)
    has_tables = F.size(F.coalesce(F.col("tables.documents"), F.array())) > 0
    cols = [bioc.alias("bioc"), F.to_json("abbreviations", PRETTY).alias("abbreviations"), F.when(has_tables, tables_json(F.col("tables"), pretty=True)).alias("tables")]
    return write_texts(articles.select(F.col(key).alias("key"), *cols), out_dir, xml)


def write_texts(texts: DataFrame, out_dir: str, xml: bool = False) -> DataFrame:
    """Write (key, bioc, abbreviations, tables), null ones left out, as <key>_bioc.json (or .xml), _abbreviations.json and
    _tables.json below out_dir, a folder that all workers share; (key, ok, error) of each. Where one file an article
    isn't needed, df.write.json scales better."""
    suffix = {"bioc": "xml" if xml else "json", "abbreviations": "json", "tables": "json"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for r in pdf.itertuples(index=False):
                try:
                    base = Path(out_dir) / r.key.lstrip("/")
                    base.parent.mkdir(parents=True, exist_ok=True)
                    for name, end in suffix.items():
                        if isinstance(text := getattr(r, name), str):
                            Path(f"{base}_{name}.{end}").write_text(text, encoding="utf-8")
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pd.DataFrame({"key": pdf["key"], "ok": [e is None for e in errors], "error": pd.Series(errors, dtype=object)})

    return texts.mapInPandas(run, "key string, ok boolean, error string")


def tally(status: DataFrame) -> DataFrame:
    """(ok, n) of (key, ok, error)."""
    return status.groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


def differences(old: DataFrame, new: DataFrame, ignore: tuple[str, ...] = ("date", "inputfile", "offset")) -> DataFrame:
    """Rows (side, ...) of one output without an equal in the other, repeats counted, volatile columns left out."""
    keep = [c for c in old.columns if c not in ignore]
    a, b = old.select(*keep), new.select(*keep)
    return a.exceptAll(b).withColumn("side", F.lit("old")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))
