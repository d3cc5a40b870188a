"""Files to structured articles: one call for any mix of formats, results as a DataFrame or as Python objects."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions.text import base_key, clean_unicode, file_type
from folioframe.operators import abbreviations as A
from folioframe.operators import article, bioc, jats, pipetables, tables
from folioframe.plans.configs import default_config
from folioframe.plans.rules import read_config
from folioframe.session import build_session
from folioframe.sources import bioc_io, files, office

__all__ = ["Article", "default_config", "process_directory", "process_file", "process_files", "process_pages", "process_rendered_text", "read_config"]


def _pretty(x: dict) -> str:
    return json.dumps(x, ensure_ascii=False, indent=2)


@dataclass
class Article:
    """What a file holds: BioC full text, abbreviations and tables, as dictionaries."""

    file_path: str
    bioc: dict
    abbreviations: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    error: str | None = None

    def to_dict(self) -> dict:
        return dict(file_path=self.file_path, tables=self.tables, abbreviations=self.abbreviations, main_text=self.bioc)

    def to_json(self) -> str:
        return _pretty(self.to_dict())

    def to_bioc(self) -> dict:
        return self.bioc

    def main_text_to_bioc_xml(self) -> str:
        return bioc_io.write_xml(bioc_io.from_text(json.dumps(self.bioc)))

    def main_text_to_bioc_json(self) -> str:
        return _pretty(self.bioc)

    def abbreviations_to_bioc_json(self) -> str:
        return _pretty(self.abbreviations)

    def tables_to_bioc_json(self) -> str:
        return _pretty(self.tables)

    @property
    def has_tables(self) -> bool:
        return len(self.tables.get("documents", ())) > 0


def process_pages(pages: DataFrame, config: dict, path: str = "path", content: str = "content", ontology=None, date=None) -> DataFrame:
    """HTML pages to title, paragraphs, bioc, abbreviations and tables, without a shuffle."""
    if not config:
        raise RuntimeError("a config is needed for HTML")
    df = article.read_pages(pages, config, content, ontology)
    df = df.withColumn("abbreviations", A.abbreviations_collection(F.col("pairs"), F.col(path), date))
    df = tables.table_documents(df, path)
    df = df.withColumn("bioc", bioc.fulltext_collection(F.split_part(F.regexp_extract(F.col(path), r"([^/]*)$", 1), F.lit("."), F.lit(1)), F.col(path), date))
    return df.drop("pairs")


def process_rendered_text(docs: DataFrame, path: str = "path", text: str = "text", date=None) -> DataFrame:
    """Text that a page file was rendered to (PDF): bioc and tables from its tables of bars."""
    df = docs.withColumn("_x", pipetables.split_text(clean_unicode(F.col(text))))
    df = df.withColumn("bioc", bioc.supplementary_text_collection("pdf", F.col("_x.text"), F.col(path), date))
    return df.withColumn("tables", bioc.grids_collection(F.col("_x.grids"), F.col(path), date)).drop("_x")


def _out(df: DataFrame, error: str | None = None) -> DataFrame:
    """(path, key, bioc, abbreviations, tables, error) with the collections as JSON, the same for every format."""
    has = set(df.columns)
    js = lambda n: (bioc_io.tables_json(F.col(n)) if n == "tables" else F.to_json(n)).alias(n) if n in has else F.lit(None).cast("string").alias(n)
    failed = F.col("parse_error") if "parse_error" in has else F.lit(error).cast("string")
    return df.select("path", "key", js("bioc"), js("abbreviations"), js("tables"), failed.alias("error"))


def process(found: DataFrame | Callable[[str | None], DataFrame], config: dict | None = None) -> DataFrame:
    """Files (path, content) of any format to (path, key, bioc, abbreviations, tables, error), collections as JSON.
    Tables in files linked to an article join those of the article. A file that can't be read gets an error.
    found is rows, or a scan that takes a glob pattern: then each format reads its own files alone, the marked-up ones
    twice, as HTML and as XML, and those of no format are listed only."""
    marked = files.typed(files.with_suffixes(found, ".html", ".htm", ".xml"))
    plain = lambda *s: files.with_suffixes(found, *s).select("path", "content", base_key(F.col("path")).alias("key"))
    by_path = lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0)
    of = lambda kind: marked.where(F.col("file_type") == kind)
    parts = []
    if config:
        pages = of("HTML").select("path", "key", "kind", F.col("text").alias("content"))
        done = process_pages(pages, config)
        if "tables" in config:
            linked = done.where("kind = 'linked_tables'").groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("path", "tables")), by_path), lambda x: x["tables"])).alias("_linked"), F.flatten(F.collect_list("empty_tables")).alias("_empty"))
            done = done.where("kind = 'main_text'").join(linked, "key", "left")
            joined = F.when(F.col("_linked").isNull(), F.col("tables")).otherwise(tables.renumbered(F.col("tables"), F.col("_linked")))
            empty = F.concat("empty_tables", F.coalesce("_empty", F.slice("empty_tables", 1, 0)))
            done = done.withColumn("tables", tables.tables_collection(tables.filled(joined, empty)))
        parts.append(_out(done))
    else:
        parts.append(_out(of("HTML"), "a config is needed for HTML"))
    parts.append(_out(jats.article(of("XML").select("path", "key", F.col("text").alias("content")))))
    word = office.read_word(plain(".docx", ".doc"))
    parts.append(_out(word.withColumn("bioc", bioc.supplementary_text_collection("word", F.coalesce("paragraphs", F.array().cast(office.PARAGRAPHS)), F.col("path"))).withColumn("tables", bioc.grids_collection(F.coalesce("grids", F.array().cast(office.GRIDS)), F.col("path")))))
    excel = office.read_excel(plain(".xlsx", ".xls"))
    parts.append(_out(excel.withColumn("tables", bioc.grids_collection(F.coalesce("grids", F.array().cast(office.GRIDS)), F.col("path")))))
    parts.append(_out(plain(".pdf"), "render the file to text first, see process_rendered_text"))
    names = (found(None) if callable(found) else found).select("path", base_key(F.col("path")).alias("key"))
    parts.append(_out(names.where(file_type(F.col("path"), F.lit(False)) == "UNKNOWN"), "unknown kind of file"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _objects(df: DataFrame) -> list[Article]:
    load = lambda x: json.loads(x) if x else {}
    return [Article(r["path"], load(r["bioc"]), load(r["abbreviations"]), load(r["tables"]), r["error"]) for r in df.orderBy("path").toLocalIterator()]


def process_file(config: dict | None, path: str | Path, linked: list[str | Path] = (), spark: SparkSession | None = None) -> Article:
    """One file; raises FileNotFoundError, NotImplementedError for an unknown kind, RuntimeError for what can't be read."""
    for p in (path, *linked):
        if not Path(p).is_file():
            raise FileNotFoundError(p)
    spark = spark or build_session()
    found = _objects(process(lambda pattern: files.scan(spark, [str(Path(p).resolve()) for p in (path, *linked)], pattern), config))
    one = next(a for a in found if a.file_path.endswith(Path(path).name))
    if one.error:
        raise (NotImplementedError if one.error.startswith("unknown") else RuntimeError)(one.error)
    return one


def process_files(config: dict | None, paths: list[str | Path], spark: SparkSession | None = None) -> DataFrame:
    """Many files in one job; all have to be there."""
    if missing := [str(p) for p in paths if not Path(p).is_file()]:
        raise RuntimeError(f"not files: {missing}")
    return process(lambda pattern: files.scan(spark or build_session(), [str(Path(p).resolve()) for p in paths], pattern), config)


def process_directory(config: dict | None, path: str, spark: SparkSession | None = None) -> DataFrame:
    """All files below a directory."""
    return process(lambda pattern: files.scan(spark or build_session(), path, pattern), config)


def register_views(pages: DataFrame, prefix: str = "") -> None:
    """Temporary views passages, table_cells and abbreviations over processed pages, for SQL."""
    rows = pages.select("path", F.posexplode(F.col("bioc.documents")[0]["passages"]).alias("nth", "p"))
    rows.select("path", "nth", "p.offset", "p.infons", "p.text").createOrReplaceTempView(f"{prefix}passages")
    pairs = pages.select("path", F.explode(F.col("abbreviations.documents")[0]["passages"]).alias("p"))
    pairs.select("path", F.col("p")["text_short"].alias("short"), F.map_filter("p", lambda k, _: k != "text_short").alias("fields")).createOrReplaceTempView(f"{prefix}abbreviations")
    if "tables" in pages.columns:
        docs = pages.select("path", F.explode("tables").alias("t")).select("path", F.col("t.id").alias("table_id"), F.explode("t.passages").alias("p"))
        sections = docs.where("p.data_section IS NOT NULL").select("path", "table_id", F.explode("p.data_section").alias("s"))
        cells = sections.select("path", "table_id", F.col("s.table_section_title_1").alias("section"), F.explode(F.flatten("s.data_rows")).alias("c"))
        cells.select("path", "table_id", "section", "c.*").createOrReplaceTempView(f"{prefix}table_cells")
