"""Every query of the document operators, with its SQL where SQL can express it. All read their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.api import process_pages, process_rendered_text
from folioframe.functions import text as T
from folioframe.functions.batches import each
from folioframe.functions.vectorized import applied, nfkd
from folioframe.operators import abbreviations as A
from folioframe.operators import article, bioc, headings, jats, pipetables, tables
from folioframe.plans.configs import default_config
from folioframe.sources import bioc_io, dom, files, office
from folioframe.sources.ontology import default_ontology

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.col("html").alias("content"))


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents"


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _escape(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _tag(name, content):
    return F.concat(F.lit(f"<{name}>"), content, F.lit(f"</{name.split(' ')[0]}>"))


# pages


@query()
def bioc_flagship(spark, sf_dir):
    """Pages to BioC collections with typed paragraphs, offsets, abbreviations and tables."""
    done = process_pages(pages_of(spark, sf_dir), default_config("WEB_PAGE"), date=F.lit("20240101"))
    return done.select("page_id", "title", F.size("paragraphs").alias("n_paragraphs"), bioc_io.to_json(F.col("bioc")).alias("bioc"), F.to_json("abbreviations").alias("abbreviations"), F.size("tables").alias("n_tables"))


ENTITIES = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"


@query(f"SELECT page_id, {ENTITIES.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS title FROM pages")
def html_title(spark, sf_dir):
    return article.read_pages(pages_of(spark, sf_dir).drop("path"), default_config("WEB_PAGE")).select("page_id", "title")


@query(f"""
WITH a AS (SELECT page_id, list_filter(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a [^>]*>([^<]*)</a>', 1), lambda x: trim(x) <> '') AS l FROM pages)
SELECT page_id, {ENTITIES.format("array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ')")} AS keywords FROM a
""")
def html_keywords(spark, sf_dir):
    done = article.read_pages(pages_of(spark, sf_dir).drop("path"), default_config("WEB_PAGE"))
    words = F.filter("paragraphs", lambda p: p["section_heading"] == "keywords")
    return done.select("page_id", F.coalesce(F.get(words, F.lit(0))["body"], F.lit("")).alias("keywords"))


@query(f"""
WITH a AS (SELECT page_id, list_filter(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a [^>]*>([^<]*)</a>', 1), lambda x: trim(x) <> '') AS l,
  regexp_extract(html, '(?s)<article>.*?<p>(.*?)</article>', 1) AS rest FROM pages),
u AS (SELECT page_id, 0 AS pos, 'keywords' AS section_heading, {ENTITIES.format("array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ')")} AS body FROM a
  UNION ALL SELECT page_id, 1, 'document part', {ENTITIES.format("regexp_replace(rest, '<[^>]*>', '', 'g')")} FROM a)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS nth, section_heading, '' AS subsection_heading, body FROM u WHERE body <> ''
""")
def html_paragraphs(spark, sf_dir):
    """Keywords and paragraphs. The first p of these pages is never closed, so it holds all that follow: an end tag that is
    missing isn't made up."""
    done = article.read_pages(pages_of(spark, sf_dir).drop("path"), default_config("WEB_PAGE"))
    return done.select("page_id", F.posexplode("paragraphs").alias("nth", "p")).select("page_id", F.col("nth").cast("long").alias("nth"), "p.section_heading", "p.subsection_heading", "p.body")


@query()
def html_nodes(spark, sf_dir):
    parsed = dom.parse(pages_of(spark, sf_dir).drop("path"))
    return parsed.select("page_id", "flat", F.explode("nodes").alias("n")).select("page_id", "n.pre", "n.last", "n.parent", "n.depth", "n.tag", F.md5(dom.text_of(F.col("n"))).alias("text"))


@query("SELECT true AS ok, count(*) AS n FROM pages HAVING count(*) > 0")
def status_tally(spark, sf_dir):
    parsed = dom.parse(pages_of(spark, sf_dir).drop("path"))
    return bioc_io.tally(parsed.select(F.col("parse_error").isNull().alias("ok")))


# files

PATHS = "'/data/' || source || '/' || doc_id::VARCHAR || CASE lang WHEN 'en' THEN '.html' WHEN 'de' THEN '_table_' || (n_chars)::VARCHAR || '.html' WHEN 'fr' THEN '.v2.XML' ELSE '.txt' END"


def paths_of(spark, sf_dir) -> DataFrame:
    ending = F.when(F.col("lang") == "en", ".html").when(F.col("lang") == "de", F.concat(F.lit("_table_"), F.col("n_chars"), F.lit(".html"))).when(F.col("lang") == "fr", ".v2.XML").otherwise(".txt")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/data/"), "source", F.lit("/"), "doc_id", ending).alias("path"))


@query(f"""
WITH p AS (SELECT doc_id, {PATHS} AS path FROM documents)
SELECT doc_id, path, CASE WHEN regexp_matches(path, '_table_[0-9]+\\.html$') THEN 'linked_tables' WHEN regexp_matches(lower(path), '\\.(html|xml)$') THEN 'main_text' ELSE '' END AS kind,
  CASE WHEN regexp_matches(lower(path), '\\.(html|xml)$') THEN 'HTML' ELSE 'UNKNOWN' END AS file_type,
  regexp_replace(regexp_replace(path, '_table_[0-9]+\\.html$', ''), '\\.html$', '') AS key,
  split_part(regexp_extract(path, '([^/]*)$', 1), '.', 1) AS document, regexp_extract(path, '_table_([0-9]+)\\.html$', 1) AS linked_id
FROM p
""")
def file_routes(spark, sf_dir):
    p = F.col("path")
    return paths_of(spark, sf_dir).select("doc_id", "path", T.input_kind(p).alias("kind"), T.file_type(p, F.lit(False)).alias("file_type"), T.base_key(p).alias("key"), T.document_id(p).alias("document"), T.linked_table_id(p).alias("linked_id"))


@query(f"""
WITH p AS (SELECT {PATHS.replace("doc_id::VARCHAR", "(doc_id // 4)::VARCHAR")} AS path FROM documents),
k AS (SELECT path, regexp_replace(regexp_replace(path, '_table_[0-9]+\\.html$', ''), '\\.html$', '') AS key,
  CASE WHEN regexp_matches(path, '_table_[0-9]+\\.html$') THEN 1 ELSE 0 END AS linked FROM p WHERE NOT regexp_matches(path, '\\.txt$'))
SELECT key, min(path) FILTER (linked = 0) AS main_text, coalesce(list_sort(list(path) FILTER (linked = 1)), []) AS linked_tables FROM k GROUP BY key
""")
def file_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.floor(F.col("doc_id") / 4))
    ending = F.when(F.col("lang") == "en", ".html").when(F.col("lang") == "de", F.concat(F.lit("_table_"), F.col("n_chars"), F.lit(".html"))).when(F.col("lang") == "fr", ".v2.XML").otherwise(".txt")
    return files.grouped(docs.select(F.concat(F.lit("/data/"), "source", F.lit("/"), "doc_id", ending).alias("path")))


# passages


@query(f"""
WITH l AS (SELECT * FROM ({LINES}) WHERE line <> '')
SELECT doc_id, row_number() OVER w - 1 AS nth, (coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS passage_offset,
  'IAO:0000326' AS iao_id, line AS text FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
""")
def text_passages(spark, sf_dir):
    found = bioc.text_passages(F.col("text"), "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("nth", "p"))
    return rows.select("doc_id", F.col("nth").cast("long").alias("nth"), F.col("p.offset").cast("long").alias("passage_offset"), F.element_at("p.infons", "iao_id_1").alias("iao_id"), "p.text")


@query(f"""
WITH l AS (SELECT *, (coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS passage_offset FROM ({LINES}))
SELECT doc_id, passage_offset, CASE WHEN line = upper(line) AND line <> lower(line) THEN 'document title' ELSE 'supplementary material section' END AS kind, line AS text FROM l WHERE line <> ''
""")
def word_passages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    parts = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), F.lit(False).alias("is_header")))
    rows = docs.select("doc_id", F.explode(bioc.word_passages(parts)).alias("p"))
    return rows.select("doc_id", F.col("p.offset").cast("long").alias("passage_offset"), F.element_at("p.infons", "iao_name_1").alias("kind"), "p.text")


@query("""
WITH c AS (SELECT conv_id, turn, text AS body, role AS sec, split_part(text, ' ', 1) AS sub, 'conversation ' || conv_id::VARCHAR AS title FROM conversations),
h AS (SELECT conv_id, turn, title, sub AS h, 0 AS k FROM c UNION ALL SELECT conv_id, turn, title, sec, 1 FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, h ORDER BY turn, k) AS nth FROM h),
e AS (SELECT conv_id, turn, sum(CASE WHEN nth = 1 AND h <> title THEN length(h) ELSE 0 END) AS extra FROM f GROUP BY ALL)
SELECT c.conv_id, c.turn, (length(title) + coalesce(sum(length(body) + extra) OVER (PARTITION BY c.conv_id ORDER BY c.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS passage_offset
FROM c JOIN e USING (conv_id, turn)
""")
def passage_offsets(spark, sf_dir):
    """Conversations as documents, turns as paragraphs: a heading counts at its first place."""
    turns = table(spark, sf_dir, "conversations")
    p = F.struct("turn", F.col("text").alias("body"), F.col("role").alias("section_heading"), F.split_part("text", F.lit(" "), F.lit(1)).alias("subsection_heading"), F.array().cast("array<struct<iao_name:string,iao_id:string>>").alias("section_type"), *[F.lit(None).cast("string").alias(x) for x in ("title", "journal", "volume")])
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(p)).alias("paragraphs")).withColumn("title", F.concat(F.lit("conversation "), F.col("conv_id")))
    found = rows.select("conv_id", F.posexplode(F.transform(bioc.passages(), lambda x: x["offset"])).alias("nth", "at"))
    return found.where("nth > 0").select("conv_id", (F.col("nth") - 1).alias("turn"), F.col("at").cast("long").alias("passage_offset"))


@query(f"""
WITH f AS (SELECT doc_id, trim(line) AS line, min(line_no) AS line_no FROM ({LINES}) WHERE trim(line) <> '' GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS nth, line FROM f
""")
def passage_dedupe(spark, sf_dir):
    """Documents as pages, a paragraph a line: of equal bodies the first."""
    lines = F.transform(F.split("text", "\n"), lambda x: _tag("p", _escape(F.trim(x))))
    pages = table(spark, sf_dir, "documents").select("doc_id", _tag('div class="sec"', F.array_join(lines, "")).alias("content"))
    rows = article.read_pages(pages, default_config("GENERIC")).select("doc_id", F.posexplode("paragraphs").alias("nth", "p"))
    return rows.select("doc_id", F.col("nth").cast("long").alias("nth"), F.col("p.body").alias("line"))


@query("""
SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS subheading FROM events
""")
def subheading_carry(spark, sf_dir):
    """Events as pages, one a user: what was clicked is the heading of all up to the next click."""
    rows = table(spark, sf_dir, "events")
    head = F.when((F.col("event_type") == "click") & F.col("props").isNotNull(), _tag("h3", _escape(F.col("props")))).otherwise("")
    part = F.struct("event_id", F.concat(head, _tag("p", F.col("event_id").cast("string"))).alias("html"))
    pages = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    pages = pages.select("user_id", _tag('div class="sec"', F.array_join(F.transform("parts", lambda x: x["html"]), "")).alias("content"))
    done = article.read_pages(pages, default_config("GENERIC")).select("user_id", F.explode("paragraphs").alias("p"))
    return done.select(F.col("p.body").cast(rows.schema["event_id"].dataType).alias("event_id"), "user_id", F.col("p.subsection_heading").alias("subheading"))


@query(f"""
WITH l AS (SELECT doc_id, line_no, regexp_replace(line, ' {{2,}}', ' ', 'g') AS x FROM ({LINES})),
t AS (SELECT doc_id, line_no, CASE WHEN length(x) > 1 AND x[1] = ' ' AND x[-1] = ' ' THEN x[2:-2] ELSE x END AS line FROM l),
f AS (SELECT doc_id, line AS text, min(line_no) AS line_no FROM t WHERE line NOT IN ('', ' ') GROUP BY ALL)
SELECT doc_id, row_number() OVER w - 1 AS nth, (coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS passage_offset,
  CASE line_no WHEN 0 THEN 'document title' ELSE 'Results' END AS section, CASE line_no WHEN 0 THEN 'IAO:0000305' ELSE 'IAO:0000318' END AS iao_id, text FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
""")
def jats_articles(spark, sf_dir):
    """Documents as JATS: the first line the title, the others paragraphs of one section; to passages."""
    parts = F.split("text", "\n")
    body = F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.lit("<p>"), _escape(p), F.lit("</p>"))), "")
    xml = F.concat(F.lit("<article><front><article-meta><article-id pub-id-type='pmc'>"), "doc_id", F.lit("</article-id><title-group><article-title>"), _escape(parts[0]), F.lit("</article-title></title-group></article-meta></front><body><sec><title>Results</title>"), body, F.lit("</sec></body></article>"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), xml.alias("content"))
    done = jats.article(docs, date=F.lit("20240101")).select("doc_id", F.posexplode(F.col("bioc.documents")[0]["passages"]).alias("nth", "p"))
    return done.select("doc_id", F.col("nth").cast("long").alias("nth"), F.col("p.offset").cast("long").alias("passage_offset"), F.element_at("p.infons", "section_title_1").alias("section"), F.element_at("p.infons", "iao_id_1").alias("iao_id"), "p.text")


# text of bars


BARS = f"""
WITH l AS (SELECT *, contains(line, '|') AS is_table FROM ({LINES}) WHERE regexp_matches(line, '\\S')),
o AS (SELECT *, CASE WHEN is_table AND NOT coalesce(lag(is_table) OVER (PARTITION BY doc_id ORDER BY line_no), false) THEN 1 ELSE 0 END AS opens FROM l),
i AS (SELECT doc_id, line_no, sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no) AS island, is_table,
  list_filter(list_transform(string_split(line, '|'), lambda c: trim(c)), lambda c: c <> '' AND NOT regexp_matches(c, '^[-–—]+$')) AS cells, line FROM o),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY line_no) - 1 AS row_no, max(len(cells)) OVER (PARTITION BY doc_id, island) AS width, dense_rank() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS nth
  FROM i WHERE is_table AND NOT regexp_matches(regexp_replace(line, '[\\s|:]', '', 'g'), '^[-–—]+$'))
"""


@query(f"{BARS} SELECT doc_id, nth, row_no, unnest(range(width)) AS col_no, coalesce(unnest(list_resize(cells, width)), '') AS cell FROM t")
def pipe_cells(spark, sf_dir):
    grids = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pipetables.split_text(F.col("text"))["grids"]).alias("nth", "grid"))
    rows = grids.select("doc_id", F.col("nth").cast("long").alias("nth"), F.posexplode("grid").alias("row_no", "row"))
    return rows.select("doc_id", "nth", F.col("row_no").cast("long").alias("row_no"), F.posexplode("row").alias("col_no", "cell")).withColumn("col_no", F.col("col_no").cast("long"))


@query(f"""{BARS},
p AS (SELECT doc_id, string_agg(translate(line, chr(160) || chr(173) || chr(8208) || chr(215), ' --x'), chr(10) || chr(10) ORDER BY line_no) AS text FROM i WHERE NOT is_table GROUP BY doc_id),
g AS (SELECT doc_id, count(DISTINCT nth) AS n FROM t GROUP BY doc_id)
SELECT doc_id, len(list_filter(string_split(coalesce(p.text, ''), chr(10) || chr(10)), lambda x: x <> ''))::BIGINT AS n_passages, md5(array_to_string(list_filter(string_split(coalesce(p.text, ''), chr(10) || chr(10)), lambda x: x <> ''), chr(10) || chr(10))) AS text,
  coalesce(g.n, 0)::BIGINT AS n_tables FROM documents LEFT JOIN p USING (doc_id) LEFT JOIN g USING (doc_id)
""")
def rendered_text(spark, sf_dir):
    """Documents as text that pages were rendered to, by the function of the pipeline: cleaned prose and tables of bars."""
    done = process_rendered_text(table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string")), date=F.lit("20240101"))
    texts = F.transform(F.col("bioc.documents")[0]["passages"], lambda p: p["text"])
    return done.select("doc_id", F.size(texts).cast("long").alias("n_passages"), F.md5(F.array_join(texts, "\n\n")).alias("text"), F.size("tables.documents").cast("long").alias("n_tables"))


# clean text


@query("""
SELECT doc_id, md5(translate(text, chr(160) || chr(173) || chr(8208) || chr(215), ' --x')) AS cleaned,
  md5(replace(regexp_replace(text, ' {2,}', ' ', 'g'), chr(10), ' ')) AS collapsed,
  md5(regexp_replace(replace(replace(text, 'Go to:', ''), chr(10), ''), '\\s{2,}', ' ', 'g')) AS as_reference FROM documents
""")
def clean_text(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_unicode(t)).alias("cleaned"), F.md5(applied(jats.collapse, t)).alias("collapsed"), F.md5(applied(article.reference_text, t)).alias("as_reference"))


@query("""
SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), chr(160), ' ')) AS decoded,
  length(regexp_replace(html, '<[^<>]+>', '', 'g')) AS n_without_tags FROM pages
""")
def decode_entities(spark, sf_dir):
    done = each(table(spark, sf_dir, "pages").select("page_id", "html"), "html", decoded=(jats.decode_entities, "string"), bare=(jats.strip_tags, "string"))
    return done.select("page_id", F.md5("decoded").alias("decoded"), F.length("bare").cast("long").alias("n_without_tags"))


@query("SELECT doc_id, md5(text) AS repaired, md5(text) AS unescaped FROM documents")
def repair_text(spark, sf_dir):
    """Texts garbled on purpose, by reading UTF-8 as Latin-1 and by escapes, come back as they were."""
    t = F.col("text")
    garbled = F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")
    escaped = F.replace(F.replace(t, F.lit("é"), F.lit("\\u00e9")), F.lit("ü"), F.lit("\\u00FC"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(applied(jats.repair, garbled)).alias("repaired"), F.md5(applied(jats.unescape, escaped)).alias("unescaped"))


@query()
def decomposed(spark, sf_dir):
    return each(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", nfkd=(nfkd, "string")).select("doc_id", F.length("nfkd").alias("n_chars_nfkd"))


# headings

FIRST = "SELECT doc_id, lower(regexp_extract(text, '^[^\\n]*')) AS h FROM documents"


@query(f"""
WITH f AS ({FIRST}),
t AS (SELECT doc_id, array_to_string(regexp_extract_all(h, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]+'), ' ') AS tokens FROM f)
SELECT doc_id, tokens, regexp_replace('2 . ' || tokens, '^\\d*\\s?[(.]\\]?\\s?', '') AS stripped,
  list_transform(regexp_split_to_array(tokens, '\\s?[/&]\\s?| and '), lambda x: regexp_replace(x, '^\\d*\\s?[(.]\\]?\\s?', '')) AS parts,
  contains(tokens, ' and ') OR contains(tokens, '&') OR contains(tokens, '/') AS compound FROM t
""")
def heading_tokens(spark, sf_dir):
    """The steps that a heading goes through before it is matched."""
    h = F.regexp_extract("text", r"^[^\n]*", 0)
    rows = table(spark, sf_dir, "documents").select("doc_id", applied(headings.tokens_of, h).alias("tokens"))
    t = F.col("tokens")
    return rows.select("doc_id", "tokens", applied(headings.strip_number, F.concat(F.lit("2 . "), t)).alias("stripped"), applied(headings.parts_of, t, "array<string>").alias("parts"), applied(headings.is_compound, t, "boolean").alias("compound"))


def _numbered(spark, sf_dir) -> DataFrame:
    known = spark.createDataFrame([(h, t) for t, hs in default_ontology()[0].items() for h in hs], "known string, term string")
    regions = table(spark, sf_dir, "nation").select("n_nationkey")
    return known.crossJoin(regions).select(F.concat(F.col("n_nationkey") + 1, F.lit(". "), F.initcap("known")).alias("heading"), "known")


@query()
def heading_types(spark, sf_dir):
    """Section types of all known headings with numbers before them, by the function of the pipeline."""
    rows = _numbered(spark, sf_dir).select("heading").distinct()
    return rows.select("heading", F.explode(F.get(headings.typed(F.array("heading")), F.lit(0))).alias("t")).select("heading", "t.iao_name", "t.iao_id")


# abbreviations


@query("SELECT doc_id, unnest(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))) AS sentence, unnest(range(len(string_split(text, '.')))) AS nth FROM documents")
def sentences(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(applied(A.sentences, F.col("text"), "array<string>")).alias("nth", "sentence"))
    return rows.select("doc_id", F.col("nth").cast("long").alias("nth"), "sentence")


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents)
SELECT word, NOT regexp_matches(word, '^\\p{N}+$') AND NOT regexp_matches(word, '^\\p{Ll}+$') AND regexp_matches(word, '^([\\p{L}\\p{N}][.\\-]?){2,10}$') AS is_short,
  regexp_replace('(' || word || '";', '([(;:])["''\\p{Pi}\\p{Pf}]|["''\\p{Pi}\\p{Pf}]([);:])', '\\1\\2', 'g') AS unquoted FROM w
""")
def short_forms(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).distinct()
    return words.select("word", applied(A.is_short_form, F.col("word"), "boolean").alias("is_short"), applied(A.drop_quotes, F.concat(F.lit("("), "word", F.lit('";'))).alias("unquoted"))


def _parts(spark, sf_dir) -> DataFrame:
    """Parts with the initials of their names as short forms, and a sentence that defines them."""
    initials = F.upper(F.concat(F.substring(F.split_part("p_name", F.lit(" "), F.lit(1)), 1, 1), F.substring(F.split_part("p_name", F.lit(" "), F.lit(2)), 1, 1)))
    rows = table(spark, sf_dir, "part").withColumn("short", initials)
    return rows.withColumn("sentence", F.concat(F.lit("We used a "), "p_name", F.lit(" ("), "short", F.lit(") here. It works. ")))


def _abbreviated(docs: DataFrame, doc: str) -> DataFrame:
    """(doc, pairs) of pages by the whole reader."""
    return article.read_pages(docs, default_config("GENERIC")).select(doc, F.explode("pairs").alias("x")).select(doc, "x.short", "x.long", "x.algorithms")


@query("SELECT p_partkey, upper(substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) AS short, p_name AS long FROM part")
def abbreviation_pairs(spark, sf_dir):
    pages = _parts(spark, sf_dir).select("p_partkey", _tag('div class="sec"', _tag("p", F.col("sentence"))).alias("content"))
    return _abbreviated(pages, "p_partkey").select("p_partkey", "short", "long")


def _sorted_html(order: str, html) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, html.alias("html")))), lambda x: x["html"]), "")


@query("""
WITH f AS (SELECT p_size AS doc_id, p_brand AS para, p_partkey AS nth, upper(substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) AS short, p_name AS long FROM part),
c AS (SELECT doc_id, para, short, long, count(*) AS n, min(nth) AS first_nth FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, para, short ORDER BY n DESC, first_nth) AS k FROM c),
m AS (SELECT doc_id, para, short, long FROM r WHERE k = 1)
SELECT doc_id, short, arg_max(long, para) AS long FROM m GROUP BY doc_id, short
""")
def abbreviation_choice(spark, sf_dir):
    """The most common definition in each paragraph, the last paragraph over all: a page a size, a paragraph a brand, which
    begins with the brand, since of equal paragraphs the first alone counts."""
    paragraphs = _parts(spark, sf_dir).groupBy("p_size", "p_brand").agg(_tag("p", F.concat("p_brand", F.lit(". "), _sorted_html("p_partkey", F.col("sentence")))).alias("p"))
    pages = paragraphs.groupBy(F.col("p_size").alias("doc_id")).agg(_tag('div class="sec"', _sorted_html("p_brand", F.col("p"))).alias("content"))
    return _abbreviated(pages, "doc_id").select("doc_id", "short", "long")


#: Pairs of a text (one paragraph a size) and of a list of the author's, of which the last of a short form counts.
BOTH = """
WITH f AS (SELECT p_size AS doc_id, p_partkey AS nth, upper(substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) AS short, p_name AS long, p_brand FROM part),
c AS (SELECT doc_id, short, long, count(*) AS n, min(nth) AS first_nth FROM f WHERE p_brand < 'Brand#2' GROUP BY ALL),
t AS (SELECT doc_id, short, long FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, short ORDER BY n DESC, first_nth) AS k FROM c) WHERE k = 1),
a AS (SELECT doc_id, short, arg_max(long, nth) AS long FROM f WHERE p_brand >= 'Brand#15' GROUP BY doc_id, short),
u AS (SELECT doc_id, short, long, min(k) AS k, array_to_string(list_transform(list_sort(list(k)), lambda x: CASE x WHEN 0 THEN 'abbreviations section' ELSE 'fulltext' END), ', ') AS algorithms
  FROM (SELECT *, 1 AS k FROM t UNION ALL SELECT *, 0 FROM a) GROUP BY doc_id, short, long)
"""


def _both(spark, sf_dir) -> DataFrame:
    parts = _parts(spark, sf_dir)
    text = parts.where("p_brand < 'Brand#2'").groupBy("p_size").agg(_tag("p", _sorted_html("p_partkey", F.col("sentence"))).alias("p"))
    terms = parts.where("p_brand >= 'Brand#15'").groupBy("p_size").agg(_tag("dl", _sorted_html("p_partkey", F.concat(_tag("dt", F.col("short")), _tag("dd", F.col("p_name"))))).alias("dl"))
    html = F.concat(_tag('div class="sec"', F.coalesce("p", F.lit(""))), F.lit("<h2>List of abbreviations</h2>"), F.coalesce("dl", F.lit("")), F.lit("<h2>End</h2>"))
    return text.join(terms, "p_size", "full").select(F.col("p_size").alias("doc_id"), html.alias("content"))


@query(f"{BOTH} SELECT doc_id, short, long, algorithms FROM u")
def abbreviation_merge(spark, sf_dir):
    """An equal pair has both its origins."""
    return _abbreviated(_both(spark, sf_dir), "doc_id").withColumn("algorithms", F.array_join("algorithms", ", "))


@query(f"""{BOTH},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, short ORDER BY k) AS nth FROM u)
SELECT doc_id, short AS text_short, max(long) FILTER (nth = 1) AS long_1, max(algorithms) FILTER (nth = 1) AS algorithm_1, max(long) FILTER (nth = 2) AS long_2, max(algorithms) FILTER (nth = 2) AS algorithm_2 FROM r GROUP BY doc_id, short
""")
def abbreviation_numbers(spark, sf_dir):
    """Long forms and their origins under numbered names, in the collection that the pipeline writes."""
    done = process_pages(_both(spark, sf_dir).withColumn("path", F.lit("x.html")), default_config("GENERIC"), date=F.lit("20240101"))
    p = done.select("doc_id", F.explode(F.col("abbreviations.documents")[0]["passages"]).alias("p"))
    names = {"text_short": "text_short", "long_1": "text_long_1", "algorithm_1": "extraction_algorithm_1", "long_2": "text_long_2", "algorithm_2": "extraction_algorithm_2"}
    return p.select("doc_id", *[F.try_element_at("p", F.lit(key)).alias(name) for name, key in names.items()])


# cells and tables

NUMERIC = "^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$"
KIND = f"""CASE WHEN lower(c) IN ('none', '', '-') THEN 'none' WHEN regexp_matches(replace(lower(c), ',', ''), '{NUMERIC}') THEN 'num'
  WHEN regexp_matches(c, '\\p{{Nd}}') THEN CASE WHEN regexp_matches(c, '^\\p{{Nd}}+$') THEN 'num' ELSE 'mix' END ELSE 'txt' END"""
CELLS = "SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\n|]+')) AS c FROM documents UNION SELECT o_orderkey::VARCHAR FROM orders UNION SELECT o_orderpriority FROM orders"


def _cells(spark, sf_dir) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n|]+")).alias("c"))
    orders = table(spark, sf_dir, "orders")
    return words.unionByName(orders.select(F.col("o_orderkey").cast("string").alias("c"))).unionByName(orders.select(F.col("o_orderpriority").alias("c"))).distinct()


@query(f"""
WITH x AS ({CELLS}) SELECT c, {KIND} AS kind,
  CASE WHEN regexp_matches(replace(translate(c, '−–', '--'), ',', ''), '{NUMERIC}') THEN replace(translate(c, '−–', '--'), ',', '')::DOUBLE END AS number FROM x
""")
def cell_kinds(spark, sf_dir):
    c = F.col("c")
    return _cells(spark, sf_dir).select("c", T.cell_kind(c).alias("kind"), T.number_of(c).alias("number"))


@query(f"""
WITH x AS (SELECT o_custkey, unnest([o_orderkey::VARCHAR, o_orderpriority, CASE WHEN o_orderkey < 500 THEN '-' ELSE o_orderstatus END]) AS c, unnest([0, 1, 2]) AS col_no FROM orders),
k AS (SELECT o_custkey, col_no, {KIND} AS kind FROM x),
n AS (SELECT o_custkey, col_no, count(*) FILTER (kind = 'num') AS n, count(*) FILTER (kind = 'txt') AS t, count(*) FILTER (kind = 'mix') AS m FROM k GROUP BY ALL)
SELECT o_custkey, col_no, CASE WHEN n >= t AND n >= m THEN 'num' WHEN t >= m THEN 'txt' ELSE 'mix' END AS kind FROM n
""")
def column_kinds(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cols = [F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.when(F.col("o_orderkey") < 500, "-").otherwise(F.col("o_orderstatus"))]
    grid = o.groupBy("o_custkey").agg(*[F.collect_list(c).alias(f"c{i}") for i, c in enumerate(cols)])
    return grid.select("o_custkey", F.posexplode(F.array(*[T.column_kind(F.col(f"c{i}")) for i in range(3)])).alias("col_no", "kind"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, [l_returnflag, CASE WHEN l_linenumber = 1 THEN l_returnflag ELSE '' END, CASE WHEN l_linestatus = 'O' THEN '' ELSE l_returnflag END, CASE WHEN l_linenumber = 2 THEN '5' ELSE 'None' END] AS cells FROM lineitem),
d AS (SELECT *, list_distinct(list_filter(cells, lambda x: x NOT IN ('', 'None'))) AS v FROM r)
SELECT l_orderkey, l_linenumber, len(v) = 1 AND regexp_matches(v[1], '^[a-zA-Z]') AS superrow FROM d
""")
def superrows(spark, sf_dir):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    cells = F.array(flag, F.when(line == 1, flag).otherwise(""), F.when(F.col("l_linestatus") == "O", "").otherwise(flag), F.when(line == 2, "5").otherwise("None"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.is_superrow(cells).alias("superrow"))


@query("""
WITH f AS (SELECT l_orderkey, l_partkey, l_returnflag = 'R' AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem),
o AS (SELECT *, CASE WHEN h AND NOT coalesce(lag(h) OVER (PARTITION BY l_orderkey ORDER BY pos), false) THEN 1 ELSE 0 END AS opens FROM f),
i AS (SELECT *, sum(opens) OVER (PARTITION BY l_orderkey ORDER BY pos) AS island FROM o),
d AS (SELECT l_orderkey, island, count(*) AS n_rows FROM i WHERE NOT h GROUP BY ALL),
t AS (SELECT l_orderkey, island, string_agg(l_partkey::VARCHAR, '|' ORDER BY pos) AS head FROM i WHERE h GROUP BY ALL)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY island) - 1 AS nth, coalesce(t.head, '') AS head, n_rows FROM d LEFT JOIN t USING (l_orderkey, island)
""")
def header_islands(spark, sf_dir):
    """Orders as tables, returned items as header rows: a run of these opens a table under their merged cells."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("r"))
    grid = F.transform("r", lambda x: F.struct(F.array(x["l_partkey"].cast("string")).alias("cells"), (x["l_returnflag"] == "R").alias("header"), F.lit(False).alias("super")).cast(tables.ROW))
    done = rows.select("l_orderkey", F.posexplode(tables.sectioned(grid)).alias("nth", "t"))
    return done.select("l_orderkey", F.col("nth").cast("long").alias("nth"), F.coalesce(F.get("t.columns", F.lit(0)), F.lit("")).alias("head"), F.size(F.flatten(F.transform("t.sections", lambda x: x["rows"]))).cast("long").alias("n_rows"))


@query("""
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_linenumber::VARCHAR || 'e-' || l_suppkey::VARCHAR WHEN l_returnflag = 'A' THEN l_linenumber::VARCHAR || '.5e-' || l_suppkey::VARCHAR ELSE 'n = ' || l_linenumber::VARCHAR END AS p FROM lineitem
""")
def p_values(spark, sf_dir):
    n, s = F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")
    raw = F.when(F.col("l_returnflag") == "R", F.concat(F.lit(" "), n, F.lit(" × 10–"), s)).when(F.col("l_returnflag") == "A", F.concat(F.lit("("), n, F.lit(".5 E − "), s, F.lit(")"))).otherwise(F.concat(F.lit("n = "), n))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", T.normal_p_value(T.clean_cell(raw)).alias("p"))


@query("""
WITH r AS (SELECT n_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
SELECT n_regionkey, n_regionkey::VARCHAR || '.' || (k + 1)::VARCHAR || '.1' AS cell_id, n_name AS cell_text FROM r
UNION ALL SELECT n_regionkey, n_regionkey::VARCHAR || '.' || (k + 1)::VARCHAR || '.2', n_nationkey::VARCHAR FROM r
UNION ALL SELECT DISTINCT n_regionkey, n_regionkey::VARCHAR || '.1.0', 'name' FROM r
UNION ALL SELECT DISTINCT n_regionkey, n_regionkey::VARCHAR || '.1.1', 'key' FROM r
""")
def grid_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    grid = F.concat(F.array(F.array(F.lit("name"), F.lit("key"))), F.transform("r", lambda x: F.array(x["n_name"], x["n_nationkey"].cast("string"))))
    docs = rows.select("n_regionkey", bioc.grid_document(grid, F.col("n_regionkey"), F.lit("")).alias("d"))
    p = docs.select("n_regionkey", F.col("d.passages")[0].alias("p"))
    return p.select("n_regionkey", F.explode(F.concat("p.column_headings", F.flatten(F.col("p.data_section")[0]["data_rows"]))).alias("c")).select("n_regionkey", "c.cell_id", "c.cell_text")


@query("""
WITH p AS (SELECT p_brand, p_type, p_name, p_size, p_partkey FROM part),
t AS (SELECT p_brand, p_type AS section_name, count(*) AS n_rows, sum(p_size) AS total FROM p GROUP BY ALL)
SELECT p_brand, section_name, n_rows, total::DOUBLE AS total FROM t
""")
def table_sections(spark, sf_dir):
    """Parts as a table per brand, a superrow before each type: cut into sections with numbers in their cells."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))).alias("r"))
    part = F.concat(F.array(F.array(F.col("p_type"), F.lit(""), F.lit(""))), F.transform("r", lambda x: F.array(x["p_name"], x["p_partkey"].cast("string"), x["p_size"].cast("string"))))
    grids = rows.select("p_brand", F.struct("p_type", part.alias("part")).alias("x")).groupBy("p_brand").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"])).alias("body"))
    grid = F.concat(F.array(F.array(F.lit("name"), F.lit("key"), F.lit("size"))), F.col("body"))
    heads = F.transform(grid, lambda _, i: i == 0)
    done = grids.withColumn("parts", tables.sectioned(tables.with_subheaders(tables.with_sections(grid, heads))))
    s = done.select("p_brand", F.explode("parts").alias("t")).select("p_brand", F.explode("t.sections").alias("s"))
    return s.select("p_brand", F.col("s.name").alias("section_name"), F.size("s.rows").cast("long").alias("n_rows"), F.aggregate("s.rows", F.lit(0.0), lambda a, r: a + T.number_of(r[2])).alias("total"))


@query("""
WITH r AS (SELECT n_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
SELECT n_regionkey, '1.' || (k + 1)::VARCHAR || '.1' AS cell_id, n_name AS cell_text, 'Table ' || n_regionkey::VARCHAR || '. Nations' AS title FROM r
UNION ALL SELECT n_regionkey, '1.' || (k + 1)::VARCHAR || '.2', n_nationkey::VARCHAR, 'Table ' || n_regionkey::VARCHAR || '. Nations' FROM r
""")
def html_tables(spark, sf_dir):
    """Nations as a page with a table for each region, through the whole of the table operators."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: _tag("tr", F.concat(_tag("td", x["n_name"]), _tag("td", x["n_nationkey"].cast("string"))))), "")
    head = F.lit("<thead><tr><th>name</th><th>key</th></tr></thead>")
    html = _tag('div class="table-wrap"', F.concat(_tag("h3", F.concat(F.lit("Table "), "n_regionkey", F.lit(". Nations"))), _tag("table", F.concat(head, _tag("tbody", body)))))
    pages = rows.select("n_regionkey", F.lit("x.html").alias("path"), html.alias("content"))
    docs = process_pages(pages, default_config("GENERIC"), date=F.lit("20240101")).select("n_regionkey", F.explode("tables").alias("t"))
    cells = docs.select("n_regionkey", F.col("t.passages")[0]["text"].alias("title"), F.explode("t.passages").alias("p")).where("p.data_section IS NOT NULL")
    return cells.select("n_regionkey", "title", F.explode(F.flatten(F.col("p.data_section")[0]["data_rows"])).alias("c")).select("n_regionkey", "c.cell_id", "c.cell_text", "title")


@query("SELECT p_brand, 'K' || p_partkey::VARCHAR AS short, p_name AS long, 'abbreviations section' AS algorithm FROM part")
def author_abbreviations(spark, sf_dir):
    """Definition lists as authors give them, one page a brand."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_list(F.struct("p_partkey", "p_name")).alias("r"))
    terms = F.array_join(F.transform("r", lambda x: F.concat(_tag("dt", F.concat(F.lit("K"), x["p_partkey"])), _tag("dd", x["p_name"]))), "")
    html = F.concat(F.lit("<h2>List of abbreviations</h2>"), _tag("dl", terms), F.lit("<h2>End</h2>"))
    done = article.read_pages(rows.select("p_brand", html.alias("content")), default_config("GENERIC"))
    return done.select("p_brand", F.explode("pairs").alias("p")).select("p_brand", "p.short", "p.long", F.array_join("p.algorithms", ", ").alias("algorithm"))


@query("""
SELECT s_nationkey, s_name || ' 12. ' || s_suppkey::VARCHAR AS body, s_name AS title, s_suppkey::VARCHAR AS volume, 'IAO:0000320' AS iao_id FROM supplier
""")
def reference_paragraphs(spark, sf_dir):
    """Suppliers as reference lists, one page a nation."""
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct("s_name", "s_suppkey")).alias("r"))
    items = F.array_join(F.transform("r", lambda x: _tag("li", F.concat(_tag('span class="ref-title"', x["s_name"]), F.lit("  12. Go to:"), _tag('span class="ref-vol"', x["s_suppkey"].cast("string"))))), "")
    html = _tag('div class="sec"', F.concat(F.lit("<h2>References</h2>"), _tag("ul", items)))
    done = article.read_pages(rows.select("s_nationkey", html.alias("content")), default_config("GENERIC"))
    p = done.select("s_nationkey", F.explode("paragraphs").alias("p"))
    return p.select("s_nationkey", "p.body", "p.title", "p.volume", F.col("p.section_type")[0]["iao_id"].alias("iao_id"))


def _made(rows: DataFrame, make) -> DataFrame:
    """(key, content): files of (key, cells) made on the workers."""

    def run(batches):
        for pdf in batches:
            pdf["content"] = [make([list(r) for r in x]) for x in pdf["cells"]]
            yield pdf[["key", "content"]]

    return rows.mapInPandas(run, "key long, content binary")


@query("SELECT n_regionkey::BIGINT AS key, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row_no, n_name AS name, n_nationkey::VARCHAR AS nation FROM nation")
def excel_rows(spark, sf_dir):
    """Nations as spreadsheets, one a region, and read again."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_name"], x["n_nationkey"].cast("string")))
    made = _made(table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("key")).agg(cells.alias("cells")), lambda g: office.write_xlsx([g]))
    rows = office.read_excel(made).select("key", F.posexplode(F.col("grids")[0]).alias("row_no", "r"))
    return rows.select("key", F.col("row_no").cast("long").alias("row_no"), F.col("r")[0].alias("name"), F.col("r")[1].alias("nation"))


@query("""
WITH r AS (SELECT n_regionkey::BIGINT AS key, n_name AS text, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS nth FROM nation)
SELECT key, nth, text, CASE WHEN text = upper(text) OR nth = 0 THEN 'document title' ELSE 'supplementary material section' END AS kind,
  (coalesce(sum(length(text)) OVER (PARTITION BY key ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS passage_offset FROM r
""")
def word_files(spark, sf_dir):
    """Nations as text files of a word processor, the first line of each region a header, and read again."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_name"]))
    made = _made(table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("key")).agg(cells.alias("cells")), lambda g: office.write_docx([(r[0], i == 0) for i, r in enumerate(g)]))
    rows = office.read_word(made).select("key", F.posexplode(bioc.word_passages(F.col("paragraphs"))).alias("nth", "p"))
    return rows.select("key", F.col("nth").cast("long").alias("nth"), "p.text", F.element_at("p.infons", "iao_name_1").alias("kind"), F.col("p.offset").cast("long").alias("passage_offset"))


@query("""
WITH t AS (SELECT n_regionkey, n_nationkey % 4 AS id, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation),
a AS (SELECT n_regionkey, list(id::VARCHAR ORDER BY k) AS ids FROM t GROUP BY n_regionkey)
SELECT n_regionkey, list_reduce(list_prepend([]::VARCHAR[], list_transform(ids, lambda x: [x])), lambda s, x: list_append(s, CASE WHEN list_contains(s, x[1]) THEN (len(s) + 1)::VARCHAR ELSE x[1] END)) AS ids FROM a
""")
def linked_table_ids(spark, sf_dir):
    """Ids of linked tables: one that is there already becomes the number of all so far plus one."""
    docs = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", (F.col("n_nationkey") % 4).cast("string").alias("id")))).alias("d"))
    linked = F.transform("d", lambda x: F.struct(x["id"].alias("id")))
    return docs.select("n_regionkey", F.transform(tables.renumbered(F.slice(linked, 1, 0), linked), lambda x: x["id"]).alias("ids"))


# codecs


@query("SELECT doc_id, string_split(text, chr(10))[1] AS first_line, md5(text) AS text, doc_id::VARCHAR AS id FROM documents")
def bioc_json_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    part = bioc.passage(F.lit(0), bioc.infons((F.lit("first"), F.split("text", "\n")[0])), F.col("text"))
    c = bioc.collection(bioc.FULL_TEXT, F.array(bioc.document(F.col("doc_id").cast("string"), F.col("source"), F.array(part))), F.lit("20240101"))
    back = docs.select("doc_id", bioc_io.from_json(bioc_io.to_json(c)).alias("c")).select("doc_id", F.col("c.documents")[0].alias("d"))
    p = F.col("d.passages")[0]
    return back.select("doc_id", p["infons"]["first"].alias("first_line"), F.md5(p["text"]).alias("text"), F.col("d.id").alias("id"))


@query("SELECT doc_id, source AS infon, md5(text) AS text, doc_id::VARCHAR AS id FROM documents")
def bioc_xml_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    part = bioc.passage(F.lit(0), bioc.infons((F.lit("source"), F.col("source"))), F.col("text"))
    c = bioc.collection(bioc.FULL_TEXT, F.array(bioc.document(F.col("doc_id").cast("string"), F.col("source"), F.array(part))), F.lit("20240101"))
    back = docs.select("doc_id", bioc_io.from_xml(bioc_io.to_xml(c.cast(bioc.COLLECTION))).alias("c")).select("doc_id", F.col("c.documents")[0].alias("d"))
    p = F.col("d.passages")[0]
    return back.select("doc_id", p["infons"]["source"].alias("infon"), F.md5(p["text"]).alias("text"), F.col("d.id").alias("id"))


@query("""
WITH a AS (SELECT doc_id, text FROM documents), b AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN text || '!' ELSE text END AS text FROM documents)
SELECT doc_id, md5(text) AS text, 'old' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT doc_id, md5(text), 'new' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
""")
def output_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    new = docs.select("doc_id", F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return bioc_io.differences(docs.select("doc_id", "text"), new).select("doc_id", F.md5("text").alias("text"), "side")
