import json

import pytest
from pyspark.sql import functions as F

from folioframe import api
from folioframe.__main__ import main
from folioframe.operators import bioc, jats, pipetables
from folioframe.plans.configs import NAMES, default_config
from folioframe.plans.rules import Page, read_config
from folioframe.sources import bioc_io, dom, files, office
from folioframe.streaming import ingest
from tests import fixtures as X

CONFIG = default_config("GENERIC")


@pytest.fixture(scope="module")
def article(spark):
    pages = spark.createDataFrame([("/d/PMC1.html", X.HTML), ("/d/empty.html", None)], "path string, content string")
    rows = api.process_pages(pages, CONFIG, date=F.lit("20240101")).collect()
    return {r["path"]: r.asDict(True) for r in rows}


def test_paragraphs(article):
    a = article["/d/PMC1.html"]
    assert a["title"] == "A study of grid computing"
    got = [(p["section_heading"], p["subsection_heading"], p["body"][:12]) for p in a["paragraphs"]]
    assert got == [
        ("keywords", "", "grid cloud"),
        ("1. Introduction", "", "Grid computi"),
        ("1. Introduction", "Aims", "Second text."),
        ("1. Introduction", "Aims", "Third text."),
        ("1. Introduction", "Scope", "Fourth text."),
        ("document part", "", "No heading h"),
        ("References", "", "Smith J. A p"),
    ]
    assert a["paragraphs"][1]["section_type"] == [{"iao_name": "introduction section", "iao_id": "IAO:0000316"}]
    assert (a["paragraphs"][-1]["title"], a["paragraphs"][-1]["journal"], a["paragraphs"][-1]["volume"]) == ("T", "J", None)


def test_empty_page(article):
    a = article["/d/empty.html"]
    assert a["title"] == "" and a["paragraphs"] == [] and a["tables"] == [] and a["parse_error"] is None


def test_offsets(article):
    a = article["/d/PMC1.html"]
    passages = a["bioc"]["documents"][0]["passages"]
    assert passages[0]["offset"] == 0 and passages[0]["text"] == a["title"]
    at, seen, want = len(a["title"]), {a["title"]}, []
    for p in a["paragraphs"]:
        want.append(at)
        at += len(p["body"])
        for h in (p["subsection_heading"], p["section_heading"]):
            if h not in seen:
                seen.add(h)
                at += len(h)
    assert [p["offset"] for p in passages[1:]] == want
    assert passages[3]["infons"] == {"section_title_1": "1. Introduction", "section_title_2": "Aims", "iao_name_1": "introduction section", "iao_id_1": "IAO:0000316"}
    (document,) = a["bioc"]["documents"]
    assert (document["id"], a["bioc"]["date"]) == ("PMC1", "20240101")


def test_abbreviations(article):
    got = {p["text_short"]: p for p in article["/d/PMC1.html"]["abbreviations"]["documents"][0]["passages"]}
    assert got["GC"] == {"text_short": "GC", "text_long_1": "Grid computing", "extraction_algorithm_1": "abbreviations section, fulltext"}
    assert got["WHO"]["text_long_1"] == "world health organization" and got["XY"]["extraction_algorithm_1"] == "abbreviations section"


def test_tables(article):
    (t,) = article["/d/PMC1.html"]["tables"]
    title, caption, content, footer = t["passages"]
    assert (title["text"], caption["text"], footer["text"]) == ("Table 1. Results", "Some caption", "A footer")
    assert [c["cell_text"] for c in content["column_headings"]] == ["name|name", "values|n", "values|p"]  # a cell that spans rows is in each of them
    assert [s["table_section_title_1"] for s in content["data_section"]] == ["Group A", "Group B"]
    cells = [[(c["cell_id"], c["cell_text"], c["cell_num"]) for c in row] for s in content["data_section"] for row in s["data_rows"]]
    assert cells[0] == [("1.2.1", "a", None), ("1.2.2", "1,200", 1200.0), ("1.2.3", "3e-5", 3e-5)]
    assert cells[1][1:] == [("1.3.2", "−2.5", -2.5), ("1.3.3", "0.5", 0.5)]
    assert cells[2][2] == ("1.4.3", "1<sup>st</sup>", None)
    assert caption["offset"] == 1 and content["offset"] == 1 + len("Some caption")


def test_index_column_becomes_sections(spark):
    rows = "".join(f"<tr><td>{g}</td><td>{n}</td><td>{v}</td></tr>" for g, n, v in (("A", "x", 1), ("A", "y", 2), ("B", "z", 3), ("B", "w", 4)))
    html = f'<div class="table-wrap"><table><thead><tr><th>g</th><th>n</th><th>v</th></tr></thead><tbody>{rows}</tbody></table></div>'
    t = api.process_pages(spark.createDataFrame([("a.html", html)], "path string, content string"), CONFIG).first()["tables"][0]
    content = next(p for p in t["passages"] if p["data_section"])
    assert [(s["table_section_title_1"], len(s["data_rows"])) for s in content["data_section"]] == [("A", 2), ("B", 2)]
    assert [c["cell_text"] for c in content["column_headings"]] == ["n", "v"]


def test_paths_against_walks():
    page = Page(*dom.parse_document(X.HTML))
    up = lambda n: page.nodes[n["parent"]] if n["parent"] >= 0 else None
    above = lambda n: [] if up(n) is None else [up(n), *above(up(n))]
    sec = lambda n: n["tag"] == "div" and "sec" in n["attrs"].get("class", "")
    nth = lambda n: sum(s["tag"] == n["tag"] and s["parent"] == n["parent"] and s["pre"] <= n["pre"] for s in page.nodes)
    tags = lambda n: [n["tag"], *(x["tag"] for x in above(n))]
    for path, test in {
        '//*[@class="sec"]': lambda n: n["attrs"].get("class") == "sec",
        "/html/body/div[3]": lambda n: tags(n) == ["div", "body", "html"] and nth(n) == 3,
        '//div[contains(@class,"sec")]//p': lambda n: n["tag"] == "p" and any(map(sec, above(n))),
        '//div[contains(@class,"sec")]/p': lambda n: n["tag"] == "p" and sec(up(n)),
        "//body/div/h2": lambda n: tags(n)[:3] == ["h2", "div", "body"],
        "//li": lambda n: n["tag"] == "li",
        "//td[@colspan]": lambda n: n["tag"] == "td" and "colspan" in n["attrs"],
    }.items():
        got = [n["pre"] for n in page.path(path)]
        assert got == [n["pre"] for n in page.nodes if test(n)] and got, path


def test_rendered_text_is_cleaned(spark):
    df = spark.createDataFrame([("a.pdf", "soft\u00adhyphen 3\u00d75\na\u00a0b | c\n--|--\n1 | 2")], "path string, text string")
    r = api.process_rendered_text(df).first()
    assert [p["text"] for p in r["bioc"]["documents"][0]["passages"]] == ["soft-hyphen 3x5"]
    assert "a b" in str(r["tables"])


def test_configs():
    assert {"PMC", "LEGACY_PMC", "PLOS_GENETICS", "NATURE_GENETICS"} <= set(NAMES) and all(default_config(n) for n in NAMES)
    with pytest.raises(KeyError):
        read_config({})
    with pytest.raises(ValueError):
        read_config({"config": dict(title={"defined-by": [dict(xpath="count(//a)")]})})
    with pytest.raises(ValueError):
        read_config({"config": dict(title={"defined-by": [dict()]})})


def test_jats(spark):
    docs = spark.createDataFrame([("PMC123.xml", X.JATS), ("none.xml", None)], "path string, content string")
    by = {r["path"]: r["bioc"].asDict(True) for r in jats.article(docs, date=F.lit("20240101")).collect()}
    c = by["PMC123.xml"]
    assert {k: c["infons"][k] for k in ("pmcid", "doi", "pmid", "journal", "pub_type", "year")} == {"pmcid": "PMC123", "doi": "10.1/x", "pmid": "77", "journal": "J Test", "pub_type": "Research", "year": "2020"}
    p = c["documents"][0]["passages"]
    assert [x["text"] for x in p] == ["On things", "one; two", "To see.", "We looked.", "Loose first text.", "Loose second text.", "Main text.", "Sub text.", "Café text.", "Thanks to all.", "A note.", "On request.", "1 J Doe, Roe Et al., Title, Src, 2001;5", "Plain reference."]
    assert [x["offset"] for x in p][:3] == [0, 10, 19] and p[4]["infons"]["section_title_1"] == "introduction"
    assert p[7]["infons"]["section_title_1"] == "Methods" and p[7]["infons"]["section_title_2"] == "Sub part"
    assert p[8]["infons"]["iao_name_1"] == "results section" and p[8]["infons"]["iao_name_2"] == "discussion section"
    assert p[12]["infons"]["doi"] == "d" and p[9]["infons"]["section_title_1"] == "Acknowledgments"
    assert by["none.xml"]["documents"][0]["passages"] == []


def test_pipe_text(spark):
    text = "Intro\n\na | b\n---|---\n1 | 2 | 3\nMiddle\nx | y"
    got = spark.createDataFrame([(text,)], "t string").select(pipetables.split_text(F.col("t")).alias("x")).first()["x"]
    assert got["text"] == "Intro\n\nMiddle"
    assert got["grids"] == [[["a", "b", ""], ["1", "2", "3"]], [["x", "y"]]]


def test_office(spark):
    df = spark.createDataFrame([("a.docx", bytearray(X.docx())), ("bad.docx", bytearray(b"no"))], "path string, content binary")
    good, bad = office.read_word(df).collect()
    assert [(p["text"], p["is_header"]) for p in good["paragraphs"]] == [("Heading", True), ("Body text.", False), ("ALL CAPS", False)]
    assert good["grids"] == [[["a", "b"], ["1", "2"]]] and bad["grids"] is None and bad["parse_error"]
    grids = office.read_excel(spark.createDataFrame([("a.xlsx", bytearray(X.xlsx()))], "path string, content binary")).first()["grids"]
    assert grids == [[["num", "when"], ["1.5", "2020-01-01 00:00:00"], ["", "True"]], [["other"]]]


def test_bioc_codecs(spark):
    mark = {"id": "a", "text": "t", "offset": 1, "length": 2, "infons": {"k": "v"}, "locations": [{"offset": 1, "length": 2}]}
    rel = {"id": "r", "infons": {"x": "y"}, "nodes": [{"refid": "a", "role": "from"}, {"refid": "b", "role": "to"}]}
    sentence = {"text": "S", "offset": 3, "infons": {"a": "b"}, "annotations": [mark], "relations": [rel]}
    passage = {"offset": 5, "infons": {"i": "j"}, "text": "", "sentences": [sentence], "annotations": [mark], "relations": [rel]}
    c = {"source": "s", "date": "20240101", "key": "k", "infons": {"m": "n"}, "documents": [{"id": "1", "inputfile": "", "infons": {"d": "e"}, "passages": [passage], "annotations": [mark], "relations": [rel]}]}
    df = spark.createDataFrame([(json.dumps(c),)], "j string").select(bioc_io.from_json(F.col("j")).alias("c"))
    assert df.first()["c"].asDict(True) == c
    back = df.select(bioc_io.to_xml(F.col("c")).alias("x")).select(bioc_io.from_xml(F.col("x")).alias("c")).first()["c"].asDict(True)
    assert back == c
    assert bioc_io.read_xml("<collection><infon key='a'/></collection>")["infons"] == {}


def test_supplement(spark):
    df = spark.createDataFrame([("One\n\nTwo\n\n\n\nThree",)], "t string")
    got = df.select(bioc.text_passages(F.col("t")).alias("p")).first()["p"]
    assert [(p["offset"], p["text"]) for p in got] == [(0, "One"), (3, "Two"), (6, "Three")]


@pytest.fixture
def folder(tmp_path):
    for name, data in {"PMC1.html": X.HTML, "PMC1_table_1.html": X.LINKED, "sub/PMC123.xml": X.JATS, "s.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(data)
    (tmp_path / "w.docx").write_bytes(X.docx())
    (tmp_path / "e.xlsx").write_bytes(X.xlsx())
    return tmp_path


def test_directory(spark, folder):
    by = {r["path"].rsplit("/", 1)[1]: r for r in api.process_directory(CONFIG, str(folder), spark).collect()}
    assert set(by) == {"PMC1.html", "PMC123.xml", "s.txt", "w.docx", "e.xlsx"}
    tables = json.loads(by["PMC1.html"]["tables"])["documents"]
    assert [t["id"] for t in tables] == ["1", "2"] and tables[0]["passages"][2]["data_section"][0]["data_rows"][0][1]["cell_text"] == 1200.0
    assert by["s.txt"]["error"] and not by["PMC123.xml"]["error"]
    assert len(json.loads(by["e.xlsx"]["tables"])["documents"]) == 2
    assert json.loads(by["w.docx"]["bioc"])["documents"][0]["passages"][0]["infons"]["iao_name_1"] == "document title"


def test_single_file(spark, folder):
    a = api.process_file(CONFIG, folder / "PMC1.html", [folder / "PMC1_table_1.html"], spark)
    assert a.has_tables and a.main_text_to_bioc_xml().startswith("<?xml") and set(a.to_dict()) == {"file_path", "main_text", "abbreviations", "tables"}
    with pytest.raises(NotImplementedError):
        api.process_file(CONFIG, folder / "s.txt", spark=spark)
    with pytest.raises(FileNotFoundError):
        api.process_file(CONFIG, folder / "nope.html", spark=spark)


@pytest.mark.parametrize("fmt", ["JSON", "XML"])
def test_command_line(spark, folder, tmp_path, fmt):
    out = tmp_path / f"out{fmt}"
    assert main(["-f", str(folder), "-t", str(out), "-o", fmt, "-b", "GENERIC"]) == 0
    names = {p.name for p in out.rglob("*") if p.suffix != ".log"}
    end = "xml" if fmt == "XML" else "json"
    assert {f"PMC1_bioc.{end}", "PMC1_abbreviations.json", "PMC1_tables.json"} <= names and "written" in next(out.glob("*.log")).read_text()


def test_groups_and_types(spark):
    paths = ["/a/x.html", "/a/x_table_2.html", "/a/x_table_10.html", "/b/y.pdf", "/b/z.bin"]
    got = {r["key"]: (r["main_text"], r["linked_tables"]) for r in files.grouped(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {"/a/x": ("/a/x.html", ["/a/x_table_10.html", "/a/x_table_2.html"]), "/b/y.pdf": ("/b/y.pdf", [])}
    rows = [("a.html", b"<p>x</p>"), ("b.xml", X.JATS.encode()), ("c.xml", b"<a><b></a>"), ("d.PDF", b""), ("e.docx", b""), ("f.xls", b""), ("g.json", b"")]
    typed = files.typed(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary"))
    assert {r["path"]: r["file_type"] for r in typed.collect()} == {"a.html": "HTML", "b.xml": "XML", "c.xml": "HTML", "d.PDF": "PDF", "e.docx": "WORD", "f.xls": "EXCEL", "g.json": "UNKNOWN"}


def test_each_format_reads_its_own_files(spark, tmp_path):
    for name in ("a.html", "B.XML", "c.DocX", "d.pdf", "e.txt", "f.xls"):
        (tmp_path / name).write_bytes(b"x")
    scan = lambda pattern: files.scan(spark, str(tmp_path), pattern)
    names = lambda df: sorted(r["path"].rsplit("/", 1)[1] for r in df.select("path").collect())
    assert names(files.with_suffixes(scan, ".html", ".htm", ".xml")) == ["B.XML", "a.html"]
    assert names(files.with_suffixes(scan, ".docx", ".doc")) == names(files.with_suffixes(scan(None), ".docx", ".doc")) == ["c.DocX"]
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in api.process(scan, CONFIG).collect()}
    assert sorted(got) == ["B.XML", "a.html", "c.DocX", "d.pdf", "e.txt", "f.xls"] and got["a.html"] is None and got["e.txt"].startswith("unknown") and got["c.DocX"]
    rows = {r["path"].rsplit("/", 1)[1]: r["error"] for r in api.process(scan(None), CONFIG).collect()}
    assert rows == got


def test_stream(spark, folder, tmp_path):
    q = ingest.write_pages(ingest.page_stream(spark, str(folder), CONFIG), str(tmp_path / "o"), str(tmp_path / "c"), once=True)
    q.awaitTermination(60)
    assert {r["kind"] for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {"main_text", "linked_tables"}


def test_views(spark):
    api.register_views(api.process_pages(spark.createDataFrame([("a.html", X.HTML)], "path string, content string"), CONFIG))
    assert spark.sql("SELECT count(*) FROM passages").first()[0] == 8
    assert spark.sql("SELECT count(*) FROM table_cells WHERE section = 'Group A'").first()[0] == 6
    assert spark.sql("SELECT count(*) FROM abbreviations").first()[0] == 3


def test_broken_documents_dont_fail():
    for html in ("<p", "<p><b>x</p></b>", "</p></p>", "<table><tr><td rowspan='x' colspan='99999'>a</table>", "<![CDATA[x", "&#xFFFFFFF;"):
        dom.parse_document(html)
        dom.parse_document(html, xml=True)


def test_references_without_semicolon_are_text():
    text = lambda s, **k: dom.parse_document(s, **k)[0]
    assert text("<h1>a&amp;&amp; b&amp</h1><p>&amplt; &#39 x &#39; &copy &copy; R&D</p>") == "a&& b&amp&amplt; &#39 x ' &copy © R&D"
    assert text("<p>a <![CDATA[b&lt <i>]]> &lt</p>", xml=True) == "a b&lt <i> &lt"
