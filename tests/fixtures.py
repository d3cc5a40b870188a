"""Small documents of the shapes that the operators are for."""

import io
import zipfile

HTML = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>
<h1>A study of grid computing</h1>
<div class="keywords">grid</div><div class="keywords">cloud</div>
<div class="sec"><h2>1. Introduction</h2><p>Grid computing (GC) is used. We like the world health organization (WHO).</p>
<div class="subsection"><h3>Aims</h3><p>Second text.</p></div><p>Third text.</p>
<h4>Scope</h4><p>Fourth text.</p><p>Second text.</p>
<div class="fig"><p>A figure caption.</p></div><p style="display:none">hidden</p></div>
<div class="sec"><p>No heading here.</p></div>
<div class="sec"><h2>References</h2><ul><li>Smith J.  A paper.
Go to:<span class="ref-title">T</span> <span class="ref-journal">J</span></li></ul></div>
<h2>List of abbreviations</h2><dl><dt>GC</dt><dd>Grid computing</dd><dt>XY</dt><dd>ex why</dd></dl>
<div class="table-wrap"><h3>Table 1. Results</h3><div class="caption">Some caption</div>
<table><thead><tr><th rowspan="2">name</th><th colspan="2">values</th></tr><tr><th>n</th><th>p</th></tr></thead>
<tbody><tr><td colspan="3">Group A</td></tr><tr><td>a</td><td>1,200</td><td>3 × 10–5</td></tr><tr><td>b</td><td>−2.5</td><td>(0.5)</td></tr>
<tr><td colspan="3">Group B</td></tr><tr><td>c</td><td>7</td><td>1<sup>st</sup></td></tr></tbody></table><div class="footer">A footer</div></div>
</body></html>"""

LINKED = """<html><body><div class="table-wrap"><h3>Table 1. Linked</h3><table><thead><tr><th>k</th><th>v</th></tr></thead><tbody><tr><td>one</td><td>1</td></tr><tr><td>two</td><td>2</td></tr><tr><td>three</td><td>3</td></tr></tbody></table></div></body></html>"""

JATS = """<?xml version="1.0"?><article><front><journal-meta><journal-title>J Test</journal-title></journal-meta><article-meta>
<article-id pub-id-type="pmc">123</article-id><article-id pub-id-type="doi">10.1/x</article-id><article-id pub-id-type="pmid">77</article-id>
<article-categories><subj-group><subject>Research</subject></subj-group></article-categories>
<title-group><article-title>On <italic>things</italic></article-title></title-group>
<history><date date-type="accepted"><year>2020</year></date></history>
<abstract><sec><title>Aim</title><p>To see.</p></sec><sec><title>Methods</title><p>We looked.</p></sec></abstract>
<kwd-group><kwd>one</kwd><kwd>two</kwd></kwd-group><kwd-group xml:lang="fr"><kwd>un</kwd></kwd-group><kwd-group><title>Abbreviations</title><kwd>GC</kwd></kwd-group>
</article-meta></front><body><p>Loose first text.</p><p>Loose second text.</p>
<sec><title>1. Methods</title><p>Main text.</p><sec><title>Sub part</title><p>Sub text.</p><p>Main text.</p></sec><fig><p>fig</p></fig></sec>
<sec><title>Results &amp; discussion</title><p>CafÃ© text.</p></sec></body>
<back><ack><p>Thanks to all.</p></ack><fn-group><fn><p>A note.</p></fn></fn-group><notes><title>Data</title><p>On request.</p></notes>
<ref-list><ref><label>1</label><element-citation publication-type="journal"><person-group person-group-type="author"><name><surname>Doe</surname><given-names>J</given-names></name><name><surname>Roe</surname></name><etal/></person-group><article-title>Title</article-title><source>Src</source><year>2001</year><volume>5</volume><pub-id pub-id-type="doi">d</pub-id></element-citation></ref>
<ref><mixed-citation>Plain reference.</mixed-citation></ref></ref-list></back></article>"""


def zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Heading", "H1") + p("Body text.") + p("ALL CAPS") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    styles = f'<w:styles {w}><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:rPr><w:sz w:val="22"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="H1"><w:rPr><w:sz w:val="32"/></w:rPr></w:style></w:styles>'
    return zipped({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})


def xlsx() -> bytes:
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    one = f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>when</t></is></c></row><row r="2"><c r="A2"><v>1.5</v></c><c r="B2" s="1"><v>43831</v></c></row><row r="3"><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>'
    two = f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c></row></sheetData></worksheet>'
    return zipped({
        "xl/workbook.xml": f'<workbook {s} xmlns:r="{r}"><sheets><sheet name="x" r:id="r1"/><sheet name="y" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>num</t></si><si><t>other</t></si></sst>",
        "xl/styles.xml": f'<styleSheet {s}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": one,
        "xl/worksheets/sheet2.xml": two,
    })
