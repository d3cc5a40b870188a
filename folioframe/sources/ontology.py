"""Section types: headings to terms, terms to ids. Our own compact dictionary of common headings with the public ids
of the Information Artifact Ontology; another can be read from two files of two tab-separated columns each."""

from __future__ import annotations

from functools import cache


IDS = {
    "references section": "IAO:0000320", "keywords section": "IAO:0000630", "abbreviations section": "IAO:0000606",
    "textual abstract section": "IAO:0000315", "availability section": "IAO:0000611", "acknowledgements section": "IAO:0000324",
    "funding source declaration section": "IAO:0000623", "supplementary material section": "IAO:0000326", "methods section": "IAO:0000317",
    "author contributions section": "IAO:0000323", "author information section": "IAO:0000607", "introduction section": "IAO:0000316",
    "results section": "IAO:0000318", "discussion section": "IAO:0000319", "conclusion section": "IAO:0000615",
    "conflict of interest section": "IAO:0000616", "consent section": "IAO:0000618", "ethical approval section": "IAO:0000620",
    "case report section": "IAO:0000613", "figures section": "IAO:0000622", "tables section": "IAO:0000645",
    "footnote section": "IAO:0000325", "materials section": "IAO:0000633", "statistical analysis section": "IAO:0000644",
    "study limitations section": "IAO:0000631", "patients section": "IAO:0000635", "related work section": "IAO:0000639",
    "future directions section": "IAO:0000625", "document part": "IAO:0000314", "document title": "IAO:0000305", "copyright section": "IAO:0000330",
}

HEADINGS = [
    ("references section", "references|bibliography|literature cited|reference list|works cited"),
    ("keywords section", "keywords|key words|index terms"),
    ("abbreviations section", "abbreviations|list of abbreviations|abbreviations used|nomenclature|glossary"),
    ("textual abstract section", "abstract|summary|synopsis|background abstract"),
    ("availability section", "availability|data availability|data availability statement|code availability|availability of data"),
    ("acknowledgements section", "acknowledgements|acknowledgments|acknowledgement|acknowledgment"),
    ("funding source declaration section", "funding|financial support|funding statement|funding sources|grant support"),
    ("supplementary material section", "supplementary material|supplementary data|supporting information|supplemental data|appendix|additional file|additional files"),
    ("methods section", "methods|method|methodology|experimental procedures|experimental section|study design|procedures"),
    ("materials section / methods section", "materials and methods|material and methods|patients and methods"),
    ("author contributions section", "author contributions|authors contributions|contributions|contributors"),
    ("author information section", "author information|affiliations|about the authors"),
    ("introduction section", "introduction|background|objectives|aims"),
    ("results section", "results|findings|outcomes|observations"),
    ("discussion section", "discussion|general discussion|interpretation"),
    ("conclusion section", "conclusion|conclusions|concluding remarks|closing remarks"),
    ("conflict of interest section", "conflict of interest|conflicts of interest|competing interests|declaration of interest|disclosures"),
    ("consent section", "consent|informed consent|consent for publication"),
    ("ethical approval section", "ethics|ethics approval|ethical approval|ethics statement"),
    ("case report section", "case report|case presentation|case description"),
    ("figures section", "figures|figure legends|list of figures"),
    ("tables section", "tables|list of tables"),
    ("footnote section", "footnotes|notes|endnotes"),
    ("materials section", "materials|material|reagents|equipment"),
    ("statistical analysis section", "statistical analysis|statistics|statistical methods|data analysis"),
    ("study limitations section", "limitations|study limitations|strengths and limitations"),
    ("patients section", "patients|subjects|participants|study population"),
    ("related work section", "related work|previous work|literature review"),
    ("future directions section", "future work|future directions|outlook"),
    ("copyright section", "copyright|license|rights and permissions"),
]


Terms = dict[str, list[str]]


def _terms(pairs: list[tuple[str, str]]) -> Terms:
    """Term to headings, in the order in which terms first come; "a / b" files a heading under both."""
    out: Terms = {}
    for heading, term in pairs:
        for one in term.split("/")[:2]:
            out.setdefault(one.strip(), []).append(heading)
    return out


@cache
def default_ontology() -> tuple[dict[str, list[str]], dict[str, str]]:
    return _terms([(h, term) for term, headings in HEADINGS for h in headings.split("|")]), IDS


def read_ontology(headings_path: str, ids_path: str) -> tuple[dict[str, list[str]], dict[str, str]]:
    """From files of "heading<TAB>term" and "term<TAB>id"; lines without exactly two columns are skipped."""

    def pairs(path: str) -> list[tuple[str, str]]:
        with open(path, encoding="utf-8") as f:
            rows = [[x.strip() for x in line.rstrip("\n").split("\t")] for line in f]
        return [(a, b) for a, b in (r for r in rows if len(r) == 2) if a and b]

    return _terms([(h.lower(), t.lower()) for h, t in pairs(headings_path)]), {a.lower(): b for a, b in pairs(ids_path)}
