"""Rule sets that come with the library, by name; our own, for common layouts of article pages."""

from __future__ import annotations

from functools import cache

from folioframe.plans.rules import read_config


def _tag(pattern: str, cls: str | None = None) -> dict:
    return {"tag": pattern} | ({"attrs": {"class": cls}} if cls else {})


def _class(pattern: str) -> dict:
    return {"attrs": {"class": pattern}}


def _path(xpath: str) -> dict:
    return {"xpath": xpath}


def _section(*rules: dict, **data: list[dict]) -> dict:
    return {"data": {k.replace("_", "-"): v for k, v in data.items()}, "defined-by": list(rules)}


def _headed(*rules: dict) -> dict:
    return _section(*rules, headers=[_tag("h2")])


def _layout(**changes: dict) -> dict:
    base = {
        "title": _section(_tag("h1")),
        "keywords": _section(_class("kwd-group|kwd-text|keywords")),
        "sections": _headed(_tag("section|div", "section|sec|tsec")),
        "sub-sections": _section(_tag("section|div", "subsection|sub-section|sec"), headers=[_tag("h[3-6]")]),
        "paragraphs": _section(_tag("p")),
        "tables": _section(
            _tag("div|section", "table-wrap|tw|table-container"),
            title=[_tag("h3|caption"), _class("table-title|title")],
            caption=[_class("caption")],
            footer=[_class("tblwrap-foot|table-footer|footer")],
            header_element=[_tag("th")],
        ),
        "figures": _section(_tag("figure|div", "fig|figure")),
        "references": _section(_tag("li|div", "ref-cit-blk|ref|reference"), _tag("li"), title=[_class("ref-title")], journal=[_class("ref-journal")], volume=[_class("ref-vol|ref-volume")]),
        "abbreviations-table": _section(_tag("table")),
    }
    return base | changes


_LAYOUTS = {
    "GENERIC": lambda: _layout(),
    # pages without sections of their own: paragraphs below article
    "WEB_PAGE": lambda: _layout(keywords=_section(_path("//nav//a")), sections=_headed(_tag("article"))),
    "LEGACY_PMC": lambda: _layout(sections=_headed(_tag("div", "tsec"), _path('//div[contains(@class,"tsec")]'))),
    "PMC": lambda: _layout(sections=_headed(_tag("section", "abstract|body|ref-list|main-article-body"), _path('//section[contains(@class,"body")]/section'))),
    "PLOS_GENETICS": lambda: _layout(sections=_headed(_tag("div", "section|abstract"))),
    "NATURE_GENETICS": lambda: _layout(sections=_headed(_tag("div", "c-article-section"), _tag("section"))),
}
NAMES = tuple(_LAYOUTS)


@cache
def default_config(name: str) -> dict:
    """The rule set of that name, checked; KeyError for another."""
    return read_config({"config": _LAYOUTS[name]()})
