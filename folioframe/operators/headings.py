"""Headings to section types by fuzzy lookup."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions.vectorized import indel_ratio
from folioframe.sources.ontology import default_ontology

TYPES = "array<struct<iao_name:string,iao_id:string>>"
UNKNOWN = ("document part", "IAO:0000314")
_NUMBER = re.compile(r"^\d*\s?[(.]\]?\s?")


def tokens_of(heading: str) -> str:
    """Lower case; runs of word characters and of other signs, with a blank between."""
    return " ".join(re.findall(r"\w+|[^\w\s]+", heading or "")).lower()


def strip_number(h: str) -> str:
    return _NUMBER.sub("", h)


def is_compound(h: str) -> bool:
    return " and " in h or "&" in h or "/" in h


def parts_of(h: str) -> list[str]:
    return [strip_number(p) for p in re.split(r"\s?[/&]\s?| and ", h)]


def match_heading(heading: str, ontology: tuple[dict[str, list[str]], dict[str, str]]) -> list[tuple[str, str]]:
    """Types of one heading. Compound ones are matched part by part at 80 or more, simple ones above 80; in either case
    the first term in the order of the dictionary is taken. Numbers before a heading peel off level by level."""
    terms, ids = ontology
    h = tokens_of(heading)
    found = []
    if h and is_compound(h):
        for part in parts_of(h):
            hit = next((t for t, known in terms.items() if any(indel_ratio(part, k) >= 80 for k in known)), None)
            if hit is not None:
                found.append(hit)
    elif h:
        for term, known in terms.items():
            h = strip_number(h)
            if any(indel_ratio(h, k) > 80 for k in known):
                found.append(term)
                break
    return [(t, ids.get(t, "")) for t in found] or [UNKNOWN]


class Types:
    """match_heading with a memory, since few headings make up most of a corpus."""

    def __init__(self, ontology=None):
        self.look = lru_cache(100_000)(lambda h: match_heading(h, ontology or default_ontology()))

    def of(self, heading: str) -> list[dict]:
        return [{"iao_name": a, "iao_id": b} for a, b in self.look(heading)]


def typed(headings: Column, ontology=None) -> Column:
    """Types of every heading of an array column. The dictionary goes with the function, a few KB; results are kept by
    each worker, since few headings make up most of a corpus."""
    ontology = ontology or default_ontology()

    @F.pandas_udf(f"array<{TYPES}>")
    def types(s: pd.Series) -> pd.Series:
        known = Types(ontology)
        return s.map(lambda hs: None if hs is None else [known.of(h) for h in hs])

    return types(headings)
