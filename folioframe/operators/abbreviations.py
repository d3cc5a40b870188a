"""Short forms and their long forms: from running text, and from lists that authors give."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators.bioc import ABBREVIATIONS, today

FULLTEXT, AUTHOR = "fulltext", "abbreviations section"
_QUOTES = regex.compile(rf"([(;:]){T.QUOTES}|{T.QUOTES}([);:])")
_SHORT = regex.compile(r"(?!\p{N}+$)(?!\p{Ll}+$)(?:[\p{L}\p{N}][.\-]?){2,10}")


def sentences(body: str) -> list[str]:
    """Parts between full stops, stripped."""
    return [s.strip() for s in body.split(".")]


def drop_quotes(s: str) -> str:
    """Quotes next to a parenthesis, semicolon or colon go."""
    return _QUOTES.sub(lambda m: (m[1] or "") + (m[2] or ""), s)


def is_short_form(s: str) -> bool:
    """2 to 10 letters or numbers, each with an optional dot or hyphen; neither all numbers nor all lower case."""
    return _SHORT.fullmatch(s) is not None


def candidates(sentence: str) -> list[tuple[str, str]]:
    """(short form, text before its parenthesis) of a sentence. A sentence with unbalanced parentheses, or a closing
    one first, has none. Inside, a closing parenthesis, a semicolon and a colon all end the short form."""
    signs = re.sub(r"[^()]", "", sentence)
    if 2 * signs.count("(") != len(signs) or signs.startswith(")"):
        return []
    s = drop_quotes(sentence)
    out, at = [], 0
    while (opened := s.find(" (", at)) >= 0:
        depth, i = 1, opened + 2
        while depth and i < len(s):
            depth += (s[i] == "(") - (s[i] in ");:")
            i += 1
        if depth:
            at = opened + 2
            continue
        at = i
        inner = s[opened + 2 : i - 1]
        if is_short_form(short := inner.strip()):
            out.append((short, s[: opened + 1 + len(inner) - len(inner.lstrip())]))
    return out


def definition(short: str, before: str) -> str | None:
    """The words before a short form, from the one that brings as many initials as the short form has of its first
    character; None unless they hold its characters."""
    words = regex.split(r"[\s\-]+", before[:-1].lower())
    initials = [w[0] for w in words if w]
    key = short[0].lower()
    needed = short.lower().count(key)
    places = [i for i, x in enumerate(initials) if x == key]
    if needed > len(places):
        return None
    first = places[-needed]
    long = before[len(" ".join(words[:first])) :].strip()
    return long if holds(short, long) else None


def holds(short: str, long: str) -> bool:
    """The characters of the short form come in the long form in order, the first one at the head of a word (Schwartz
    and Hearst, 2003, matched from the right); of the rest there are few enough words, in balanced parentheses."""
    if len(long) < len(short) or short in long.split():
        return False
    at = len(long)
    for k in range(len(short) - 1, -1, -1):
        c = short[k].lower()
        if not c.isalnum() and k:
            continue
        at -= 1
        while at >= 0 and (long[at].lower() != c or (k == 0 and at > 0 and long[at - 1].isalnum())):
            at -= 1
        if at < 0:
            return False
    rest = long[at:]
    return len(rest.split()) <= min(len(short) + 5, 2 * len(short)) and rest.count("(") == rest.count(")")


def document_pairs(bodies: list[str], given: list[dict]) -> list[dict]:
    """(short, long, algorithms) of one document from its paragraphs and the author's list. In a paragraph a short form's most
    common definition counts, of equally common ones the first; a later paragraph redefines it. Equal pairs have
    both origins, the author's first."""
    by_text: dict[str, str] = {}
    for body in bodies:
        seen: dict[str, dict[str, int]] = {}
        for s in sentences(body) if "(" in body else ():
            for short, before in candidates(s) if "(" in s else ():
                if (long := definition(short, before)) is not None:
                    counts = seen.setdefault(short, {})
                    counts[long] = counts.get(long, 0) + 1
        by_text |= {k: max(v, key=v.get) for k, v in seen.items()}
    out: dict[tuple[str, str], list[str]] = {(e["short"], e["long"]): [AUTHOR] for e in given}
    for pair in by_text.items():
        out.setdefault(pair, []).append(FULLTEXT)
    return [{"short": a, "long": b, "algorithms": x} for (a, b), x in out.items()]


def abbreviations_collection(found: Column, path: Column, date: Column | None = None) -> Column:
    """The collection of a document's (short, long, algorithms)."""
    shorts = F.array_distinct(F.transform(found, lambda e: e["short"]))
    clean = lambda s: F.replace(s, F.lit("\n"), F.lit(" "))

    def one(s: Column) -> Column:
        defs = F.filter(found, lambda e: e["short"] == s)
        numbered_ = F.flatten(F.transform(defs, lambda e, i: F.array(F.struct(F.concat(F.lit("text_long_"), i + 1).alias("key"), clean(e["long"]).alias("value")), F.struct(F.concat(F.lit("extraction_algorithm_"), i + 1).alias("key"), F.array_join(e["algorithms"], ", ").alias("value")))))
        return F.map_from_entries(F.concat(F.array(F.struct(F.lit("text_short").alias("key"), clean(s).alias("value"))), numbered_))

    doc = F.struct(path.alias("id"), path.alias("inputfile"), F.transform(shorts, one).alias("passages"))
    return F.struct(F.lit(ABBREVIATIONS[0]).alias("source"), (date if date is not None else today()).alias("date"), F.lit(ABBREVIATIONS[1]).alias("key"), F.array(doc).alias("documents"))
