"""Extraction rules (JSON) compiled on the driver to expressions over a node array.

A rule is {"tag": regex or list, "attrs": {name: regex or list} or a list of such, "xpath": path or list}. Values are
matched whole. Tag and attributes hold together; xpath adds further matches; several rules of a section are
alternatives in order. Matches without text are dropped, of equal texts the first stays.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable



SECTIONS = ("title", "keywords", "references", "sections", "sub-sections", "paragraphs", "tables", "figures", "abbreviations-table")


def read_config(source: str | dict) -> dict:
    """The rules of a JSON file (or of a dict already read), checked so that mistakes show before any job."""
    raw = source if isinstance(source, dict) else json.loads(open(source, encoding="utf-8").read())
    if "config" not in raw:
        raise KeyError("config")
    config = raw["config"]
    for section, rules in config.items():
        for group in [rules.get("defined-by", []), *rules.get("data", {}).values()]:
            for rule in group:
                if not {"tag", "attrs", "xpath"} & set(rule):
                    raise ValueError(f"{section}: a rule needs tag, attrs or xpath: {rule}")
                check_patterns(rule)
                for path in _list(rule.get("xpath", [])):
                    xpath_steps(path)
    return config


def _list(x) -> list:
    return x if isinstance(x, list) else [x]


def anchored(pattern: str) -> str:
    pattern = pattern if pattern.startswith("^") else "^" + pattern
    return pattern if pattern.endswith("$") else pattern + "$"


def check_patterns(rule: dict) -> None:
    """Raises for patterns of tags and attributes that aren't regular expressions."""
    for p in [*_list(rule.get("tag") or []), *(q for a in _list(rule.get("attrs") or {}) for v in a.values() for q in _list(v))]:
        if not isinstance(p, str):
            raise ValueError(f"not a pattern: {p!r}")
        re.compile(p)


STEP = re.compile(r"(//?)([\w*-]+)((?:\[[^\]]*\])*)")
CONDITION = re.compile(r"""\[(?:@([\w-]+)\s*=\s*["']([^"']*)["']|contains\(\s*@([\w-]+)\s*,\s*["']([^"']*)["']\s*\)|@([\w-]+)|(\d+))\]""")


def xpath_steps(path: str) -> list[tuple[str, str, list[tuple]]]:
    """(axis, name, conditions) of each step; raises for what the subset leaves out."""
    steps, at = [], 0
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise ValueError(f"xpath not supported: {path}")
        conditions, k = [], 0
        while k < len(m[3]):
            c = CONDITION.match(m[3], k)
            if not c:
                raise ValueError(f"xpath condition not supported: {m[3]}")
            conditions.append(("is", c[1], c[2]) if c[1] else ("has", c[3], c[4]) if c[3] else ("set", c[5], "") if c[5] else ("nth", "", int(c[6])))
            k = c.end()
        steps.append((m[1], m[2], conditions))
        at = m.end()
    return steps


class Page:
    """A parsed document on a worker, with the same rules evaluated directly: for operators that nest them."""

    def __init__(self, flat: str, marked: str, nodes: list[dict]):
        self.flat, self.marked, self.nodes = flat, marked, nodes
        self._compiled: dict[int, Callable[[dict], bool] | None] = {}

    def text(self, n: dict) -> str:
        return self.flat[n["t0"] : n["t1"]]

    def marked_text(self, n: dict) -> str:
        return self.marked[n["m0"] : n["m1"]]

    def below(self, n: dict | None) -> list[dict]:
        return self.nodes if n is None else self.nodes[n["pre"] + 1 : n["last"] + 1]

    def find(self, tags: str | tuple[str, ...], within: dict | None = None) -> list[dict]:
        tags = (tags,) if isinstance(tags, str) else tags
        return [n for n in self.below(within) if n["tag"] in tags]

    def first(self, tag: str, within: dict | None = None, **attrs: str) -> dict | None:
        wanted = {k.replace("_", "-"): v for k, v in attrs.items()}
        return next((n for n in self.below(within) if n["tag"] == tag and all(n["attrs"].get(k) == v for k, v in wanted.items())), None)

    def matches(self, rule: dict) -> Callable[[dict], bool] | None:
        key = id(rule)
        if key not in self._compiled:
            self._compiled[key] = _matcher(rule)
        return self._compiled[key]

    def path(self, path: str) -> list[dict]:
        context: set[int] | None = None
        found: list[dict] = []
        for axis, name, conditions in xpath_steps(path):
            found = []
            for n in self.nodes:
                if name not in ("*", n["tag"]):
                    continue
                if axis == "/" and (n["parent"] != -1 if context is None else n["parent"] not in context):
                    continue
                if axis == "//" and context is not None and not self._under(n, context):
                    continue
                if all(self._holds(n, name, *c) for c in conditions):
                    found.append(n)
            context = {n["pre"] for n in found}
        return found

    def _under(self, n: dict, context: set[int]) -> bool:
        p = n["parent"]
        while p >= 0:
            if p in context:
                return True
            p = self.nodes[p]["parent"]
        return False

    def _holds(self, n: dict, name: str, kind: str, attr: str, value) -> bool:
        got = n["attrs"].get(attr)
        if kind == "is":
            return got == value
        if kind == "has":
            return got is not None and value in got
        if kind == "set":
            return got is not None
        first = self.nodes[n["parent"]]["pre"] + 1 if n["parent"] >= 0 else 0
        return sum(s["parent"] == n["parent"] and name in ("*", s["tag"]) for s in self.nodes[first : n["pre"] + 1]) == value

    def select(self, rules: list[dict], within: dict | None = None) -> list[dict]:
        """Matches with text, of equal texts the first."""
        out, seen = [], set()
        for rule in rules:
            test = self.matches(rule)
            found = [n for n in self.below(within) if test(n)] if test else []
            for path in _list(rule.get("xpath", [])):
                found += [n for n in self.path(path) if within is None or within["pre"] < n["pre"] <= within["last"]]
            for n in found:
                text = self.text(n)
                if text.strip() and text not in seen:
                    seen.add(text)
                    out.append(n)
        return out


def _matcher(rule: dict) -> Callable[[dict], bool] | None:
    if not rule.get("tag") and not rule.get("attrs"):
        return None
    tags = [re.compile(anchored(p)) for p in _list(rule.get("tag") or [])]
    groups = [[(k, [re.compile(anchored(p)) for p in _list(v)]) for k, v in a.items()] for a in _list(rule.get("attrs") or [])]

    def has(n: dict, name: str, patterns: list[re.Pattern]) -> bool:
        value = n["attrs"].get(name)
        if value is None:
            return False
        values = [value, *(value.split() if name == "class" else ())]
        return any(p.match(v) for p in patterns for v in values)

    def test(n: dict) -> bool:
        if tags and not any(p.match(n["tag"]) for p in tags):
            return False
        return not groups or any(all(has(n, k, ps) for k, ps in g) for g in groups)

    return test
