r"""Text expressions, all evaluated by Spark itself.

White space, where stripped, is that of Unicode (`\s` and separators), since article text is full of no-break spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = r"^[\s\p{Z}\x{85}\x1C-\x1F]+|[\s\p{Z}\x{85}\x1C-\x1F]+$"
#: Left and right quotes, and the plain ones.
QUOTES = r"""["'\p{Pi}\p{Pf}]"""
DASHES = "[–−-]"


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE, "")


def clean_unicode(c: Column) -> Column:
    """No-break space to blank, soft hyphen and U+2010 to a hyphen, multiplication sign to x."""
    return F.translate(c, " ­‐×", " --x")


# cells


def clean_cell(c: Column) -> Column:
    """Stripped, thin and other white space to blanks, leftovers of span and hr dropped, one outer pair of parentheses."""
    c = F.regexp_replace(strip(c), r"[\s  ]", " ")
    c = F.regexp_replace(F.replace(c, F.lit("&#x000a0;"), F.lit(" ")), r"<(?:/?span|hr/)[^>\n]*>?", "")
    return F.when(F.startswith(c, F.lit("(")) & F.endswith(c, F.lit(")")) & (F.length(c) > 1), F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def normal_p_value(c: Column) -> Column:
    """a x 10-b (any cross, any dash) and a e - b to ae-b."""
    cross = c.rlike(rf"^(\d+\.\d+|\d+)\s?[*×xX]\s?10_?{DASHES}\d+")
    c = F.when(cross, F.replace(F.regexp_replace(c, r"\s?[*×xX]\s?10_?", "e"), F.lit("−"), F.lit("-"))).otherwise(c)
    exp = c.rlike(rf"^(\d+.\d+|\d+)\s?[eE]\s?{DASHES}\s?\d+")
    return F.when(exp, F.regexp_replace(F.regexp_replace(c, rf"\s?{DASHES}\s?", "-"), r"\s?[eE]", "e")).otherwise(c)


NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def number_of(c: Column) -> Column:
    """The number that a cell holds (any minus, commas dropped), or null."""
    c = F.replace(F.translate(strip(c), "−–", "--"), F.lit(","), F.lit(""))
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def is_number(c: Column) -> Column:
    return F.replace(strip(c), F.lit(","), F.lit("")).rlike(NUMBER)


def has_digit(c: Column) -> Column:
    return c.rlike(r"\p{Nd}")


def cell_kind(c: Column) -> Column:
    """num, mix (digits and others), txt, or none for what is left out of account."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.isin("none", "", "-"), "none").when(is_number(low), "num").when(has_digit(low), F.when(low.rlike(r"^\p{Nd}+$"), "num").otherwise("mix")).otherwise("txt")


def column_kind(cells: Column) -> Column:
    """Majority of the kinds of an array of cells; ties go to num, then txt, then mix."""
    count = lambda ks, kind: F.size(F.filter(ks, lambda x: x == kind)).alias(kind)
    counts = let(F.transform(cells, cell_kind), lambda ks: F.struct(*[count(ks, kind) for kind in ("num", "txt", "mix")]))
    return let(counts, lambda n: F.when((n["num"] >= n["txt"]) & (n["num"] >= n["mix"]), "num").when(n["txt"] >= n["mix"], "txt").otherwise("mix"))


def is_superrow(cells: Column) -> Column:
    """One distinct value besides blanks, beginning with a letter."""
    left = F.array_distinct(F.filter(cells, lambda x: ~x.isin("", "\n", "None")))
    return (F.size(left) == 1) & F.coalesce(F.get(left, F.lit(0)).rlike("^[a-zA-Z]"), F.lit(False))


def merged_header(rows: Column) -> Column:
    """Rows of a header joined by column with a bar, bars at the end trimmed."""
    columns = F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1)
    return F.transform(columns, lambda i: F.regexp_replace(F.array_join(F.transform(rows, lambda r: F.get(r, i)), "|"), r"\|+$", ""))


# file names


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def document_id(path: Column) -> Column:
    """The file name up to its first dot."""
    return F.split_part(file_name(path), F.lit("."), F.lit(1))


def input_kind(path: Column) -> Column:
    """linked_tables, main_text or empty, by the name of the file."""
    name = file_name(path)
    linked = name.rlike(r"_table_\d+\.html?$") | name.rlike(r"^table_.*\.html$")
    known = suffix(path).isin(".html", ".htm", ".xml", ".pdf", ".docx", ".doc", ".xlsx", ".xls")
    return F.when(linked, "linked_tables").when(known, "main_text").otherwise("")


def base_key(path: Column) -> Column:
    """What an article and its linked tables have in common."""
    return F.regexp_replace(F.regexp_replace(path, r"_table_\d+\.html?$", ""), r"\.html?$", "")


def linked_table_id(path: Column) -> Column:
    return F.regexp_extract(path, r"_table_(\d+)\.html?$", 1)


def file_type(path: Column, well_formed: Column) -> Column:
    """By suffix; html, htm and xml are XML when the content is well-formed and declared, else HTML."""
    s = suffix(path)
    return F.when(s.isin(".html", ".htm", ".xml"), F.when(well_formed, "XML").otherwise("HTML")).when(s == ".pdf", "PDF").when(s.isin(".docx", ".doc"), "WORD").when(s.isin(".xlsx", ".xls"), "EXCEL").otherwise("UNKNOWN")
