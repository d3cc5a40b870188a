"""Text with tables of bars (as rendered pages have them): lines, islands of table lines, grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions import text as T


def row_cells(line: Column) -> Column:
    """Cells between bars, stripped, without those of bars and dashes alone."""
    return F.filter(F.transform(F.split(line, r"\|"), T.strip), lambda c: (c != "") & ~c.rlike(r"^[|\p{Pd}]+$"))


def is_rule(line: Column) -> Column:
    return F.regexp_replace(line, r"[\s|:]", "").rlike(r"^\p{Pd}+$")


def split_text(text: Column) -> Column:
    """(text, grids) of one document in one row: lines of text joined by blank lines, and the tables, ragged rows padded;
    a table at the end of the text counts."""
    rows = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    prose = F.array_join(F.filter(rows, lambda x: ~F.contains(x, F.lit("|"))), "\n\n")
    start = F.struct(F.array().cast("array<array<array<string>>>").alias("out"), F.lit(False).alias("open"))

    def add(s: Column, line: Column) -> Column:
        bar = F.contains(line, F.lit("|"))
        cells = row_cells(line)
        fresh = F.array_append(s["out"], F.when(is_rule(line), F.array().cast("array<array<string>>")).otherwise(F.array(cells)))
        last = F.try_element_at(s["out"], F.lit(-1))
        grown = F.concat(F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(F.array_append(last, cells)))
        out = F.when(~bar, s["out"]).when(~s["open"], fresh).when(is_rule(line), s["out"]).otherwise(grown)
        return F.struct(out.alias("out"), bar.alias("open"))

    grids = F.filter(F.aggregate(rows, start, add)["out"], lambda g: F.size(g) > 0)
    return F.struct(prose.alias("text"), F.transform(grids, padded).alias("grids"))


def padded(grid: Column) -> Column:
    width = F.array_max(F.transform(grid, F.size))
    return F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
