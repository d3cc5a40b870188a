"""Arrow-batched functions for what Spark has no expression for. Workers import this module too, where there is no
session, so the functions are made when they are called."""

from __future__ import annotations

import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from folioframe.functions.batches import DOCUMENT_BYTES, pieces


def nfkd(x: str) -> str:
    """Compatibility decomposition."""
    return unicodedata.normalize("NFKD", x)


def indel_ratio(a: str, b: str) -> int:
    """Similarity of 0 to 100: twice the longest common subsequence over both lengths, rounded; 0 if one is empty."""
    if not a or not b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    # bit-parallel longest common subsequence: one integer holds a row of the table
    full = (1 << len(b)) - 1
    places: dict[str, int] = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | (1 << i)
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(b) - row.bit_count()
    return int(100 * (2 * common) / (len(a) + len(b)) + 0.5)


def declared_xml(x: str | None) -> bool:
    """Well-formed XML that begins with a declaration."""
    x = (x or "").lstrip("\ufeff \t\r\n")
    if not x.startswith("<?xml"):
        return False
    try:
        ET.fromstring(x.encode() if "encoding" in x[:200] else x)
    except (ET.ParseError, ValueError, LookupError):
        return False
    return True


def is_declared_xml(c: Column | str) -> Column:
    return applied(declared_xml, c, "boolean", False)


def applied(f: Callable, c: Column | str, kind: str = "string", null=None) -> Column:
    """A function of a string, as the passes over whole documents use it, on a column; null stays null, or what is given for it.
    The strings of a piece of a batch are in memory at once, the others as Arrow has them."""
    made = to_arrow_type(StructType.fromDDL(f"x {kind}")["x"].dataType)

    @F.arrow_udf(kind)
    def run(s: pa.Array) -> pa.Array:
        out = [pa.array([null if (y := x.as_py()) is None else f(y) for x in piece.column(0)], made) for piece in pieces(iter([pa.RecordBatch.from_arrays([s], names=["s"])]), "s", DOCUMENT_BYTES)]
        return pa.concat_arrays(out) if out else pa.array([], made)

    return run(c)
