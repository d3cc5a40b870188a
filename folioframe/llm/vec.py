"""Array primitives over Arrow string buffers: words, hashes and n-grams of many documents at once.

A word is a maximal run of ASCII letters, digits, underscores and characters beyond ASCII, in lower case. Hashes
are 64-bit polynomials over random byte values, mixed afterwards; they don't depend on the batch a text is in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions.batches import CHUNK_BYTES, pieces, release  # noqa: F401
from folioframe.session import cut

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_MUL = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        full = np.full(size, base, np.uint64)
        full[0] = 1
        got = _powers[base] = np.multiply.accumulate(full)
    return got[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values (the finaliser of splitmix64)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores in front until no column of df has it (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def repeated_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id) of ids that several rows have, those whose rows have one text first, then those with different texts. Raises
    where ids aren't integers."""
    if (kind := docs.schema["doc_id"].dataType.simpleString()) not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"doc_id must be an integer column, not {kind}")
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    ids = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("low"), F.max(text).alias("high"))
    ids = cut(ids.where("n > 1").select("id", (F.col("low") == F.col("high")).alias("alike")))
    return ids.where("alike").select("id"), ids.where("NOT alike").select("id")


def comparable(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows whose id names one text, rows that have no id or share it with another text, ids of several rows of one text)."""
    again, torn = repeated_ids(docs)
    key = docs["doc_id"].cast("long")
    if torn.isEmpty():
        return docs.where(docs["doc_id"].isNotNull()), docs.where(docs["doc_id"].isNull()), again
    return docs.where(docs["doc_id"].isNotNull()).join(torn, key == torn["id"], "left_anti"), docs.where(docs["doc_id"].isNull()).unionByName(docs.join(torn, key == torn["id"], "left_semi")), again


def strings(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array without nulls (null becomes empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_string()) if col.type != pa.large_string() else col
    return pc.fill_null(col, "") if col.null_count else col


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (starting at 0) of a large_string array."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """Words of a string array: start and end bytes, document index and hash of each; data are the bytes in lower case."""

    __slots__ = ("data", "offs", "start", "end", "doc", "hash", "n_docs", "_sum")

    def __init__(self, col: pa.Array, lower: bool = True):
        self.data, self.offs = buffers(pc.utf8_lower(col) if lower else col)
        self.n_docs = len(self.offs) - 1
        n = len(self.data)
        inside = WORD[self.data]
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = inside
        after = np.empty(n + 1, bool)
        after[n:] = False
        after[:n] = inside
        before[self.offs] = False
        after[self.offs] = False
        self.start = np.flatnonzero(inside & ~before[:n])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.doc = np.searchsorted(self.offs, self.start, "right") - 1
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[self.data] * _pow(_BASE, n), out=total[1:])
        self._sum = total
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of any byte ranges; equal bytes give equal hashes."""
        if len(start) == 0:
            return np.zeros(0, np.uint64)
        return mix((self._sum[end] - self._sum[start]) * _pow(_INV, len(self.data) + 1)[start])

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def firsts(self) -> np.ndarray:
        """Index of the first word of each document, with the number of words at the end."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of byte ranges of data as they are; their length counts too."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _pow(_BASE, len(data)), out=total[1:])
    return mix((total[end] - total[start]) * _pow(_INV, len(data) + 1)[start] + (end - start).astype(np.uint64) * _MUL[0])


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word n-gram; a document of 1 to n-1 words has one gram, all its words."""
    h, doc = w.hash, w.doc
    total = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n if len(total) else 0):
        total += h[j : j + len(total)] * _MUL[j]
    whole = doc[: len(total)] == doc[n - 1 :] if len(total) else np.zeros(0, bool)
    short = np.flatnonzero((c := w.counts()) < n)
    short = short[c[short] > 0]
    docs, hashes = [doc[: len(total)][whole]], [total[whole]]
    if len(short):
        first = w.firsts()[short]
        s = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            has = c[short] > j
            s[has] += h[first[has] + j] * _MUL[j]
        docs.append(short)
        hashes.append(s ^ np.uint64(0x5DEECE66D))
    return np.concatenate(docs), mix(np.concatenate(hashes))


def distinct_by_doc(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value >> 16), sorted; doc is below 65536."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i]+length[i]-1 of all i, one after the other."""
    total = int(length.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))


class Slots:
    """Places of distinct 64-bit keys by open addressing; nothing is lost, whatever their number."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        self.mask = np.uint64((1 << max(4, int(2 * len(keys)).bit_length())) - 1)
        self.place = np.full(int(self.mask) + 1, -1, np.int32)
        at, todo = mix(self.keys, 3) & self.mask, np.arange(len(keys))
        while len(todo):
            free = todo[self.place[at[todo]] < 0]
            self.place[at[free]] = free
            todo = todo[self.place[at[todo]] != todo]
            at[todo] = (at[todo] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        if len(self.keys) == 0:
            return out
        at, todo = mix(keys, 3) & self.mask, np.arange(len(keys))
        while len(todo):
            got = self.place[at]
            same = (got >= 0) & (self.keys[got] == keys[todo])
            out[todo[same]] = got[same]
            go = (got >= 0) & ~same
            todo, at = todo[go], (at[go] + np.uint64(1)) & self.mask
        return out
