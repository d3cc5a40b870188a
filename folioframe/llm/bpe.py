"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

encode() splits texts by the pattern of byte-level vocabularies (one that splits otherwise raises) and hands only strings that the worker hasn't met yet to the
library, in batches; merges never cross these strings, so the ids equal those of the whole text. Offsets come from
the byte lengths of the tokens and are mapped to characters: a token that begins or ends within a character (a
character split over tokens) covers that whole character, so offsets of neighbours may overlap there. decode()
concatenates the bytes that the byte-to-character table gives for each id; characters split over tokens come
together again, and a sequence cut within a character gives U+FFFD for the bytes that are left over.

Special tokens in a text are ordinary text. The vocabulary file is read once by the driver and sent with the job (about
1.5 MB, whatever the input).

Defined cases: null or empty text gives no tokens (and decodes to the empty string); a null id list decodes to null,
an id beyond the vocabulary raises; repeated rows are encoded alike; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from folioframe.llm import vec

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII alone, for which the standard library's faster engine will do.
ASCII_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?(?:[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]+)|\s+(?!\S)|\s+"
#: Strings, and their characters, that a worker remembers before it starts anew; a matter of memory, not of results.
REMEMBERED = 500_000
REMEMBERED_CHARS = 8 << 20
#: Strings handed to the library at once; what it returns takes about a KB each until the ids are taken out.
AT_ONCE = 2_048


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def check_byte_level(made: dict) -> None:
    """Raise unless a vocabulary splits by PATTERN and merges bytes, as this module does."""
    split, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    fine = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not made.get("normalizer")
    if not fine or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        raise ValueError("not a byte-level BPE vocabulary with the usual split pattern")


class Codec:
    """Encoder and decoder of one vocabulary, with the strings that this process has met."""

    def __init__(self, vocabulary: str):
        check_byte_level(json.loads(vocabulary))
        # a worker has one core; threads of the library would each keep memory of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.split, self.split_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall
        table = byte_table()
        vocab = json.loads(vocabulary)["model"]["vocab"] | {t["content"]: t["id"] for t in json.loads(vocabulary).get("added_tokens", [])}
        special = {t["content"] for t in json.loads(vocabulary).get("added_tokens", [])}
        pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            pieces[i] = token.encode() if token in special else bytes(table[c] for c in token)
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self._forget()

    def _forget(self) -> None:
        fresh = self.fresh = []

        class Codes(dict):
            def __missing__(self, key: str) -> int:
                n = self[key] = len(self)
                fresh.append(key)
                return n

        self.codes, self.chars = Codes(), 0
        self.ids, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self.codes) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
        code = self.codes.__getitem__
        parts = [np.fromiter(map(code, (self.split_ascii if t.isascii() else self.split)(t)), np.int32) for t in texts]
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        if self.fresh:
            ids, lengths = [self.ids], [self.lengths]
            for lo in range(0, len(self.fresh), AT_ONCE):
                new = [e.ids for e in self.tokenizer.encode_batch(self.fresh[lo : lo + AT_ONCE], add_special_tokens=False)]
                lengths.append(np.fromiter(map(len, new), np.int64, len(new)))
                ids.append(np.fromiter(chain.from_iterable(new), np.int32, int(lengths[-1].sum())))
            self.ids, self.lengths = np.concatenate(ids), np.concatenate(lengths)
            self.chars += sum(map(len, self.fresh))
            self.fresh.clear()
        start = np.cumsum(self.lengths) - self.lengths
        size = self.lengths[codes]
        doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        return self.ids[vec.ragged(start[codes], size)], np.bincount(doc, size, len(texts)).astype(np.int64)

    def offsets(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character at which each token starts and ends (exclusive) in its text."""
        size = self.size[ids]
        end = np.cumsum(size)
        start = end - size
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = np.repeat(chars[offs[:-1]], counts)
        return (chars[start + 1] - 1 - base).astype(np.int32), (chars[end] - base).astype(np.int32)

    def raw(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise ValueError("an id is beyond the vocabulary")
        return self.bytes[vec.ragged(self.first[ids], self.size[ids])]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        data = self.raw(ids).tobytes()
        ends = np.cumsum(np.concatenate([[0], self.size[ids]]))[np.concatenate([[0], np.cumsum(counts)])]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


_codecs: dict[int, Codec] = {}


def codec(vocabulary: str) -> Codec:
    """The codec of this process for a vocabulary; only the latest is kept."""
    key = hash(vocabulary)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids, starts, ends (characters, end exclusive) and round_trip: decoding gave the text again."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(_read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary.value)
        for b in vec.pieces(batches, limit=1 << 20):
            texts = vec.strings(b.column("text"))
            data, offs = vec.buffers(texts)
            ids, counts = c.encode(texts.to_pylist())
            starts, ends = c.offsets(ids, counts, data, offs)
            # whole texts come back when the bytes do, and do so at the same borders
            back = c.raw(ids)
            borders = np.concatenate([[0], np.cumsum(c.size[ids])])[np.concatenate([[0], np.cumsum(counts)])]
            if len(back) == len(data) and (back == data).all():
                same = (borders[1:] == offs[1:]) & (borders[:-1] == offs[:-1])
            else:
                same = np.array([d == t for d, t in zip(c.decode(ids, counts), texts.to_pylist(), strict=True)])
            lists = [vec.list_array(x, counts, pa.int32()) for x in (ids, starts, ends)]
            yield pa.record_batch([b.column("doc_id"), pa.array(counts.astype(np.int32)), *lists, pa.array(same)], ["doc_id", "n_tokens", "ids", "starts", "ends", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens int, ids array<int>, starts array<int>, ends array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and the text of each row of (doc_id, ids)."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(_read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary.value)
        for b in batches:
            col = b.column("ids")
            counts = np.array([0 if x is None else x for x in pa.compute.list_value_length(col).to_pylist()], np.int64)
            ids = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [None if null else t for t, null in zip(c.decode(ids, counts), col.is_null().to_pylist(), strict=True)]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids, offsets and the outcome of decoding for every document."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
