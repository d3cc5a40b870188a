"""Language identification by words first, then shorter and shorter character n-grams.

From a bounded sample of labelled rows (SAMPLE a language, first in the order of a hash of doc_id) come the
per-language log frequencies of words seen at least twice and of character n-grams of 5 to 1 characters within words.
A known word adds its log frequency in each language. An unseen word adds the mean log frequency of its 5-grams
that are known, or else of its 4-grams, and so on to single characters; if nothing is known it adds nothing. The
language with the largest sum wins, ties going to the first in alphabetical order.

One pass over whole texts, no shuffle. What is broadcast are the entries of the sample, which is bounded, and so doesn't
grow with the input; none of them is lost. The sample of a language ends at a cutoff of the hash, found among the about
2 * SAMPLE ids that a share by the number of its ids lets through, so no task holds all ids of a language.

Defined cases: null or empty text, or one in which no word or n-gram is known, is "und" with margin 0; null labels
are not learnt from; with no labelled rows all is "und"; repeated rows are labelled alike, each on its own; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm import vec

SAMPLE = 3_000
LONGEST = 5
#: Beyond this number of languages their cutoffs are joined by a shuffle instead of a broadcast.
BROADCAST_LANGUAGES = 10_000


def char_grams(w: vec.Words, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in words, hash) of every n-gram of characters within the given words."""
    lead = (w.data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    at = np.concatenate([np.flatnonzero(lead), [len(w.data)]])
    first, last = chars[w.start[words]], chars[w.end[words]]
    many = np.maximum(last - first - n + 1, 0)
    c = vec.ragged(first, many)
    return np.repeat(np.arange(len(words)), many), vec.mix(w.span_hash(at[c], at[c + n]), n)


class Table:
    """Log frequencies of hashed entries in each language."""

    def __init__(self, hashes: np.ndarray, lang: np.ndarray, count: np.ndarray, n_langs: int):
        entries, which = np.unique(hashes, return_inverse=True)
        counts = np.zeros((len(entries), n_langs))
        np.add.at(counts, (which, lang), count)
        self.slots = vec.Slots(entries)
        totals = counts.sum(0)
        self.logs = (np.log(counts + 0.1) - np.log(totals + 0.1 * max(1, len(entries)))).astype(np.float32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of logs of each hash, or -1."""
        return self.slots.find(hashes)


class Model:
    def __init__(self, langs: list[str], words: Table, grams: dict[int, Table]):
        self.langs, self.words, self.grams = langs, words, grams

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(documents x languages, words that counted)."""
        w = vec.Words(texts)
        k = len(self.langs)
        total, used = np.zeros((w.n_docs, k)), np.zeros(w.n_docs, np.int64)
        if k == 0 or len(w.hash) == 0:
            return total, used
        row = self.words.find(w.hash)
        known = np.flatnonzero(row >= 0)
        self._add(total, used, w.doc[known], self.words.logs[row[known]])
        rest = np.flatnonzero(row < 0)
        for n in range(LONGEST, 0, -1):
            if len(rest) == 0:
                break
            of, h = char_grams(w, rest, n)
            row = self.grams[n].find(h)
            of, row = of[row >= 0], row[row >= 0]
            many = np.bincount(of, minlength=len(rest))
            got = np.flatnonzero(many)
            mean = np.stack([np.bincount(of, self.grams[n].logs[row, j], len(rest))[got] / many[got] for j in range(k)], 1)
            self._add(total, used, w.doc[rest[got]], mean)
            rest = rest[many == 0]
        return total, used

    @staticmethod
    def _add(total: np.ndarray, used: np.ndarray, doc: np.ndarray, values: np.ndarray) -> None:
        for j in range(total.shape[1]):
            total[:, j] += np.bincount(doc, values[:, j], len(total))
        used += np.bincount(doc, minlength=len(total))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Word and n-gram frequencies of a bounded sample of labelled rows per language (lang)."""
    named = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL")
    ids = named.select("lang", F.xxhash64("doc_id").alias("h"))
    shares = ids.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    few = shares.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    sent = F.broadcast if few else lambda df: df
    through = F.shiftrightunsigned("h", 11).cast("double") / F.lit(2.0**53) < F.lit(2.0 * sample) / F.col("n")
    least = F.slice(F.sort_array(F.collect_set(F.shiftrightunsigned("h", 11))), 1, sample)
    cutoffs = ids.join(sent(shares), "lang").where(through).groupBy("lang").agg(F.element_at(least, -1).alias("cutoff"))
    rows = named.select("doc_id", "lang", "text").join(sent(cutoffs), "lang").where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) <= F.col("cutoff")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vec.pieces(batches):
            w = vec.Words(vec.strings(b.column("text")))
            lang, code = np.unique(np.array(b.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            for n in range(LONGEST + 1):
                of, h = (np.arange(len(w.hash)), w.hash) if n == 0 else char_grams(w, np.arange(len(w.hash)), n)
                for c, name in enumerate(lang):
                    values, many = np.unique(h[code[w.doc[of]] == c], return_counts=True)
                    yield pa.record_batch([pa.array([str(name)] * len(values), pa.string()), pa.array(np.full(len(values), n, np.int32)), pa.array(values.view(np.int64)), pa.array(many)], ["lang", "n", "h", "c"])

    counted = rows.mapInArrow(count, "lang string, n int, h long, c long").groupBy("lang", "n", "h").agg(F.sum("c").alias("c"))
    # words met once in the sample count as unseen; n-grams stay from 2 on as well, single characters always
    table = counted.where("c > 1 OR n = 1").toArrow()
    names = table.column("lang").to_pylist()
    langs = sorted(set(names))
    lang = np.array([{x: i for i, x in enumerate(langs)}[x] for x in names], np.int64)
    n, c = table.column("n").to_numpy(), table.column("c").to_numpy()
    h = table.column("h").to_numpy().view(np.uint64) if table.num_rows else np.zeros(0, np.uint64)
    made = [Table(h[n == k], lang[n == k], c[n == k], max(1, len(langs))) for k in range(LONGEST + 1)]
    return Model(langs, made[0], dict(enumerate(made[1:], 1)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, margin (per word, of the best language over the second) and n_words (that counted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for b in vec.pieces(batches):
            total, used = m.scores(vec.strings(b.column("text")))
            best = np.where(used > 0, total.argmax(1) if len(m.langs) else 0, len(m.langs))
            ranked = np.sort(total, 1)
            margin = (ranked[:, -1] - ranked[:, -2]) / np.maximum(used, 1) if len(m.langs) > 1 else np.zeros(len(used))
            yield pa.record_batch([b.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(margin), pa.array(used.astype(np.int32))], ["doc_id", "lang_pred", "margin", "n_words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, margin double, n_words int")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of the sample's labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
