"""Toxicity: a factorization machine over hashed terms.

Terms of a document are its distinct words and the heads (4 and 6 bytes) of its longer words, the latter once for each of
LEVELS that the number of words with that head reaches, hashed to 2^18 buckets.
From a bounded sample of labelled rows (MAX_TOXIC toxic and MAX_CLEAN clean ones, the first in the order of a hash
of doc_id) the buckets are kept whose presence goes with toxic labels (G-test over G_MIN), and those for which that holds
among the rows that additive weights of these hold for toxic, though they may be as common in clean rows:
the group mention that only an insult makes toxic. On these a factorization
machine (bias, linear weights, RANK factors for pairwise interactions) is fitted by Adagrad on the logistic loss;
each pair of terms of a document counts, so an insult beside a group mention weighs more than the sum of the two.
The threshold is the one with the best F-score, precision counting twice, on a held-out quarter of the sample.

Every document is scored on its whole text in one pass without a shuffle; the model is a few hundred KB at any size.

Defined cases: a null or empty text has no terms, score 0 and is never toxic; a text without kept terms likewise; labels that are null count as unlabelled; several labels of one doc_id: toxic wins;
with fewer than two classes among the labels nothing is toxic (score 0); repeated rows are scored alike, each on its
own; an empty table gives an empty result; extra columns are not read by toxicity() and pass through keep_clean().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm import vec

BITS = 18
RANK = 6
MAX_TOXIC = 4_000
MAX_CLEAN = 8_000
G_MIN = 16.0
EPOCHS = 120
HEADS = (4, 6)
LEVELS = (1, 2, 3, 5, 8)


def term_buckets(w: vec.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each word, and of each head of longer words once for every level that its count reaches."""
    size = w.end - w.start
    doc, hashes = [w.doc], [w.hash]
    for i, head in enumerate(HEADS):
        longer = size > head
        h = vec.mix(w.span_hash(w.start[longer], w.start[longer] + head), i + 1)
        key, count = np.unique((w.doc[longer].astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)), return_counts=True)
        for level in LEVELS:
            often = key[count >= level]
            doc.append((often >> np.uint64(48)).astype(np.int64))
            hashes.append(vec.mix(often << np.uint64(16), 10 * level + i))
    return np.concatenate(doc), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    place: np.ndarray  # of each bucket: its feature, or -1
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    threshold: float

    def raw(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Logits of n documents from their distinct (doc, feature)."""
        if len(self.linear) == 0:
            return np.full(n, self.bias)
        out = self.bias + np.bincount(doc, self.linear[feature], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[feature, f]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        w = vec.Words(texts)
        doc, bucket = term_buckets(w)
        place = self.place[bucket]
        hit = place >= 0
        width = max(1, len(self.linear))
        key = np.unique(doc[hit].astype(np.int64) * width + place[hit])
        doc, feature = key // width, key % width
        prob = 1 / (1 + np.exp(-np.clip(self.raw(doc, feature, w.n_docs), -30, 30)))
        found = np.bincount(doc, minlength=w.n_docs) > 0
        return np.where(found, prob, 0.0)


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in vec.pieces(batches):
        doc, bucket = term_buckets(vec.Words(vec.strings(b.column("text"))))
        key = np.unique((doc << BITS) | bucket)
        lengths = np.bincount(key >> BITS, minlength=b.num_rows)
        yield pa.record_batch([b.column("toxic"), b.column("h"), vec.list_array((key & ((1 << BITS) - 1)).astype(np.int32), lengths, pa.int32())], ["toxic", "h", "terms"])


def g_test(n1: np.ndarray, n0: np.ndarray, all1: int, all0: int) -> np.ndarray:
    """G statistic of the two-by-two table of presence against label."""
    n, total = n1 + n0, all1 + all0
    out = np.zeros(len(n1))
    for seen, group in ((n1, all1), (n0, all0)):
        for got, expected in ((seen, n * group / total), (group - seen, (total - n) * group / total)):
            out += 2 * np.where(got > 0, got * np.log(np.maximum(got, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return out


def beside(kept: np.ndarray, row: np.ndarray, flat: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Buckets that go with toxic labels among the rows that are toxic by the sum of the log odds of the kept ones, as nine
    in ten of the toxic rows are; (row, flat): distinct row and bucket."""
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    which = place[flat]
    at, which = row[which >= 0], which[which >= 0]
    n1, n0 = np.bincount(which[y[at] == 1], minlength=len(kept)), np.bincount(which[y[at] == 0], minlength=len(kept))
    odds = np.log((n1 + 0.5) / ((y == 1).sum() + 1)) - np.log((n0 + 0.5) / ((y == 0).sum() + 1))
    total = np.bincount(at, odds[which], len(y))
    held = (total > 0) & (total >= np.quantile(total[y == 1], 0.1))
    all1, all0 = int((held & (y == 1)).sum()), int((held & (y == 0)).sum())
    if min(all1, all0) < 3:
        return kept[:0]
    n1 = np.bincount(flat[held[row] & (y[row] == 1)], minlength=1 << BITS).astype(float)
    n0 = np.bincount(flat[held[row] & (y[row] == 0)], minlength=1 << BITS).astype(float)
    return np.flatnonzero((g_test(n1, n0, all1, all0) > G_MIN) & (n1 / all1 > n0 / all0) & (n1 >= 3))


def fit_rows(terms: list[np.ndarray], y: np.ndarray, seed: int = 5) -> Model:
    """Fit on distinct buckets per row; every fourth row is held out for the threshold."""
    none = Model(np.full(1 << BITS, -1, np.int32), -20.0, np.zeros(0), np.zeros((0, RANK)), 0.5)
    if len(y) == 0 or y.min() == y.max():
        return none
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    row = np.repeat(np.arange(len(y)), [len(t) for t in terms])
    flat = np.concatenate(terms) if len(terms) else np.zeros(0, np.int64)
    train = ~held[row]
    n1 = np.bincount(flat[train & (y[row] == 1)], minlength=1 << BITS).astype(float)
    n0 = np.bincount(flat[train & (y[row] == 0)], minlength=1 << BITS).astype(float)
    all1, all0 = int((y[~held] == 1).sum()), int((y[~held] == 0).sum())
    g = g_test(n1, n0, all1, all0)
    kept = np.flatnonzero((g > G_MIN) & (n1 / all1 > n0 / all0) & (n1 >= 3))
    kept = np.union1d(kept, beside(kept, row[train], flat[train], np.where(held, -1, y)))
    if len(kept) == 0:
        kept = np.flatnonzero((g >= np.partition(g, -1)[-1]) & (n1 + n0 > 0))
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    feature = place[flat]
    row, feature = row[feature >= 0], feature[feature >= 0]
    order = np.argsort(row, kind="stable")
    row, feature = row[order], feature[order]
    first = np.searchsorted(row, np.arange(len(y) + 1))

    rng = np.random.default_rng(seed)
    d = len(kept)
    bias, linear, factors = np.array([np.log(all1 / all0)]), np.zeros(d), rng.normal(0, 0.05, (d, RANK))
    state = [np.full_like(p, 1e-6) for p in (bias, linear, factors)]
    rows = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        rng.shuffle(rows)
        for part in np.array_split(rows, max(1, len(rows) // 256)):
            size = first[part + 1] - first[part]
            local, feat = np.repeat(np.arange(len(part)), size), feature[vec.ragged(first[part], size)]
            v = factors[feat]
            sums = np.zeros((len(part), RANK))
            np.add.at(sums, local, v)
            squares = np.bincount(local, (v * v).sum(1), len(part))
            z = bias[0] + np.bincount(local, linear[feat], len(part)) + 0.5 * ((sums**2).sum(1) - squares)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            used = np.unique(feat)
            g_linear = np.bincount(feat, err[local], d)
            g_factors = np.zeros((d, RANK))
            np.add.at(g_factors, feat, err[local][:, None] * (sums[local] - v))
            g_linear[used] += 1e-4 * linear[used]
            g_factors[used] += 1e-3 * factors[used]
            for p, s, gr in zip((bias, linear, factors), state, (np.array([err.sum()]), g_linear, g_factors), strict=True):
                s += gr * gr
                p -= 0.2 * gr / np.sqrt(s)
    model = Model(place, float(bias[0]), linear, factors, 0.5)
    judge = held if held.any() else ~held
    z = model.raw(row, feature, len(y))[judge]
    found = np.bincount(row, minlength=len(y))[judge] > 0
    p, t = np.where(found, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0), y[judge]
    grid = np.linspace(0.05, 0.95, 19)
    # F-score that counts precision twice: clean documents are to stay
    f1 = [1.25 * ((p >= c) & (t == 1)).sum() / max(1e-9, (p >= c).sum() + 0.25 * (t == 1).sum()) for c in grid]
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
    model.threshold = float(grid[best[np.argmin(np.abs(grid[best] - 0.5))]])
    return model


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on a bounded, hash-ordered sample of the labelled rows; its size is given by the two parameters."""
    lab = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    lab = lab.withColumn("h", F.xxhash64("doc_id"))
    picked = [lab.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(m) for c, m in ((1, max_toxic), (0, max_clean))]
    picked = picked[0].unionByName(picked[1])
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text")).join(F.broadcast(picked), F.col("_id") == F.col("doc_id"))
    table = rows.select("text", "toxic", "h").mapInArrow(_terms_of, "toxic int, h long, terms array<int>").toArrow().sort_by([("h", "ascending")])
    y = table.column("toxic").to_numpy().astype(np.int64)
    terms = pa.concat_arrays(table.column("terms").chunks) if table.num_rows else pa.array([], pa.list_(pa.int32()))
    offs = terms.offsets.to_numpy()
    flat = terms.values.to_numpy()
    return fit_rows([flat[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)], y)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and toxic (boolean) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in vec.pieces(batches):
            s = m.scores(vec.strings(b.column("text")))
            yield pa.record_batch([b.column("doc_id"), pa.array(s), pa.array((s >= m.threshold) & (len(m.linear) > 0))], ["doc_id", "score", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, toxic boolean")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model finds toxic, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in vec.pieces(batches):
            s = m.scores(vec.strings(b.column(b.schema.get_field_index("text"))))
            yield b.filter(pa.array((s < m.threshold) | (len(m.linear) == 0)))

    return docs.mapInArrow(keep, docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and decision for every document, by a model fitted on the labels table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, fit(docs, labels))
