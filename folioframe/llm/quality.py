"""Quality rules: an isolation forest on rule statistics.

Each document gets RULES, statistics that quality rules are made of (word length, shares of letters, digits, signs and
capitals, repeated words and lines, bars, doubled signs), shrunk to typical values where a text has few words, since
a short text isn't odd for being short. TREES trees split random samples of SUBSAMPLE
documents each (all documents, if there are fewer), at random values of random rules, until each is alone or
the depth is log2 of the sample. Every tree draws for itself, from the TREES * SUBSAMPLE first documents by a hash. Documents that few splits isolate score near 1 (2^(-mean path / expected path)).
The threshold is calibrated on all labelled rows: of those that let at most KEEP (0.5 %) of the rows labelled good
go, the lowest one, beyond the highest score at which bad rows still come at least as dense as good ones.

The statistics are one pass over whole texts; the forest is a few hundred KB whatever the input; the sample that the
trees split is part of the method (TREES * SUBSAMPLE rows at most).

Defined cases: a document without words (null, empty) has no statistics, score 1 and is rejected; null labels count
as unlabelled; without labels of both kinds the threshold is the KEEP quantile of the scores of all that are labelled,
or 1 (nothing but wordless documents is rejected) without labels; ties in the scores fall on the same side; repeated
rows score alike, each on its own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm import vec
from folioframe.session import cut

RULES = ["mean_word", "letters", "digits", "signs", "capitals", "word_repeats", "distinct_lines", "bars", "repeated_signs", "sentence_ends"]
#: What each rule is shrunk to in texts of few words, and the number of words that weighs as much.
TYPICAL = {"mean_word": 5.0, "letters": 0.8, "digits": 0.0, "signs": 0.025, "capitals": 0.02, "distinct_lines": 1.0, "sentence_ends": 0.08}
PRIOR_WORDS = 12
TREES = 128
SUBSAMPLE = 256
KEEP = 0.005


def _kinds() -> np.ndarray:
    """Rows of 0/1 by byte: letter, digit, sign, capital, bar, sentence end, newline."""
    t = np.zeros((7, 256), np.int32)
    t[0, [*range(65, 91), *range(97, 123), *range(192, 256)]] = 1
    t[1, 48:58] = 1
    t[2, [b for b in range(33, 127) if not chr(b).isalnum()]] = 1
    t[3, 65:91] = 1
    t[4, ord("|")] = 1
    t[5, [ord(x) for x in ".!?"]] = 1
    t[6, 10] = 1
    return t


KINDS = _kinds()


def statistics(texts: pa.Array) -> np.ndarray:
    """documents x RULES; rows of NaN where there is no word."""
    w = vec.Words(texts, lower=False)
    n = w.n_docs
    data, offs = w.data, w.offs
    words = w.counts()
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    size = np.maximum(chars[offs[1:]] - chars[offs[:-1]], 1)
    # all kinds of a byte in one number, so that one running sum serves two of them at a time
    sums = []
    for row in KINDS:
        total = np.concatenate([[0], np.cumsum(row[data], dtype=np.int32)])
        sums.append(total[offs[1:]] - total[offs[:-1]])
    letters, digits, signs, capitals, bars, ends, newlines = sums
    same = np.zeros(len(data) + 1, np.int32)
    if len(data) > 1:
        np.cumsum((data[1:] == data[:-1]) & (KINDS[2][data[1:]] > 0), out=same[2:])
    repeated = same[offs[1:]] - same[np.minimum(offs[:-1] + 1, offs[1:])]
    low = np.maximum(words, 1)
    length = np.bincount(w.doc, chars[w.end] - chars[w.start], n) / low
    doc, _ = vec.distinct_by_doc(w.doc, w.hash)
    distinct = np.bincount(doc, minlength=n)
    # lines: between newlines and the borders of documents
    border = np.zeros(len(data) + 1, bool)
    border[np.flatnonzero(data == 10) + 1] = True
    border[offs] = True
    start = np.flatnonzero(border[: len(data)])
    stop = np.concatenate([start[1:], [len(data)]]) if len(start) else start
    line_doc = np.searchsorted(offs, start, "right") - 1
    stop = np.where((stop > start) & (data[np.maximum(stop - 1, 0)] == 10), stop - 1, stop) if len(start) else stop
    full = stop > start
    line_doc, line_hash = line_doc[full], w.span_hash(start[full], stop[full])
    lines = np.bincount(line_doc, minlength=n)
    doc, _ = vec.distinct_by_doc(line_doc, line_hash)
    distinct_lines = np.bincount(doc, minlength=n)

    def rate(rule: str, part: np.ndarray, whole: np.ndarray, unit: float) -> np.ndarray:
        extra = PRIOR_WORDS * unit
        return (part + TYPICAL[rule] * extra) / (whole + extra)

    out = np.stack([rate("mean_word", length * words, words, 1.0), rate("letters", letters, size, 6.0), rate("digits", digits, size, 6.0), rate("signs", signs, size, 6.0), rate("capitals", capitals, letters, 5.0), np.log(low) - np.log(np.maximum(distinct, 1)), rate("distinct_lines", distinct_lines, lines, 0.1), bars / (low + PRIOR_WORDS), repeated / (low + PRIOR_WORDS), rate("sentence_ends", ends, words, 1.0)], 1)
    out[words == 0] = np.nan
    return out


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path of an unsuccessful search among n."""
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    rule: np.ndarray  # trees x nodes, -1 at a leaf; the children of node i are 2i+1 and 2i+2
    value: np.ndarray
    path: np.ndarray  # at a leaf, the length of the path with what the rest would take
    size: int
    threshold: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x))
        ok = np.flatnonzero(~np.isnan(x[:, 0]))
        if len(ok) == 0 or self.rule.shape[0] == 0:
            return np.where(np.isnan(x[:, 0]), 1.0, 0.5)
        x, total = x[ok], np.zeros(len(ok))
        i = np.arange(len(ok))
        depth = int(np.log2(self.rule.shape[1] + 1)) - 1
        for rule, value, path in zip(self.rule, self.value, self.path, strict=True):
            node = np.zeros(len(ok), np.int64)
            for _ in range(depth):
                r = rule[node]
                node = np.where(r < 0, node, 2 * node + 1 + (x[i, r] >= value[node]))
            total += path[node]
        out[ok] = 2 ** (-(total / len(self.rule)) / max(float(expected_path(self.size)), 1e-9))
        return out


def grow(samples: list[np.ndarray], seed: int = 3) -> Forest:
    rng = np.random.default_rng(seed)
    size = max((len(s) for s in samples), default=0)
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = (1 << (depth + 1)) - 1
    rule, value, path = np.full((len(samples), nodes), -1), np.zeros((len(samples), nodes)), np.zeros((len(samples), nodes))
    for t, sample in enumerate(samples):
        stack = [(0, sample, 0)]
        while stack:
            node, rows, level = stack.pop()
            varied = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
            if level == depth or len(varied) == 0:
                path[t, node] = level + float(expected_path(len(rows)))
                continue
            r = int(rng.choice(varied))
            v = rng.uniform(rows[:, r].min(), rows[:, r].max())
            v = v if v > rows[:, r].min() else rows[:, r].max()
            rule[t, node], value[t, node] = r, v
            right = rows[:, r] >= v
            stack += [(2 * node + 1, rows[~right], level + 1), (2 * node + 2, rows[right], level + 1)]
    return Forest(rule, value, path, size)


def calibrate(scores: np.ndarray, good: np.ndarray, keep: float = KEEP, n_good: int | None = None, n_bad: int | None = None) -> float:
    """The lowest threshold that rejects at most a share keep of the good rows and is above where the bad thin out. With the
    numbers of all good and bad rows, the highest scores are enough, down to one that too many good rows reach."""
    if len(scores) == 0:
        return 1.0
    if not good.any() or good.all():
        return float(np.nextafter(np.quantile(scores, 1 - keep), 2))
    at = np.unique(scores)
    reach = lambda x: len(x) - np.searchsorted(np.sort(x), at)
    lost, caught = reach(scores[good]) / (n_good or good.sum()), reach(scores[~good]) / (n_bad or (~good).sum())
    gain = np.where(lost <= keep, caught - lost, 0)
    return float(at[gain.argmax()]) if gain.max() > 0 else float(np.nextafter(scores[good].max(), 2))


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array in the order of RULES, null without words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vec.pieces(batches):
            x = statistics(vec.strings(b.column("text")))
            col = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(RULES)).cast(pa.list_(pa.float64()))
            yield pa.record_batch([b.column("doc_id"), col], ["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, stats array<double>")


def fit(docs: DataFrame, labels: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, keep: float = KEEP) -> Forest:
    """Forest of hash-drawn samples of all documents; threshold from all labelled rows."""
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").withColumn("h", F.xxhash64(F.lit(11), F.col("doc_id").cast("string")))
    drawn = ids.orderBy("h", "doc_id").limit(trees * subsample).groupBy(F.col("doc_id").alias("_id")).agg(F.min("h").alias("h"))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select(F.struct("doc_id", "h").alias("doc_id"), "text")
    table = rule_statistics(rows).where("stats IS NOT NULL").select("doc_id.h", "stats").toArrow()
    x = np.array(table.column("stats").to_pylist(), float).reshape(-1, len(RULES))
    has = ~np.isnan(x[:, 0])
    sample = sorted((v, i) for i, v in enumerate(table.column("h").to_pylist()) if has[i])
    order = np.array([i for _, i in sample], np.int64)
    forest = grow([x[np.random.default_rng((9, t)).choice(order, min(subsample, len(order)), replace=False)] for t in range(trees if len(order) else 0)])
    forest.threshold = threshold(docs, labels, forest, keep)
    return forest


def threshold(docs: DataFrame, labels: DataFrame, forest: Forest, keep: float = KEEP) -> float:
    """Calibrated on every labelled row with words. Of both kinds, only rows that score as high as the share keep of the good
    ones are gathered, with the numbers of all."""
    lab = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg((F.min(F.col("quality").cast("int")) == 1).alias("good"))
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vec.pieces(batches):
            x = statistics(vec.strings(b.column("text")))
            yield pa.record_batch([b.column("doc_id"), pa.array(shared.value.scores(x))], ["doc_id", "score"]).filter(pa.array(~np.isnan(x[:, 0])))

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, f"doc_id {kind}, score double")
    judged = cut(scored.join(lab, F.col("doc_id") == F.col("_id")).select("score", "good"))
    n_all, n_good = judged.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("good").cast("int")), F.lit(0))).first()
    if n_all == 0:
        return 1.0
    if n_good in (0, n_all):
        return float(np.nextafter(judged.agg(F.percentile("score", 1 - keep)).first()[0], 2))
    # one good row more than may go, and one for the rounding of the share
    least = judged.where("good").orderBy(F.desc("score")).limit(int(keep * n_good) + 2).agg(F.min("score")).first()[0]
    table = judged.where(F.col("score") >= least).toArrow()
    score, good = (table.column(c).to_numpy(zero_copy_only=False) for c in ("score", "good"))
    return calibrate(np.concatenate([score, [0.0]]), np.concatenate([good.astype(bool), [False]]), keep, n_good, n_all - n_good)


def quality(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, anomaly (0 to 1) and keep (boolean) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in vec.pieces(batches):
            s = f.scores(statistics(vec.strings(b.column("text"))))
            yield pa.record_batch([b.column("doc_id"), pa.array(s), pa.array(s < f.threshold)], ["doc_id", "anomaly", "keep"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, anomaly double, keep boolean")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Anomaly and decision for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
