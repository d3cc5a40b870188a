"""Language-model scoring: a gated recurrent network in numpy with a class-factored softmax.

Words are counted over all documents. The most frequent, GROWTH times the cube root of the number of words (LEAST at
least; ties by hash), are symbols of their own; the rest are symbols by their length in bytes (LENGTHS, the last for all
longer ones). Symbols are put into about sqrt(symbols) classes of about equal mass, by the square root of frequency,
and p(symbol) = p(class) p(symbol | class). A word without a symbol of its own is spelled as well: p(word) = p(length
symbol) p(bytes | length), by the frequencies of bytes after bytes in all such words of the corpus. So the likelihood is
that of the complete sequence of words.

Training is truncated backpropagation through time over windows of WINDOW words with the state carried on. Every document
is learnt from in every round. Documents are dealt to shards of about SHARD_WORDS words by a hash of id and text, and sorted
by it, so what a shard learns doesn't depend on how the input is split. Every shard trains a copy, starting from the
frequencies; in each round the copies are averaged by words, in a fixed order, a slice of the parameters a group, and sent
out again. What reaches the driver is one set of parameters, which grows with the vocabulary, by the cube root.

Scoring runs documents side by side in windows and carries each one's state over all its windows, so the result is
the log-likelihood of the complete document.

Defined cases: null or empty text has no words, log-likelihood 0 and null nll; with no words anywhere the model knows
lengths and bytes as equally frequent; repeated rows count as often as they occur and score alike; an empty table gives an
empty result; extra columns are not read. Scores repeat to about five digits (32-bit sums, by lanes side by side).
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

LEAST = 1024
GROWTH = 9.0
LENGTHS = 24
HIDDEN = 24
WINDOW = 32
#: Lanes side by side: LANES, or as many as leave UPDATES windows to a pass, MOST_LANES at most.
LANES = 64
UPDATES = 128
MOST_LANES = 256
ROUNDS = 1
RATE = 0.02
SHARD_WORDS = 2 << 20
#: Numbers of a slice of the parameters, and the groups that slices are averaged in.
SLICE = 2048
GROUPS = 32
SCORE_WORDS = 6 << 20
#: States that go through the softmax at a time in scoring, and texts that are stepped through side by side.
SOFTMAX_ROWS = 32768
SCORE_LANES = 4096
#: Logits up to which exp() is taken of them as they are; the sum of 2^30 of them is far from the end of 32 bits.
TAME = 40.0


@dataclass
class Vocabulary:
    """hashes, sorted, of the words with a symbol of their own, and the symbol of each; symbols of lengths; frequency and
    class of each symbol. Symbols are numbered by class; class c has those from first[c] to first[c + 1]."""

    hashes: np.ndarray
    symbol: np.ndarray
    lengths: np.ndarray
    freq: np.ndarray
    cls: np.ndarray
    first: np.ndarray

    def __post_init__(self):
        self.slots = vec.Slots(self.hashes)

    @property
    def size(self) -> int:
        return len(self.cls)

    @property
    def words(self) -> int:
        return int(self.freq.sum())


def vocabulary(docs: DataFrame, least: int = LEAST, growth: float = GROWTH) -> Vocabulary:
    """Count words over all documents; keep the most frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_n, rows = [], [], 0

        def merged():
            h, of = np.unique(np.concatenate(held), return_inverse=True)
            return h, np.bincount(of, np.concatenate(held_n), len(h)).astype(np.int64)

        for b in vec.pieces(batches):
            w = vec.Words(vec.strings(b.column("text")))
            # the length of an unlisted word is counted through its own key
            h, n = np.unique((w.hash & ~np.uint64(31)) | np.minimum(w.end - w.start, LENGTHS).astype(np.uint64), return_counts=True)
            held.append(h)
            held_n.append(n)
            rows += len(h)
            if rows > 2_000_000:
                h, n = merged()
                held, held_n, rows = [h], [n], len(h)
                if rows > 1_500_000:
                    yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["h", "c"])
                    held, held_n, rows = [], [], 0
        if held:
            h, n = merged()
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["h", "c"])

    counted = cut(docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    lengths = {r["n"]: r["c"] for r in counted.groupBy(F.col("h").bitwiseAND(31).alias("n")).agg(F.sum("c").alias("c")).collect()}
    size = max(least, int(growth * sum(lengths.values()) ** (1 / 3)))
    top = counted.orderBy(F.desc("c"), "h").limit(size).collect()
    hashes = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    freq = np.array([r["c"] for r in top], float)
    rest = np.array([lengths.get(i, 0) for i in range(1, LENGTHS + 1)], float)
    for h, c in zip(hashes, freq, strict=True):
        rest[int(h & np.uint64(31)) - 1] -= c
    return build(hashes, np.concatenate([freq, np.maximum(rest, 0)]))


def build(keys: np.ndarray, freq: np.ndarray, classes: int | None = None) -> Vocabulary:
    """From the keys of words and the frequencies of these and, after them, of the lengths."""
    classes = classes or max(1, round(len(freq) ** 0.5))
    mass = np.sqrt(freq + 1)
    order = np.argsort(-mass, kind="stable")
    share = (np.cumsum(mass[order]) - mass[order] / 2) / mass.sum()
    _, cls = np.unique(np.minimum((share * classes).astype(np.int64), classes - 1), return_inverse=True)
    symbol = np.empty(len(freq), np.int64)
    symbol[order] = np.arange(len(freq))
    by = np.argsort(keys)
    return Vocabulary(keys[by], symbol[by], symbol[len(keys) :], freq[order], cls, np.searchsorted(cls, np.arange(cls[-1] + 2)))


def symbols_of(v: Vocabulary, w: vec.Words) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, whether it is that of a length) of words; keys hold the length in their lowest bits, as in the count."""
    size = np.minimum(w.end - w.start, LENGTHS)
    length = v.lengths[size - 1]
    if len(v.hashes) == 0:
        return length.astype(np.int32), np.ones(len(size), bool)
    at = v.slots.find((w.hash & ~np.uint64(31)) | size.astype(np.uint64))
    own = at >= 0
    return np.where(own, v.symbol[at], length).astype(np.int32), ~own


def _spelt(w: vec.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, pair) of every byte of the words which: the byte and the one before it (a newline at the start) in one."""
    start, size = w.start[which], (w.end - w.start)[which]
    at = vec.ragged(start, size)
    before = w.data[at - 1].astype(np.int64)
    before[(np.cumsum(size) - size)] = 10
    return np.repeat(which, size), before * 256 + w.data[at]


class Spelling:
    """Bytes after bytes in words without a symbol of their own: counts of the 65,536 pairs, then the number of words of
    LENGTHS bytes or more and of their bytes beyond."""

    SIZE = 65_538

    def __init__(self, counts: np.ndarray):
        pairs = counts[:65_536].reshape(256, 256) + 0.05
        self.logs = np.log(pairs / pairs.sum(1, keepdims=True)).ravel()
        stop = (counts[65_536] + 1) / (counts[65_536] + counts[65_537] + 2)
        self.stop, self.go_on = np.log(stop), np.log(1 - stop)

    @staticmethod
    def counts(w: vec.Words, unlisted: np.ndarray) -> np.ndarray:
        which = np.flatnonzero(unlisted)
        if len(which) == 0:
            return np.zeros(Spelling.SIZE, np.int64)
        beyond = (w.end - w.start)[which] - LENGTHS
        return np.concatenate([np.bincount(_spelt(w, which)[1], minlength=65_536), [(beyond >= 0).sum(), beyond[beyond > 0].sum()]])

    def loglik(self, w: vec.Words, unlisted: np.ndarray) -> np.ndarray:
        """Log-likelihood of the spelling of each document's unlisted words, given their length symbols."""
        which = np.flatnonzero(unlisted)
        if len(which) == 0:
            return np.zeros(w.n_docs)
        word, pair = _spelt(w, which)
        beyond = (w.end - w.start)[which] - LENGTHS
        ends = np.where(beyond >= 0, np.maximum(beyond, 0) * self.go_on + self.stop, 0.0)
        return np.bincount(w.doc[word], self.logs[pair], w.n_docs) + np.bincount(w.doc[which], ends, w.n_docs)


def group_sums(rows: np.ndarray, opens: np.ndarray, each: int = 8) -> np.ndarray:
    """Sums of the groups of rows that begin at opens. What reduceat costs goes by groups, of which most are small: their
    first rows are added for all groups at once, and it is left with those beyond each."""
    size = np.diff(opens, append=len(rows))
    out = rows[opens]
    for j in range(1, each):
        some = np.flatnonzero(size > j)
        out[some] += rows[opens[some] + j]
    some = np.flatnonzero(size > each)
    if len(some):
        left = size[some] - each
        out[some] += np.add.reduceat(rows[vec.ragged(opens[some] + each, left)], np.cumsum(left) - left, axis=0)
    return out


class Network:
    """Parameters: inputs (symbols and a start mark) to gates, state to gates, state to classes and to words. The biases
    start at the frequencies."""

    NAMES = ("inputs", "gates", "classes", "class_bias", "words", "word_bias")

    def __init__(self, v: Vocabulary, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.v, self.hidden, self.spelling = v, hidden, Spelling(np.zeros(Spelling.SIZE))
        n, k = v.size, len(v.first) - 1
        self.inputs = rng.normal(0, 0.1, (n + 1, 3 * hidden)).astype(np.float32)
        self.gates = rng.normal(0, hidden**-0.5 / 2, (hidden, 3 * hidden)).astype(np.float32)
        self.classes = rng.normal(0, 0.1, (hidden, k)).astype(np.float32)
        mass = np.add.reduceat(v.freq + 0.5, v.first[:-1])
        self.class_bias = np.log(mass / mass.sum()).astype(np.float32)
        self.words = rng.normal(0, 0.1, (n, hidden)).astype(np.float32)
        self.word_bias = np.log((v.freq + 0.5) / mass[v.cls]).astype(np.float32)
        self.restart()

    def restart(self) -> None:
        """Forget the averages of gradients."""
        self.updates = 0
        self.first, self.second = ({n: np.zeros_like(getattr(self, n)) for n in self.NAMES} for _ in "ab")

    def __getstate__(self):
        return {k: x for k, x in self.__dict__.items() if k not in ("first", "second")}

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step for lanes: (update, reset, candidate, state's part of the candidate, what the update keeps of state less
        candidate, new state)."""
        k = self.hidden
        a = self.inputs[x]
        # a block a gate, each contiguous
        u = np.matmul(h, self.gates.reshape(k, 3, k).transpose(1, 0, 2))
        zr = u[:2]
        zr += a[:, : 2 * k].reshape(-1, 2, k).transpose(1, 0, 2)
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r, un = u
        n = r * un
        n += a[:, 2 * k :]
        np.tanh(n, out=n)
        kept = h - n
        kept *= z
        return z, r, n, un, kept, kept + n

    @staticmethod
    def _tame(weights: np.ndarray, bias: np.ndarray) -> bool:
        """Whether every logit of a state lies within -TAME and TAME."""
        return bool((np.abs(weights) @ np.ones(weights.shape[1], weights.dtype) + np.abs(bias)).max() < TAME)

    def loss(self, h: np.ndarray, y: np.ndarray, learn: bool = False):
        """Log-likelihood of symbols y after states h; with learn, the gradients of its negative sum as well."""
        order = np.argsort(self.v.cls[y].astype(np.int16), kind="stable")
        c, y = self.v.cls[y[order]], y[order]
        # biases are the weights of a constant, and what is divided by sums are states, which are narrower than the logits
        h = np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1)[order]
        logits = h @ np.concatenate([self.classes, self.class_bias[None]])
        # states are within -1 and 1: where no sum can leave what exp() takes, the largest need not be looked for
        tame = self._tame(self.classes.T, self.class_bias)
        if not tame:
            logits -= logits.max(1, keepdims=True)
        first = self.v.first
        ones = np.ones(max(logits.shape[1], int(np.diff(first).max())), logits.dtype)
        rows = np.arange(len(y))
        ll = logits[rows, c].astype(np.float64)
        p = np.exp(logits, out=logits)
        s = p @ ones[: p.shape[1]]
        ll -= np.log(s)
        if learn:
            p[rows, c] -= s
            g = (h / s[:, None]).T @ p
            grads = {"classes": g[:-1], "class_bias": g[-1]}
            part = p @ self.classes.T
            part /= s[:, None]
        cuts, at_y = np.searchsorted(c, np.arange(len(first))), y - first[c]
        tame = self._tame(self.words, self.word_bias)
        words = np.concatenate([self.words, self.word_bias[:, None]], 1)
        picked, sums = np.zeros(len(y), h.dtype), np.ones(len(y), h.dtype)
        if learn:
            g, within = np.zeros_like(words), np.zeros_like(part)
        some = np.flatnonzero((np.diff(cuts) > 0) & (np.diff(first) > 1))
        for lo, hi, low, high in zip(*(x.tolist() for x in (cuts[some], cuts[some + 1], first[some], first[some + 1])), strict=True):
            hk, wk = h[lo:hi], words[low:high]
            q = hk @ wk.T
            if not tame:
                q -= q.max(1, keepdims=True)
            at = (rows[: hi - lo], at_y[lo:hi])
            picked[lo:hi] = q[at]
            np.exp(q, out=q)
            s = sums[lo:hi] = q @ ones[: high - low]
            if learn:
                q[at] -= s
                np.matmul(q.T, hk / s[:, None], out=g[low:high])
                np.matmul(q, wk[:, :-1], out=within[lo:hi])
        ll += picked - np.log(sums)
        out = np.empty_like(ll)
        out[order] = ll
        if not learn:
            return out
        grads |= {"words": np.ascontiguousarray(g[:, :-1]), "word_bias": g[:, -1]}
        within /= sums[:, None]
        part += within
        back = np.empty_like(part)
        back[order] = part
        return out, grads, back

    def gradients(self, x: np.ndarray, y: np.ndarray, new: np.ndarray, h: np.ndarray, ok: np.ndarray | None = None) -> tuple[float, dict, np.ndarray]:
        """Over a window (lanes x steps) of inputs x, targets y and marks of first words, from states h: the log-likelihood,
        the gradients of its negative (of inputs: symbols and rows) and the states after it. Only targets that are ok count."""
        lanes, steps = x.shape
        k = self.hidden
        kept, states, some_new = [], [], new.any(0)
        for t in range(steps):
            before = np.where(new[:, t, None], h.dtype.type(0), h) if some_new[t] else h
            *gates, h = self.step(x[:, t], before)
            kept.append((before, *gates))
            states.append(h)
        flat_h, flat_y = np.concatenate(states), y.T.ravel()
        if ok is None or ok.all():
            out, grads, back = self.loss(flat_h, flat_y, learn=True)
        else:
            some = np.flatnonzero(ok.T.ravel())
            out, grads, part = self.loss(flat_h[some], flat_y[some], learn=True)
            back = np.zeros_like(flat_h)
            back[some] = part
        back = back.reshape(steps, lanes, k)
        # by gate; inner: the candidate's delta before its state's part is reset
        deltas, inner = np.empty((3, steps, lanes, k), self.gates.dtype), np.empty((steps, lanes, k), self.gates.dtype)
        to_z, to_r, to_n = (np.ascontiguousarray(self.gates[:, i * k : (i + 1) * k].T) for i in range(3))
        dh = np.zeros((lanes, k), self.gates.dtype)
        for t in range(steps - 1, -1, -1):
            _, z, r, n, un, rest = kept[t]
            (dz, dr, dn), du = deltas[:, t], inner[t]
            dh += back[t]
            left = 1 - z
            left *= dh
            np.multiply(left, rest, out=dz)
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= left
            np.multiply(dn, r, out=du)
            np.subtract(1, r, out=dr)
            dr *= un
            dr *= du
            dh *= z
            for delta, weights in ((dz, to_z), (dr, to_r), (du, to_n)):
                dh += delta @ weights
            if some_new[t]:
                dh[new[:, t]] = 0
        before = np.concatenate([b for b, *_ in kept]).T
        grads["gates"] = np.concatenate([before @ x.reshape(-1, k) for x in (deltas[0], deltas[1], inner)], 1)
        flat_x = x.T.ravel()
        order = np.argsort(flat_x.astype(np.uint16) if self.v.size < 65_535 else flat_x, kind="stable")
        sorted_x = flat_x[order]
        opens = np.flatnonzero(np.concatenate([[True], sorted_x[1:] != sorted_x[:-1]]))
        by_symbol = np.empty((len(order), 3 * k), deltas.dtype)
        for i in range(3):
            by_symbol[:, i * k : (i + 1) * k] = deltas[i].reshape(-1, k)[order]
        grads["inputs"] = sorted_x[opens], group_sums(by_symbol, opens)
        return float(out.sum()), grads, h

    def train(self, ids: np.ndarray, starts: np.ndarray, lanes: int | None = None, rate: float = RATE) -> int:
        """One pass of truncated backpropagation over concatenated texts; starts marks first words. Returns the words."""
        if len(ids) == 0:
            return 0
        if lanes is None:
            lanes = max(LANES, min(MOST_LANES, len(ids) // (WINDOW * UPDATES)))
        lanes = max(1, min(lanes, len(ids) // (2 * WINDOW)))
        width = -(-len(ids) // lanes)
        spare = lanes * width - len(ids)
        y = np.concatenate([ids, np.zeros(spare, ids.dtype)]).reshape(lanes, width).astype(np.int64)
        new = np.concatenate([starts, np.ones(spare, bool)]).reshape(lanes, width)
        new[:, 0] = True
        ok = (np.arange(lanes * width) < len(ids)).reshape(lanes, width)
        x = np.concatenate([np.full((lanes, 1), self.v.size), y[:, :-1]], 1)
        x[new] = self.v.size
        h = np.zeros((lanes, self.hidden), np.float32)
        for lo in range(0, width, WINDOW):
            part = slice(lo, min(lo + WINDOW, width))
            _, grads, h = self.gradients(x[:, part], y[:, part], new[:, part], h, ok[:, part])
            m = int(ok[:, part].sum())
            self.updates += 1
            # a plain number, which leaves arrays of 32 bits what they are
            fix = float(np.sqrt(1 - 0.99**self.updates) / (1 - 0.9**self.updates))
            for name in self.NAMES:
                at, g = grads[name] if name == "inputs" else (slice(None), grads[name])
                g = g / m
                np.clip(g, -1, 1, out=g)
                # of inputs these are copies, of the others views
                f, s = self.first[name][at], self.second[name][at]
                f *= 0.9
                f += 0.1 * g
                g *= g
                g *= 0.01
                s *= 0.99
                s += g
                if name == "inputs":
                    self.first[name][at], self.second[name][at] = f, s
                step = np.sqrt(s)
                step += 1e-6
                np.divide(f, step, out=step)
                step *= rate * fix
                getattr(self, name)[at] -= step
        return len(ids)

    def score(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log-likelihood of each text, from the symbols of all and the number of each."""
        first = np.cumsum(counts) - counts
        by = np.argsort(-counts, kind="stable")
        out = np.empty(len(by))
        # texts of about equal length together, few enough that a step's arrays stay in the cache
        for lo in range(0, len(by), SCORE_LANES):
            group = by[lo : lo + SCORE_LANES]
            out[group] = self._score(ids, first[group], counts[group])
        return out

    def _score(self, ids: np.ndarray, first: np.ndarray, counts_by: np.ndarray) -> np.ndarray:
        """Log-likelihood of the texts of ids that start at first, the longest first."""
        total = np.zeros(len(first))
        longest = int(counts_by.max(initial=0))
        alive = len(first) - np.searchsorted(counts_by[::-1], np.arange(longest), "right")
        h = np.zeros((int(alive[0]) if longest else 0, self.hidden), np.float32)
        x = np.full(len(h), self.v.size, np.int64)
        states, targets, sizes = [], [], []
        for t in range(longest):
            live = int(alive[t])
            h = self.step(x[:live], h[:live])[-1]
            x = ids[first[:live] + t].astype(np.int64)
            states.append(h)
            targets.append(x)
            sizes.append(live)
            if t == longest - 1 or live * len(sizes) > SOFTMAX_ROWS:
                lanes = vec.ragged(np.zeros(len(sizes), np.int64), np.array(sizes))
                total += np.bincount(lanes, self.loss(np.concatenate(states), np.concatenate(targets)), len(total))
                states, targets, sizes = [], [], []
        return total


def shards(docs: DataFrame, v: Vocabulary, words: int = SHARD_WORDS) -> DataFrame:
    """shard, h (a hash of id and text), ids and, in one more row a partition of docs, pairs (counts of the spelling):
    every row of docs, a partition a shard, sorted by h."""
    n = max(1, -(-v.words // words))
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(Spelling.SIZE, np.int64)
        names = ["h", "ids", "pairs"]
        for b in vec.pieces(batches):
            w = vec.Words(vec.strings(b.column("text")))
            ids, unlisted = symbols_of(shared.value, w)
            pairs += Spelling.counts(w, unlisted)
            yield pa.record_batch([b.column("h"), vec.list_array(ids, w.counts(), pa.int32()), pa.nulls(b.num_rows, pa.list_(pa.int64()))], names)
        yield pa.record_batch([pa.array([int(pairs.sum())]), pa.array([[]], pa.list_(pa.int32())), pa.array([pairs.tolist()], pa.list_(pa.int64()))], names)

    hashed = docs.select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), "text")
    rows = hashed.mapInArrow(symbols, "h long, ids array<int>, pairs array<long>").withColumn("shard", F.pmod("h", F.lit(n)).cast("int"))
    return cut(rows.repartitionById(n, F.col("shard")).sortWithinPartitions("h"))


def train(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS, words: int = SHARD_WORDS) -> Network:
    """Average of the networks of all shards, over all documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(v)
    rows = shards(docs, v, words)
    net = Network(v)
    counts = rows.where("pairs IS NOT NULL").select(F.posexplode("pairs").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).where("n > 0").toArrow()
    pairs = np.zeros(Spelling.SIZE)
    pairs[counts.column("i").to_numpy()] = counts.column("n").to_numpy()
    net.spelling = Spelling(pairs)
    for nth in range(rounds):
        sent = spark.sparkContext.broadcast(net.flat())
        rate = RATE / (1 + nth)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Network(shared.value).load(sent.value)
            parts, sizes, held, learnt, shard = [], [], 0, 0, 0

            def block() -> int:
                ids, size = np.concatenate(parts), np.concatenate(sizes)
                starts = np.zeros(len(ids), bool)
                starts[(np.cumsum(size) - size)[size > 0]] = True
                return own.train(ids, starts, rate=rate)

            for b in batches:
                if b.num_rows == 0:
                    continue
                shard = b.column("shard")[0].as_py()
                col = b.column("ids")
                parts.append(col.flatten().to_numpy(zero_copy_only=False))
                sizes.append(np.diff(col.offsets.to_numpy()))
                held += len(parts[-1])
                # a shard that many equal rows make large is learnt in blocks
                if held > 2 * words:
                    learnt += block()
                    parts, sizes, held = [], [], 0
            if held:
                learnt += block()
            if learnt:
                flat = own.flat()
                cuts = range(0, len(flat), SLICE)
                n = len(cuts)
                yield pa.record_batch([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, float(learnt))), pa.array([flat[at : at + SLICE].tobytes() for at in cuts])], ["slice", "shard", "words", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total, sums = None, 0.0, None
            close = lambda: pa.record_batch([pa.array([now], pa.int32()), pa.array([(sums / total).tobytes()])], ["slice", "mean"])
            for b in batches:
                for i, n, s in zip(b.column("slice").to_pylist(), b.column("words").to_pylist(), b.column("part"), strict=True):
                    part = np.frombuffer(s.as_buffer(), np.float32).astype(np.float64) * n
                    if i != now:
                        if now is not None:
                            yield close()
                        now, total, sums = i, n, part
                    else:
                        total, sums = total + n, sums + part
            if now is not None:
                yield close()

        got = rows.select("shard", "ids").mapInArrow(learn, "slice int, shard int, words double, part binary")
        got = got.repartition(GROUPS, "slice").sortWithinPartitions("slice", "shard").mapInArrow(add, "slice int, mean binary").collect()
        if not got:
            break
        net.load(np.concatenate([np.frombuffer(r["mean"], np.float64) for r in sorted(got, key=lambda r: r["slice"])]))
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_words, loglik and nll (negative log-likelihood a word, null without words) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shared.value
        names, ids, counts, spelt, words = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            size = np.concatenate(counts)
            ll = n.score(np.concatenate(ids), size) + np.concatenate(spelt)
            nll = pa.array(-ll / np.maximum(size, 1), mask=size == 0)
            return pa.record_batch([pa.concat_arrays(names), pa.array(size.astype(np.int64)), pa.array(ll), nll], ["doc_id", "n_words", "loglik", "nll"])

        for b in vec.pieces(batches):
            w = vec.Words(vec.strings(b.column("text")))
            names.append(b.column("doc_id"))
            own, unlisted = symbols_of(n.v, w)
            ids.append(own)
            spelt.append(n.spelling.loglik(w, unlisted))
            counts.append(w.counts())
            words += len(own)
            if words > SCORE_WORDS:
                yield close()
                names, ids, counts, spelt, words = [], [], [], [], 0
        if names:
            yield close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, loglik double, nll double")


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Log-likelihood of every complete document, by a network trained on the same table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, vocabulary(docs)))
