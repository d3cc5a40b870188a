"""Passages that repeat across documents, by a run-length index (r-index) with matching statistics.

Words are compared in lower case, without punctuation. A word of a document is marked when it lies in a run of at
least LENGTH (50) words that an earlier document (a lower doc_id) also has; the first occurrence is never marked.

1. Anchors: of every 50-word window the 20-gram with the least hash (a minimizer), so two texts that share 50 words
   share an anchor. One shuffle of (hash, doc_id, position), about one row in 16 words, gives each anchor that occurs
   in several documents its owner, the least doc_id.
2. Around its anchors each document gives segments per owner: the owner's own are the reference, those of the others
   are streamed against it, in chunks that overlap by 49 words.
3. Per batch of owners the reference is indexed: suffix array, Burrows-Wheeler transform, run-length compressed, with
   the text position kept at both ends of every run. Each symbol is salted with its owner, so one index serves many
   owners. Chunks are streamed right to left through it, thousands side by side: a step follows LF, or at a mismatch
   jumps to the nearest run of the symbol on either side and keeps the longer common extension, compared by prefix
   hashes. Positions whose matching statistic reaches 50 are marked.

No window gathers what a popular anchor's documents hold: who owns it is an aggregate, put together before the shuffle,
and joined back. Nothing but anchors, segments, window hashes and the text by doc_id is shuffled; an owner that very many documents share is
split into slots of STREAMS documents each. A passage is compared with the first document that holds one of its
anchors. That document may have the anchor's 20 words without the rest of the passage, so where at least two others
have them as well, the hashes of those others' windows of LENGTH words are shuffled too and give what they share among
themselves, in runs beside those of step 3.

Defined cases: null or empty texts and those below 50 words have no passages; rows with a null doc_id are not
compared, nor are those of a doc_id that has different texts; ids that aren't integers raise; rows that repeat a doc_id
and its text count as one document; repeats within one document alone don't count; ties go to
the lower doc_id; an empty table gives no rows; extra columns are not read by repeats() and pass through
drop_repeats(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.llm import vec
from folioframe.session import cut

LENGTH = 50
GRAM = 20
CHUNK = 256
STREAMS = 2048
BATCH_WORDS = 1 << 20


def word_grams(w: vec.Words, k: int) -> np.ndarray:
    n = max(0, len(w.hash) - k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(k if n else 0):
        total += w.hash[j : j + n] * vec._MUL[j]
    return vec.mix(total)


def minimizers(w: vec.Words, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, hash): the least k-gram of every window of length words within a document."""
    span = length - k + 1
    n = len(w.hash) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = word_grams(w, k) | np.uint64(1)
    low, have = h, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    low = np.where(w.doc[:n] == w.doc[length - 1 :], low[:n], 0)
    high = np.concatenate([np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)])
    have = 1
    while have * 2 <= span:
        high = np.maximum(high[:-have], high[have:])
        have *= 2
    if have < span:
        high = np.maximum(high[: len(high) - (span - have)], high[span - have :])
    at = np.flatnonzero(high[: len(h)] == h)
    return at, h[at]


def anchors(docs: DataFrame, length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """(owner, doc, pos, rest) of every anchor that occurs in several documents; rest: its document is not the owner and
    a further one has the anchor."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vec.pieces(batches):
            w = vec.Words(vec.strings(b.column("text")))
            at, h = minimizers(w, length, k)
            doc = w.doc[at]
            yield pa.record_batch([pa.array(h.view(np.int64)), b.column("doc").take(pa.array(doc)), pa.array((at - w.firsts()[doc]).astype(np.int32))], ["f", "doc", "pos"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc IS NOT NULL").mapInArrow(find, "f long, doc long, pos int")
    # found and shuffled once for both sides of the join: they read the same columns under the same filter, so Spark sees one exchange
    found = found.where("f IS NOT NULL AND doc IS NOT NULL").repartition("f")
    shared = found.groupBy("f").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.count("pos").alias("n")).where("owner < last")
    # an anchor that a document has twice may count as one of three documents, which costs work but changes nothing
    return found.join(shared, "f").select("owner", "doc", "pos", F.expr("doc > owner AND n > 2").alias("rest"))


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of an array of symbols (0 separates texts) with sampled ends."""

    def __init__(self, text: np.ndarray):
        text = np.concatenate([text, [0]]).astype(np.int64)
        n = self.n = len(text)
        self.text = text
        suffixes = self._suffixes(text)
        before = text[suffixes - 1]
        start = self.start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.head = before[start]
        ends = np.concatenate([start[1:], [n]]) - 1
        self.first_sample, self.last_sample = suffixes[start], suffixes[ends]
        self.ends = ends
        order = np.argsort(self.head, kind="stable")
        size = ends - start + 1
        self.lf = np.empty(len(start), np.int64)
        self.lf[order] = np.cumsum(size[order]) - size[order]
        self.runs = len(start)
        self.by_symbol = self.head[order] * self.runs + order
        # prefix hashes of the text, for the length of common extensions
        self.powers = vec._pow(vec._BASE, n + CHUNK + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(vec.mix(text.astype(np.uint64)) * self.powers[:n])])

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling."""
        n = len(text)
        _, rank = np.unique(text, return_inverse=True)
        rank = rank.astype(np.int64)
        k = 1
        while True:
            key = rank * (n + 1)
            key[: n - k] += rank[k:] + 1
            order = np.argsort(key)
            ordered = key[order]
            fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1 or k >= n:
                return order
            k *= 2

    def common(self, p: np.ndarray, q: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the common extension of the text at p and at q, limit at most."""
        low, high = np.zeros(len(p), np.int64), np.minimum(limit, self.n - np.maximum(p, q))
        swap = p > q
        p, q = np.where(swap, q, p), np.where(swap, p, q)
        shift = self.powers[q - p]
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (self.sums[p + mid] - self.sums[p]) * shift == self.sums[q + mid] - self.sums[q]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def statistics(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Matching statistics of the patterns flat[start : start + size], aligned with flat; symbol 0 matches nothing."""
        out = np.zeros(len(flat), np.int32)
        by = np.argsort(-size, kind="stable")
        start, size = start[by], size[by]
        row, place, length = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
        for step in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -step))
            at = start[:live] + size[:live] - 1 - step
            c = flat[at]
            run = np.searchsorted(self.start, row[:live], "right") - 1
            good = (length[:live] > 0) & (self.head[run] == c) & (c > 0)
            new_row = self.lf[run] + row[:live] - self.start[run]
            new_place, new_length = place[:live] - 1, length[:live] + 1
            bad = np.flatnonzero(~good)
            if len(bad):
                cb, pb, lb = c[bad], place[bad], length[bad]
                i = np.searchsorted(self.by_symbol, cb * self.runs + run[bad])
                above, below = np.maximum(i - 1, 0), np.minimum(i, self.runs - 1)
                up, down = self.by_symbol[above], self.by_symbol[below]
                has_up, has_down = (i > 0) & (up // self.runs == cb) & (cb > 0), (i < self.runs) & (down // self.runs == cb) & (cb > 0)
                up, down = up % self.runs, down % self.runs
                at_up, at_down = self.last_sample[up], self.first_sample[down]
                len_up, len_down = np.full(len(bad), -1), np.full(len(bad), -1)
                for has, where, put in ((has_up, at_up, len_up), (has_down, at_down, len_down)):
                    put[has] = self.common(pb[has], where[has], lb[has])
                take_up = len_up >= len_down
                best = np.maximum(len_up, len_down)
                found = best >= 0
                chosen = np.where(take_up, up, down)
                new_row[bad] = np.where(found, self.lf[chosen] + np.where(take_up, self.ends[up] - self.start[up], 0), 0)
                new_place[bad] = np.where(found, np.where(take_up, at_up, at_down) - 1, 0)
                new_length[bad] = np.where(found, best + 1, 0)
            row[:live], place[:live], length[:live] = new_row, new_place, new_length
            out[at] = new_length
        return out


def spans_of(marks: np.ndarray, length: int, key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union by key of the intervals [pos, pos + statistic) whose statistic reaches length: (key, start, end)."""
    hit = np.flatnonzero(marks >= length)
    if len(hit) == 0:
        return (np.zeros(0, np.int64),) * 3
    k, s, e = key[hit], pos[hit], pos[hit] + marks[hit]
    order = np.lexsort((s, k))
    k, s, e = k[order], s[order], e[order]
    # running end by key: keys are dense and ends below 2^40
    reach = np.maximum.accumulate(e + k * (1 << 40)) - k * (1 << 40)
    opens = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] > reach[:-1])])
    first = np.flatnonzero(opens)
    last = np.concatenate([first[1:], [len(k)]]) - 1
    return k[first], s[first], reach[last]


def _segments(length: int, k: int):
    """Rows of (doc, text, anchors with owner and position) to (owner, slot, is_ref, doc, at, words): what to index and stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vec.pieces(batches):
            w = vec.Words(vec.strings(b.column("text")))
            counts, firsts = w.counts(), w.firsts()
            words = (w.hash >> np.uint64(32)).astype(np.uint32)
            found = b.column("found")
            flat = found.flatten()
            sizes = np.diff(found.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), sizes)
            owner, pos, slots = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            doc = b.column("doc").to_numpy()
            order = np.lexsort((pos, owner, row))
            row, owner, pos, slots = row[order], owner[order], pos[order], slots[order]
            lo = np.maximum(pos - (length - k), 0)
            hi = np.minimum(pos + length, counts[row])
            group = np.concatenate([[0], np.cumsum((row[1:] != row[:-1]) | (owner[1:] != owner[:-1]))]) if len(row) else row
            reach = np.maximum.accumulate(hi + group * (1 << 40)) - group * (1 << 40) if len(row) else hi
            opens = np.concatenate([[True], (group[1:] != group[:-1]) | (lo[1:] > reach[:-1])]) if len(row) else np.zeros(0, bool)
            first = np.flatnonzero(opens)
            last = np.concatenate([first[1:], [len(row)]]).astype(np.int64) - 1
            s_row, s_owner, s_lo, s_hi, s_slots = row[first], owner[first], lo[first], reach[last], slots[first]
            keep = s_hi - s_lo >= length
            s_row, s_owner, s_lo, s_hi, s_slots = (x[keep] for x in (s_row, s_owner, s_lo, s_hi, s_slots))
            is_ref = doc[s_row] == s_owner
            # streams are cut into chunks, a reference goes whole to every slot of its owner
            step = CHUNK - (length - 1)
            pieces = np.where(is_ref, s_slots, np.maximum(1, -(-(s_hi - s_lo - (length - 1)) // step)))
            i = np.repeat(np.arange(len(s_row)), pieces)
            nth = np.arange(len(i)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            ref = is_ref[i]
            at = np.where(ref, s_lo[i], s_lo[i] + nth * step)
            end = np.where(ref, s_hi[i], np.minimum(at + CHUNK, s_hi[i]))
            mixed = vec.mix(doc[s_row[i]].astype(np.uint64)) >> np.uint64(1)
            slot = np.where(ref, nth, mixed.astype(np.int64) % np.maximum(s_slots[i], 1))
            where = vec.ragged(firsts[s_row[i]] + at, end - at)
            offs = np.concatenate([[0], np.cumsum((end - at) * 4)]).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(offs), pa.py_buffer(words[where])])
            yield pa.record_batch([pa.array(s_owner[i]), pa.array(slot.astype(np.int32)), pa.array(~ref), pa.array(doc[s_row[i]]), pa.array(at.astype(np.int32)), blob], ["owner", "slot", "stream", "doc", "at", "words"])

    return run


def _matcher(length: int):
    """Over rows sorted by owner, slot, stream: index the references of a batch of owners, stream the chunks."""

    def match(tables: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(tables).combine_chunks()
        if t.num_rows == 0:
            return None
        owner, slot, doc, at = (t.column(c).to_numpy() for c in ("owner", "slot", "doc", "at"))
        stream = t.column("stream").to_numpy(zero_copy_only=False)
        if stream.all() or not stream.any():
            return None
        col = t.column("words")
        col = pa.concat_arrays([c.cast(pa.large_binary()) for c in col.chunks])
        data, offs = vec.buffers(col)
        words, offs = np.frombuffer(data.tobytes(), np.uint32).astype(np.uint64), offs // 4
        size = np.diff(offs)
        group = np.concatenate([[0], np.cumsum((owner[1:] != owner[:-1]) | (slot[1:] != slot[:-1]))])
        salted = (np.repeat(group.astype(np.uint64), size) << np.uint64(32)) | words
        ref_rows, new_rows = np.flatnonzero(~stream), np.flatnonzero(stream)
        ref_words = salted[vec.ragged(offs[ref_rows], size[ref_rows])]
        symbols, rank = np.unique(ref_words, return_inverse=True)
        n = len(ref_words) + len(ref_rows)
        text = np.zeros(n, np.int64)
        starts = np.cumsum(size[ref_rows] + 1) - (size[ref_rows] + 1)
        text[vec.ragged(starts, size[ref_rows])] = rank + 1
        index = RunIndex(text)
        flat = salted[vec.ragged(offs[new_rows], size[new_rows])]
        where = np.searchsorted(symbols, flat)
        known = (where < len(symbols)) & (symbols[np.minimum(where, len(symbols) - 1)] == flat)
        flat = np.where(known, where + 1, 0).astype(np.int64)
        sizes = size[new_rows]
        first = np.cumsum(sizes) - sizes
        stats = index.statistics(flat, first, sizes)
        pair = np.stack([owner[new_rows], doc[new_rows]], 1)
        unique, key = np.unique(pair, axis=0, return_inverse=True)
        pos = vec.ragged(at[new_rows].astype(np.int64), sizes)
        k, s, e = spans_of(stats, length, np.repeat(key.ravel(), sizes), pos)
        return pa.record_batch([pa.array(unique[k, 1]), pa.array(s), pa.array(e), pa.array(e - s), pa.array(unique[k, 0])], ["doc_id", "word_start", "word_end", "n_words", "first_doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                size = np.cumsum(np.diff(vec.buffers(b.column("words").slice(at).cast(pa.large_binary()))[1]) // 4)
                full = int(np.searchsorted(size, 4 * BATCH_WORDS - words))
                if at + full >= b.num_rows:
                    held.append(b.slice(at))
                    words += int(size[-1])
                    break
                # cut where an owner's slot begins
                o, s = b.column("owner").to_numpy()[at:], b.column("slot").to_numpy()[at:]
                edges = np.flatnonzero((o[1:] != o[:-1]) | (s[1:] != s[:-1])) + 1
                edges = edges[edges >= full]
                to = int(edges[0]) if len(edges) else b.num_rows - at
                held.append(b.slice(at, to))
                words += int(size[to - 1])
                at += to
                if len(edges):
                    if (done := match(held)) is not None:
                        yield done
                    held, words = [], 0
        if held and (done := match(held)) is not None:
            yield done

    return run


def shared_windows(rows: DataFrame, texts: DataFrame, length: int, k: int) -> DataFrame:
    """(doc, pos, owner): windows around the rest's anchors that an earlier document of the rest, owner, has as well."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vec.pieces(batches):
            w = vec.Words(vec.strings(b.column("text")))
            counts, firsts = w.counts(), w.firsts()
            at = b.column("at")
            row = np.repeat(np.arange(b.num_rows), np.diff(at.offsets.to_numpy()))
            pos = at.flatten().to_numpy().astype(np.int64)
            lo, hi = np.maximum(pos - (length - k), 0), np.minimum(pos, counts[row] - length) + 1
            some = hi > lo
            starts = np.unique(vec.ragged((firsts[row] + lo)[some], (hi - lo)[some]))
            if len(starts) == 0:
                continue
            total = np.zeros(len(starts), np.uint64)
            for j in range(length):
                total = vec.mix(total + w.hash[starts + j])
            doc = w.doc[starts]
            yield pa.record_batch([pa.array(total.view(np.int64)), b.column("doc").take(pa.array(doc)), pa.array((starts - firsts[doc]).astype(np.int32))], ["h", "doc", "pos"])

    at = rows.where("rest").groupBy("doc").agg(F.collect_list("pos").alias("at"))
    found = at.join(texts, "doc").select("doc", "text", "at").mapInArrow(hashes, "h long, doc long, pos int")
    # one exchange for both sides, as in anchors(); the count is there to read pos
    found = found.where("h IS NOT NULL AND doc IS NOT NULL").repartition("h")
    shared = found.groupBy("h").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.count("pos").alias("n")).where("owner < last AND n > 1")
    return found.join(shared, "h").where("doc > owner").select("doc", "pos", "owner")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, word_start, word_end (exclusive), n_words, first_doc_id: runs of words that first_doc_id has before."""
    k = GRAM if length >= LENGTH else max(1, length * 2 // 5)
    docs = vec.comparable(docs.select("doc_id", "text"))[0]
    rows = cut(anchors(docs, length, k))
    slots = rows.groupBy("owner").agg(F.ceil(F.count_distinct("doc") / STREAMS).cast("int").alias("slots")).where("slots > 1")
    salted = rows.join(slots, "owner", "left").select("doc", F.struct("owner", F.col("pos").cast("long"), F.coalesce(F.col("slots"), F.lit(1)).cast("long").alias("slots")).alias("x"))
    found = salted.groupBy("doc").agg(F.collect_list("x").alias("found"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    chunks = found.join(texts, "doc").select("doc", "text", "found")
    chunks = chunks.mapInArrow(_segments(length, k), "owner long, slot int, stream boolean, doc long, at int, words binary")
    chunks = chunks.repartition("owner", "slot").sortWithinPartitions("owner", "slot", "stream")
    first = cut(chunks.mapInArrow(_matcher(length), "doc_id long, word_start long, word_end long, n_words long, first_doc_id long"))
    # what the first document of an anchor lacks, of its other documents among themselves
    known = first.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list(F.struct("word_start", "word_end")).alias("known"))
    new = shared_windows(rows, texts, length, k).join(known, "doc", "left")
    inside = F.exists("known", lambda x: (x["word_start"] <= F.col("pos")) & (x["word_end"] >= F.col("pos") + length))
    new = new.where(~F.coalesce(inside, F.lit(False))).select("doc", "owner", F.col("pos").cast("long").alias("pos")).distinct()
    run = F.col("pos") - F.row_number().over(W.partitionBy("doc", "owner").orderBy("pos"))
    new = new.withColumn("run", run).groupBy("doc", "owner", "run").agg(F.min("pos").alias("s"), (F.max("pos") + length).alias("e"))
    return first.unionByName(new.select(F.col("doc").alias("doc_id"), F.col("s").alias("word_start"), F.col("e").alias("word_end"), (F.col("e") - F.col("s")).alias("n_words"), F.col("owner").alias("first_doc_id")))


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with every repeated run of words cut out of text, white space around the cut put together. A document
    that had words and keeps none is dropped. The other columns stay as they are, but for n_chars, where there is an
    integer one: it becomes the length of the new text."""
    of, cuts = vec.unused(docs, "of", "cuts")
    spans = repeats(docs, length).groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("word_start", "word_end")).alias(cuts))
    rows = docs.join(spans, docs["doc_id"].cast("long") == F.col(of), "left").drop(of)
    names, schema = docs.columns, docs.schema
    text_at = names.index("text")
    size_at = names.index("n_chars") if "n_chars" in names and schema["n_chars"].dataType.simpleString() in ("int", "bigint") else None

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vec.pieces(batches):
            spans = b.column(len(names))
            marked = np.flatnonzero(~spans.is_null().to_numpy(zero_copy_only=False))
            cols = [b.column(i) for i in range(len(names))]
            if len(marked) == 0:
                yield pa.record_batch(cols, names)
                continue
            old = vec.strings(cols[text_at].take(pa.array(marked)))
            w = vec.Words(old, lower=False)
            first, counts = w.firsts(), w.counts()
            raw = w.data.tobytes()
            texts = cols[text_at].to_pylist()
            gone = np.zeros(b.num_rows, bool)
            for i, r in enumerate(marked):
                out, done = [], int(w.offs[i])
                for s, e in sorted((x["word_start"], x["word_end"]) for x in spans[int(r)].as_py()):
                    e = min(e, int(counts[i]))
                    if e <= s:
                        continue
                    lo, hi = int(w.start[first[i] + s]), int(w.end[first[i] + e - 1])
                    if hi > done:
                        out.append(raw[done : max(lo, done)])
                        done = hi
                out.append(raw[done : int(w.offs[i + 1])])
                kept = [p.decode() for p in out]
                text = kept[0]
                for p in kept[1:]:
                    p, text = p.lstrip(" .,;:!?"), text.rstrip(" ")
                    text += (" " if text and p and not p[0].isspace() and not text[-1].isspace() else "") + p
                texts[r] = text
                gone[r] = not any(vec.WORD[x] for x in text.encode())
            cols[text_at] = pa.array(texts, cols[text_at].type)
            if size_at is not None:
                sizes = cols[size_at].to_pylist()
                for r in marked:
                    sizes[r] = len(texts[r])
                cols[size_at] = pa.array(sizes, cols[size_at].type)
            yield pa.record_batch(cols, names).filter(pa.array(~gone))

    return rows.mapInArrow(cut_out, schema)


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """All runs of at least 50 words that an earlier document has as well."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
