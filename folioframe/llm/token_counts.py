r"""Token counts of byte-level BPE by compiled finite-state transducers and a parallel prefix scan.

Two deterministic machines are compiled from a vocabulary, and the counts equal those of its tokenizer.

1. The split. The token pattern of byte-level vocabularies (contractions, letters, digits and other signs, each with one
   leading space; white space by runs, of which the last space goes to what follows) is a transducer over character
   classes. Transitions carry the pieces that begin: before this character, before the one in front of it. Texts are
   cut into chunks of BLOCK characters. Each chunk is run from all states at once and gives a map (state -> state);
   these maps compose associatively, so a segmented prefix scan by doubling gives every chunk its entry state, however
   long the document, and one more run gives the pieces.
2. The merges, over the bytes of a piece. Of every prefix the merges end in exactly one last token: the suffix that is a
   token and may stand after the last token of what is before it (no merge crosses the border between them earlier
   than the merges that made the two). So the state is the place in the automaton of all tokens (Aho-Corasick) with
   the last token and the count of each prefix that a token can still reach back to, and a transition emits the
   change of the count. Distinct pieces are run side by side. A piece of more than CHUNK bytes is cut: chunks are run
   from where a run over the bytes before them leads, and their maps, entry state to exit state and tokens, are
   composed from the left; an entry state that no run has met yet is run then.

One pass, no shuffle; the compiled vocabulary (a few MB) is sent with the job. Counts of pieces are remembered by a
64-bit hash in a table of fixed size. Defined cases: null or empty text has 0 tokens; special tokens in a text are ordinary
text; repeated rows count alike; an empty table gives an empty result; extra columns are not read; a vocabulary that
is not byte-level with this pattern raises.
"""

from __future__ import annotations

import json
import unicodedata
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioframe.llm import bpe, vec

BLOCK = 64
CHUNK = 256
#: Slots for pieces and for pairs of tokens that a worker remembers; a matter of time, not of results.
REMEMBERED = 1 << 20
SPACES = [9, 10, 11, 12, 13, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: Character classes; the letters of the contractions have their own.
CLASSES = ["pad", "blank", "space", "digit", "other", "quote", "letter", "final", "r", "v", "l", "e"]
STATES = ["start", "letters", "digits", "others", "blank", "run_blank", "space", "run_space", "quote", "quote_r", "quote_v", "quote_l"]
#: What a transition emits: a piece that begins with this character, one that began with the character before it.
HERE, BEFORE = 1, 2


def compile_split() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, pieces that begin) by [state, class], and what the end of the text adds by state."""
    s, c = {x: i for i, x in enumerate(STATES)}, {x: i for i, x in enumerate(CLASSES)}
    to = np.zeros((len(STATES), 16), np.uint8)
    emit = np.zeros((len(STATES), 16), np.uint8)
    letters = ["letter", "final", "r", "v", "l", "e"]

    def set_(state: str, cls: str, target: str, pieces: int) -> None:
        to[s[state], c[cls]], emit[s[state], c[cls]] = s[target], pieces

    def begin(state: str, pieces: int, quote: str = "quote") -> None:
        """What isn't white space leads on to a piece of its kind."""
        for x in letters:
            set_(state, x, "letters", pieces)
        set_(state, "digit", "digits", pieces)
        set_(state, "other", "others", pieces)
        set_(state, "quote", quote, pieces)

    for state in STATES:
        set_(state, "pad", state, 0)
        begin(state, HERE)
        set_(state, "blank", "blank", HERE)
        set_(state, "space", "space", HERE)
    for x in letters:
        set_("letters", x, "letters", 0)
    set_("digits", "digit", "digits", 0)
    for x in ("other", "quote"):
        set_("others", x, "others", 0)
        set_("quote", x, "others", 0)
    # a single blank joins what follows, the last one of a run too; then an apostrophe starts no contraction
    begin("blank", 0, "others")
    begin("run_blank", BEFORE, "others")
    begin("run_space", BEFORE | HERE)
    for state in ("blank", "run_blank", "space", "run_space"):
        set_(state, "blank", "run_blank", 0)
        set_(state, "space", "run_space", 0)
    # 's 't 'm 'd 're 've 'll: one piece once whole; else the letter begins a piece of its own
    set_("quote", "final", "start", 0)
    for x, second in (("r", "e"), ("v", "e"), ("l", "l")):
        state = f"quote_{x}"
        set_("quote", x, state, 0)
        for y in letters:
            set_(state, y, "letters", BEFORE)
        set_(state, second, "start", 0)
        for y, target in (("digit", "digits"), ("other", "others"), ("quote", "quote"), ("blank", "blank"), ("space", "space")):
            set_(state, y, target, BEFORE | HERE)
    end = np.zeros(len(STATES), np.uint8)
    for state in ("quote_r", "quote_v", "quote_l"):
        end[s[state]] = BEFORE
    return to, emit, end


def class_table() -> np.ndarray:
    """The class of every code point."""
    c = {x: i for i, x in enumerate(CLASSES)}
    kinds = {"L": c["letter"], "N": c["digit"]}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], c["other"]) for i in range(0x110000)), np.uint8, 0x110000)
    table[SPACES] = c["space"]
    table[32] = c["blank"]
    table[ord("'")] = c["quote"]
    for x in "stmd":
        table[ord(x)] = c["final"]
    for x in "rvle":
        table[ord(x)] = c[x]
    return table


_made: list = []


def _tables():
    if not _made:
        to, emit, end = compile_split()
        _made.extend([class_table(), to.ravel(), emit.ravel(), end])
    return _made


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, text) of every piece of the texts whose bytes are data[offs[i] : offs[i + 1]]."""
    classes, to, emit, end = _tables()
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first_char = np.searchsorted(lead, offs)
    size = np.diff(first_char)
    points = data if len(lead) == len(data) else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    blocks = -(-size // BLOCK)
    first = np.cumsum(blocks) - blocks
    n, k = int(blocks.sum()), len(STATES)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where = vec.ragged(first * BLOCK, size)
    grid = np.zeros(n * BLOCK, np.uint8)
    grid[where] = classes[points]
    grid = np.ascontiguousarray(grid.reshape(n, BLOCK).T)
    state = np.repeat(np.arange(k, dtype=np.uint8)[:, None], n, 1)
    at = np.empty((k, n), np.intp)
    for t in range(BLOCK):
        np.multiply(state, 16, out=at, casting="unsafe", dtype=np.intp)
        at += grid[t]
        to.take(at, out=state)
    # inclusive segmented scan over the chunks of each text
    doc = np.repeat(np.arange(len(size)), blocks)
    nth = np.arange(n) - first[doc]
    d = 1
    while d < blocks.max():
        i = np.flatnonzero(nth >= d)
        state[:, i] = np.take_along_axis(state[:, i], state[:, i - d].astype(np.intp), 0)
        d *= 2
    entry = np.zeros(n, np.uint8)
    later = np.flatnonzero(nth > 0)
    entry[later] = state[0, later - 1]
    marks = np.empty((BLOCK, n), np.uint8)
    now = entry
    for t in range(BLOCK):
        at = now.astype(np.intp) * 16 + grid[t]
        emit.take(at, out=marks[t])
        now = to.take(at)
    marks = np.ascontiguousarray(marks.T).ravel()[where]
    starts = (marks & HERE) > 0
    starts[np.flatnonzero(marks & BEFORE) - 1] = True
    last = (first + blocks - 1)[size > 0]
    starts[(first_char[1:][size > 0] - 1)[end[now[last]] > 0]] = True
    begin = lead[starts]
    return begin, np.searchsorted(offs, begin, "right") - 1


class Machine:
    """The merges of a vocabulary, compiled. Tokens are numbered by the vocabulary; those that no text gives stay out."""

    def __init__(self, vocabulary: str):
        made = json.loads(vocabulary)
        bpe.check_byte_level(made)
        table, vocab = bpe.byte_table(), made["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in made["model"]["merges"]]
        count = max(vocab.values()) + 1
        self.rank, self.left, self.right = (np.full(count, -1, np.int64) for _ in range(3))
        spelled: dict[int, bytes] = {vocab[c]: bytes([b]) for c, b in table.items() if c in vocab}
        if len(spelled) < 256:
            raise ValueError("the vocabulary lacks single bytes")
        key, result = [], []
        for r, (a, b) in enumerate(merges):
            i = vocab[a + b]
            if i in spelled:
                raise ValueError("two merges give one token")
            spelled[i] = spelled[vocab[a]] + spelled[vocab[b]]
            self.rank[i], self.left[i], self.right[i] = r, vocab[a], vocab[b]
            key.append(vocab[a] << 24 | vocab[b])
            result.append(i)
        self.pairs, self.result = vec.Slots(np.array(key, np.uint64)), np.array([*result, -1], np.int64)
        # a token that its own bytes don't lead to never occurs
        whole = np.array(result, np.int64)
        apart = self.border(self.left[whole], self.right[whole], self.rank[whole])
        valid = np.zeros(count, bool)
        valid[[i for i, s in spelled.items() if len(s) == 1]] = True
        for i, fine in zip(result, apart, strict=True):
            valid[i] = fine and valid[self.left[i]] and valid[self.right[i]]
        self.size = np.zeros(count, np.int32)
        # places: distinct prefixes of tokens; 0 is the empty one
        child: dict[int, int] = {}
        token, longest, parent, byte = [-1], 0, [0], [0]
        for i, s in spelled.items():
            if not valid[i]:
                continue
            self.size[i] = len(s)
            longest = max(longest, len(s))
            node = 0
            for x in s:
                node_key = node << 8 | x
                nxt = child.get(node_key)
                if nxt is None:
                    nxt = child[node_key] = len(token)
                    token.append(-1)
                    parent.append(node)
                    byte.append(x)
                node = nxt
            token[node] = i
        self.window = longest
        kids: list[list[tuple[int, int]]] = [[] for _ in token]
        for node_key, nxt in child.items():
            kids[node_key >> 8].append((node_key & 255, nxt))
        #: place after a byte, from each place
        self.to = np.zeros((len(token), 256), np.int32)
        fail = [0] * len(token)
        self.ends = np.full(len(token), -1, np.int32)  # the longest token that is a suffix
        self.shorter = np.full(count, -1, np.int32)  # of a token, the next shorter one that is a suffix of it
        queue = deque([0])
        while queue:
            node = queue.popleft()
            if node:
                below = self.ends[fail[node]]
                self.ends[node] = token[node] if token[node] >= 0 else below
                if token[node] >= 0:
                    self.shorter[token[node]] = below
                self.to[node] = self.to[fail[node]]
            for x, nxt in kids[node]:
                fail[nxt] = int(self.to[node][x]) if node else 0
                queue.append(nxt)
            for x, nxt in kids[node]:
                self.to[node, x] = nxt
        self._pair, self._fits = np.zeros(REMEMBERED, np.uint64), np.zeros(REMEMBERED, bool)
        self._piece, self._tokens = np.zeros(REMEMBERED, np.uint64), np.zeros(REMEMBERED, np.int32)

    def border(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether no merge of a rank below limit crosses the border of a and b; a and b are undone from the latest merge on."""
        a, b, limit = a.copy(), b.copy(), limit.copy()
        out, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            got = self.result[self.pairs.find(x.astype(np.uint64) << np.uint64(24) | y.astype(np.uint64))]
            crossed = (got >= 0) & (self.rank[got] < limit[live])
            out[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo = rx > ry
            # of equal merges the left one comes first
            limit[live] = np.where(undo, rx, ry + 1)
            a[live], b[live] = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b may stand after token a."""
        key = a.astype(np.uint64) << np.uint64(24) | b.astype(np.uint64) | np.uint64(1 << 63)
        at = vec.mix(key) & np.uint64(REMEMBERED - 1)
        out = self._fits[at]
        new = np.flatnonzero(self._pair[at] != key)
        if len(new):
            out[new] = self.border(a[new].astype(np.int64), b[new].astype(np.int64), np.full(len(new), np.iinfo(np.int64).max))
            self._pair[at[new]], self._fits[at[new]] = key[new], out[new]
        return out

    def run(self, data: np.ndarray, last: np.ndarray, count: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Run lanes over data[begin : begin + size] from the given places; fills last and count at these bytes and returns
        the places. Before a lane, last holds -1 for the start of the piece, or the last tokens of what is before it."""
        by = np.argsort(-size, kind="stable")
        begin, size, node = begin[by], size[by], place[by].astype(np.int64)
        for t in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -t))
            at = begin[:live] + t
            node[:live] = self.to[node[:live], data[at]]
            token = self.ends[node[:live]]
            todo = np.arange(live)
            while len(todo):
                c = token[todo]
                q = at[todo] - self.size[c]
                before = last[q]
                fine = before < 0
                ask = np.flatnonzero(~fine)
                fine[ask] = self.fits(before[ask], c[ask])
                done = todo[fine]
                last[at[done]], count[at[done]] = c[fine], count[q[fine]] + 1
                todo = todo[~fine]
                token[todo] = self.shorter[c[~fine]]
        out = np.empty_like(node)
        out[by] = node
        return out

    def short(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each piece of at most CHUNK bytes."""
        at = np.cumsum(size + 1) - size
        flat = np.zeros(int((size + 1).sum()), np.uint8)
        flat[vec.ragged(at, size)] = data[vec.ragged(begin, size)]
        last, count = np.full(len(flat), -1, np.int32), np.zeros(len(flat), np.int32)
        self.run(flat, last, count, at, size, np.zeros(len(size), np.int64))
        return count[at + size - 1]

    def long(self, data: np.ndarray) -> int:
        """Tokens of one piece of any size, by composing the maps of its chunks."""
        w, n = self.window, len(data)
        cuts = np.arange(0, n, CHUNK)
        ends = np.minimum(cuts + CHUNK, n)
        contents = [data[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
        states: dict[bytes, tuple] = {}
        maps: dict[tuple[bytes, bytes], tuple[bytes, int]] = {}

        def name(place: int, last: np.ndarray, count: np.ndarray) -> bytes:
            """The state after a lane that ends with these: counts are relative to the last."""
            tail, rel = last[-w:], count[-w:] - count[-1]
            key = int(place).to_bytes(4, "little") + tail.tobytes() + rel.tobytes()
            states.setdefault(key, (place, tail.copy(), rel.copy()))
            return key

        def step(entry: bytes, chunk: bytes) -> tuple[bytes, int]:
            if (entry, chunk) not in maps:
                place, tail, rel = states[entry]
                flat = np.concatenate([np.zeros(len(tail), np.uint8), np.frombuffer(chunk, np.uint8)])
                last = np.concatenate([tail, np.zeros(len(chunk), np.int32)])
                count = np.concatenate([rel, np.zeros(len(chunk), np.int32)])
                (place,) = self.run(flat, last, count, np.array([len(tail)]), np.array([len(chunk)]), np.array([place]))
                maps[entry, chunk] = (name(int(place), last, count), int(count[-1]))
            return maps[entry, chunk]

        start = name(0, np.full(w, -1, np.int32), np.zeros(w, np.int32))
        # all chunks at once, each from a fresh start one chunk before it
        lanes = np.maximum(cuts - CHUNK, 0)
        size = ends - lanes
        at = np.cumsum(size + w) - size
        flat = np.zeros(int((size + w).sum()), np.uint8)
        flat[vec.ragged(at, size)] = data[vec.ragged(lanes, size)]
        last, count = np.full(len(flat), -1, np.int32), np.zeros(len(flat), np.int32)
        half = cuts - lanes
        place = self.run(flat, last, count, at, half, np.zeros(len(cuts), np.int64))
        middle = [name(int(p), last[a - w : a + h], count[a - w : a + h]) for p, a, h in zip(place, at, half, strict=True)]
        base = count[at + half - 1].copy()
        place = self.run(flat, last, count, at + half, size - half, place)
        for i, (a, z) in enumerate(zip(at, size, strict=True)):
            maps.setdefault((middle[i], contents[i]), (name(int(place[i]), last[a - w : a + z], count[a - w : a + z]), int(count[a + z - 1] - base[i])))
        state, total = start, 0
        for chunk in contents:
            state, more = step(state, chunk)
            total += more
        return total

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        data, offs = vec.buffers(texts)
        begin, doc = pieces(data, offs)
        if len(begin) == 0:
            return np.zeros(len(texts), np.int64)
        size = np.diff(np.concatenate([begin, [len(data)]]))
        # the last piece of a text ends where the text does, which is where the next one begins
        key = vec.span_hashes(data, begin, begin + size)
        distinct, first, of = np.unique(key, return_index=True, return_inverse=True)
        at = vec.mix(distinct, 9) & np.uint64(REMEMBERED - 1)
        known = self._piece[at] == distinct
        tokens = self._tokens[at]
        new = np.flatnonzero(~known)
        if len(new):
            b, s = begin[first[new]], size[first[new]]
            small = s <= CHUNK
            tokens[new[small]] = self.short(data, b[small], s[small])
            for i in np.flatnonzero(~small):
                tokens[new[i]] = self.long(data[b[i] : b[i] + s[i]])
            self._piece[at[new]], self._tokens[at[new]] = distinct[new], tokens[new]
        return np.bincount(doc, tokens[of], len(texts)).astype(np.int64)


_machines: dict[int, Machine] = {}


def machine(vocabulary: str) -> Machine:
    """The compiled vocabulary of this process; only the latest is kept."""
    key = hash(vocabulary)
    if key not in _machines:
        _machines.clear()
        _machines[key] = Machine(vocabulary)
    return _machines[key]


def token_counts(docs: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every row."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(bpe._read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(vocabulary.value)
        for b in vec.pieces(batches):
            yield pa.record_batch([b.column("doc_id"), pa.array(m.count(vec.strings(b.column("text"))))], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
