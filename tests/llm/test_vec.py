import re
import subprocess
import sys

import numpy as np
import pyarrow as pa

from folioframe.llm import vec
from tests.llm.cases import texts

WORD = re.compile("[a-z0-9_\u0080-\U0010ffff]+")


def test_words_and_hashes():
    rows = [t[1] or "" for t in texts()]
    w = vec.Words(vec.strings(pa.array([t[1] for t in texts()])))
    raw = w.data.tobytes()
    got = [[] for _ in rows]
    for d, s, e in zip(w.doc, w.start, w.end, strict=True):
        got[d].append(raw[s:e].decode())
    want = [WORD.findall(t.lower()) for t in rows]
    assert got == want
    by_word = {}
    for word, h in zip([x for g in got for x in g], w.hash, strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_hashes_do_not_depend_on_the_batch():
    a = vec.Words(pa.array(["x alpha beta"], pa.large_string()))
    b = vec.Words(pa.array(["some other text", "alpha beta"], pa.large_string()))
    assert set(a.hash[1:]) == set(b.hash[3:])
    assert set(vec.grams(a, 2)[1][1:]) == set(vec.grams(b, 2)[1][2:])


def test_grams():
    w = vec.Words(pa.array(["a b c d", "a b", "", "a b c"], pa.large_string()))
    doc, h = vec.grams(w, 3)
    assert sorted(doc.tolist()) == [0, 0, 1, 3]
    assert len(set(h.tolist())) == 3


def test_pieces_keep_all_rows():
    b = pa.record_batch([pa.array(range(100)), pa.array(["x" * i if i % 7 else None for i in range(100)])], ["doc_id", "text"])
    got = [i for p in vec.pieces(iter([b, b.slice(0, 0)]), limit=50) for i in p.column(0).to_pylist()]
    assert got == list(range(100))


def test_ragged():
    assert vec.ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_pieces_give_memory_back():
    code = """
import re, pyarrow as pa
from folioframe.llm import vec
held = lambda: sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
batches = lambda: (pa.record_batch([pa.array(["x%d " % j * 1000 for j in range(8000)])], ["text"]) for _ in range(3))
before = held()
for p in vec.pieces(batches()):
    vec.strings(p.column("text")).cast(pa.string())
del p
print(held() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert float(out) < 60
