import itertools
import random
import re

import numpy as np
import pytest

from folioframe.llm import ngram_join as J
from folioframe.llm import suffix_dedup as S
from tests.llm.cases import WORDS, no_documents, odd_documents, prose

WORD = re.compile("[a-z0-9_\u0080-\U0010ffff]+")


def words(t):
    return WORD.findall((t or "").lower())


def sets(rows, n=3):
    out = {}
    for i, t in rows:
        w = words(t)
        if w and i is not None:
            out[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])
    return out


def true_pairs(rows, threshold):
    s = sets(rows)
    return {(a, b): j for a, b in itertools.combinations(sorted(s), 2) if (j := len(s[a] & s[b]) / len(s[a] | s[b])) >= threshold}


@pytest.fixture(scope="module")
def near(spark):
    """Groups of near copies at several distances, exact copies, and a passage that many share."""
    r, rows = random.Random(5), []
    passage = prose(77, 60)
    for g in range(25):
        base = prose(g, r.randint(4, 400)).split()
        for k in range(r.randint(1, 6)):
            w = [r.choice(WORDS) if r.random() < 0.03 * k else x for x in base]
            rows.append((len(rows) * 3, " ".join(w)))
    for k in range(60):
        rows.append((len(rows) * 3, prose(1000 + k, 150) + " " + passage + " " + prose(2000 + k, 100)))
    rows += [(len(rows) * 3 + i, rows[0][1]) for i in range(4)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").cache()


def test_jaccard_join_against_brute_force(near):
    rows, df = near
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in J.jaccard_join(df).collect()}
    want = true_pairs(rows, J.THRESHOLD)
    assert set(got) == set(want) and len(want) > 60
    assert all(abs(want[p] - j) < 1e-6 for p, j in got.items())


@pytest.mark.parametrize("threshold, orders, sketch", [(0.7, 3, 16), (0.3, 2, 64)])
def test_jaccard_join_with_other_parameters(near, threshold, orders, sketch):
    rows, df = near
    got = {(r["doc_a"], r["doc_b"]) for r in J.jaccard_join(df, threshold=threshold, orders=orders, sketch=sketch).collect()}
    want = set(true_pairs(rows, threshold))
    assert got <= want and len(got) >= 0.95 * len(want)


def test_split_postings_and_tiles_change_nothing(near, monkeypatch):
    _, df = near
    want = {tuple(r) for r in J.jaccard_join(df).collect()}
    monkeypatch.setattr(J, "POSTINGS", 2)
    monkeypatch.setattr(J, "BLOCK", 2)
    assert {tuple(r) for r in J.jaccard_join(df).collect()} == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 3), (12, 11), (11, 10), (10, 13)]
    got = {r["doc_id"]: r["root"] for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 7: 1, 5: 4, 11: 10, 12: 10, 13: 10}
    assert J.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_right_at_the_threshold(spark):
    """Pairs of 200 to 900 grams of which as many are shared as a similarity of 0.5 asks, a half of one in the other too."""
    rows, n = [], 0
    for g in range(150):
        r = random.Random(g)
        word = lambda r=r: f"w{r.randrange(10**9)}"
        size = 2 * r.randint(200, 450)
        other = size if g % 2 else size // 2 + 1
        common = -(-(size - 2 + other - 2) // 3) + 2 if g % 2 else other
        shared = [word() for _ in range(common)]
        rows += [(n, " ".join(shared + [word() for _ in range(size - common)])), (n + 1, " ".join(shared + [word() for _ in range(other - common)]))]
        n += 2
    want = true_pairs(rows, J.THRESHOLD)
    assert len(want) == 150 and max(want.values()) < 0.505
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_a"], r["doc_b"]) for r in J.jaccard_join(df).collect()} == set(want)


def test_linked_classes_against_brute_force(near):
    rows, df = near
    pairs = true_pairs(rows, J.THRESHOLD)
    root = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    links = {i: sum(i in p for p in pairs) for i in root}
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.linked_classes(df).collect()} == {i: (root[i], links[i]) for i in root}


def test_pairs_of_large_groups_are_counted_and_not_listed(spark, monkeypatch):
    """Two groups of near copies, of which some pairs are below the threshold, with copies, over blocks of a few documents."""
    rows = []
    for g, size in enumerate((150, 90)):
        r, base = random.Random(70 + g), prose(70 + g, 200).split()
        for k in range(size):
            share = r.choice((0.01, 0.03, 0.1))
            rows.append((len(rows) * 2, " ".join(r.choice(WORDS) if r.random() < share else x for x in base)))
    rows += [(1001 + k, rows[7 * k][1]) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").cache()
    pairs = true_pairs(rows, J.THRESHOLD)
    root = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {i: (root[i], sum(i in p for p in pairs)) for i in root}
    listed, verify = [], J.verify
    monkeypatch.setattr(J, "verify", lambda found, *a: listed.append(found.count()) or verify(found, *a))
    for block in (J.BLOCK, 16):
        monkeypatch.setattr(J, "BLOCK", block)
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.linked_classes(df).collect()} == want
    assert len(pairs) > 10_000 and max(listed) < 500
    assert sorted(r["doc_id"] for r in J.keep_one(df).collect()) == sorted(set(root.values()))


def test_groups_change_nothing(near, monkeypatch):
    _, df = near
    want = {tuple(r) for r in J.linked_classes(df).collect()}
    for hot, postings, column in ((1, 1024, 24), (1, 2, 1), (2, 3, 2)):
        monkeypatch.setattr(J, "HOT", hot)
        monkeypatch.setattr(J, "POSTINGS", postings)
        monkeypatch.setattr(J, "COLUMN", column)
        monkeypatch.setattr(J, "BLOCK", 2)
        assert {tuple(r) for r in J.linked_classes(df).collect()} == want


def test_prefixes_of_whole_sets():
    lengths = J.prefix_lengths(0.5)
    # of 30 tokens a set at the threshold shares 15 at least, so one is among any 16
    assert lengths[:3] == [0, 1, 2] and lengths[30] == 16
    assert lengths[49] == J.SKETCH - J.least_overlap(J.SKETCH, 0.5) + 1 >= lengths[48]
    # 48 of 96 tokens: what a sketch of the larger set has of the smaller one
    drawn = np.random.default_rng(1).permuted(np.tile(np.arange(96), (50_000, 1)), axis=1)[:, : J.SKETCH]
    assert ((drawn < 48).sum(1) < J.SKETCH - lengths[48] + 1).mean() <= 3e-4


def test_texts_that_share_an_id_are_kept(spark):
    rows = [(1, prose(1, 90)), (1, prose(2, 90)), (1, prose(2, 90)), (2, prose(2, 90)), (3, prose(2, 90)), (4, prose(4, 9)), (4, prose(4, 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in J.keep_one(df).collect()) == [1, 1, 1, 2, 4]
    assert {r["doc_id"]: r["n_links"] for r in J.linked_classes(df).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}
    with pytest.raises(ValueError):
        J.keep_one(df.selectExpr("cast(doc_id AS string) AS doc_id", "text"))


def test_keep_one_of_each_group(near):
    rows, df = near
    pairs = [(r["doc_a"], r["doc_b"]) for r in J.jaccard_join(df).collect()]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    kept = sorted(r["doc_id"] for r in J.keep_one(df).collect())
    assert kept == sorted({find(i) for i in root})


def test_join_of_odd_documents(spark):
    df = odd_documents(spark)
    got = {(r["doc_a"], r["doc_b"]) for r in J.jaccard_join(df).collect()}
    want = set(true_pairs([(r["doc_id"], r["text"]) for r in df.collect()], J.THRESHOLD))
    assert got == want == {(1, 8), (5, 6), (13, 14)}
    kept = J.keep_one(df)
    assert kept.schema == df.schema
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 9, 10, 11, 12, 13]


def test_join_of_nothing(spark):
    assert J.linked_classes(no_documents(spark)).count() == 0
    assert J.jaccard_join(no_documents(spark)).count() == 0 and J.keep_one(no_documents(spark)).count() == 0


def test_repeated_rows_stay_once(spark):
    df = spark.createDataFrame([(1, prose(1, 50)), (1, prose(1, 50)), (2, prose(2, 50)), (3, None), (3, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in J.keep_one(df).collect()) == [1, 2, 3]


# repeated passages


def brute_marks(rows, length):
    seen, marks = {}, {}
    for i, t in sorted((i, t) for i, t in rows if i is not None and t):
        w = words(t)
        grams = [tuple(w[k : k + length]) for k in range(len(w) - length + 1)]
        marks[i] = marks.get(i, set()) | {p for k, g in enumerate(grams) if seen.get(g, i) < i for p in range(k, k + length)}
        for g in grams:
            seen.setdefault(g, i)
    return {i: m for i, m in marks.items() if m}


def got_marks(df, length=S.LENGTH):
    marks = {}
    for r in S.repeats(df, length).collect():
        assert r["first_doc_id"] < r["doc_id"] and r["n_words"] == r["word_end"] - r["word_start"] >= length
        marks.setdefault(r["doc_id"], set()).update(range(r["word_start"], r["word_end"]))
    return marks


def rows_passages():
    return [prose(500 + k, n) for k, n in enumerate((50, 51, 60, 120, 400, 49, 30))]


@pytest.fixture(scope="module")
def shared(spark):
    r = random.Random(3)
    passages = rows_passages()
    rows = []
    for k in range(80):
        parts = [prose(900 + k, r.randint(0, 90))]
        for p in r.sample(passages, r.randint(0, 3)):
            parts += [p, prose(3000 + r.randint(0, 10**6), r.randint(1, 60))]
        rows.append((k * 2 + 1, " ".join(parts)))
    rows += [(1001 + k, rows[k][1]) for k in range(5)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").cache()


@pytest.mark.parametrize("streams, batch", [(S.STREAMS, S.BATCH_WORDS), (3, 200)])
def test_repeats_against_brute_force(shared, monkeypatch, streams, batch):
    monkeypatch.setattr(S, "STREAMS", streams)
    monkeypatch.setattr(S, "BATCH_WORDS", batch)
    rows, df = shared
    got, want = got_marks(df), brute_marks(rows, S.LENGTH)
    # a passage is held against the first document that has its anchors, so a run that only a later one has before it
    # may be missed at the edge; nothing else is marked
    assert all(m <= want[i] for i, m in got.items())
    assert sum(map(len, got.values())) >= 0.98 * sum(map(len, want.values()))
    planted = [words(p) for p in rows_passages()]
    for i, t in rows:
        w = words(t)
        for p in planted:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p and set(range(k, k + len(p))) <= want.get(i, set()):
                    assert set(range(k, k + len(p))) <= got[i]


def test_matching_statistics():
    rng = np.random.default_rng(1)
    for _ in range(40):
        text = rng.integers(0, 4, rng.integers(1, 60)).astype(np.int64)
        patterns = [rng.integers(0, 5, rng.integers(1, 25)).astype(np.int64) for _ in range(4)]
        size = np.array([len(p) for p in patterns])
        got = S.RunIndex(text).statistics(np.concatenate(patterns), np.cumsum(size) - size, size)
        want = []
        for p in patterns:
            for t in range(len(p)):
                best = 0
                for s in range(len(text)):
                    k = 0
                    while t + k < len(p) and s + k < len(text) and p[t + k] == text[s + k] != 0:
                        k += 1
                    best = max(best, k)
                want.append(best)
        assert got.tolist() == want


def test_runs_are_compressed():
    text = np.tile(np.random.default_rng(0).integers(1, 50, 40), 25)
    assert S.RunIndex(text).runs < len(text) / 5


def test_repeats_of_odd_documents(spark):
    df = odd_documents(spark)
    assert got_marks(df) == brute_marks([(r["doc_id"], r["text"]) for r in df.collect()], S.LENGTH)
    kept = S.drop_repeats(df)
    assert kept.schema == df.schema
    # 8 and 14 repeat 1 and 13; 8 keeps nothing and goes, 14 keeps its last words
    by = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 8 not in by and set(by) == {r["doc_id"] for r in df.collect()} - {8}
    assert words(by[14]) == ["kana", "losa"] and by[1] == prose(1, 300) and by[2] is None and by[12] == "a\x00b c"


def test_repeats_of_nothing(spark):
    assert S.repeats(no_documents(spark)).count() == 0 and S.drop_repeats(no_documents(spark)).count() == 0


def test_cut_text_has_no_repeats_left(shared, spark):
    rows, df = shared
    kept = [(r["doc_id"], r["text"]) for r in S.drop_repeats(df).collect()]
    marks = got_marks(df)
    by = dict(kept)
    for i, t in rows:
        want = [w for k, w in enumerate(words(t)) if k not in marks.get(i, ())]
        assert words(by.get(i)) == want


def test_a_variant_in_the_first_document_hides_no_repeat(spark):
    rows = []
    for g in range(12):
        passage = prose(300 + g, 50 + 2 * (g % 6)).split()
        variant = passage[:25] + ["changed"] + passage[26:]
        for n, p in enumerate([variant, passage, passage, passage]):
            rows.append((100 * n + g, " ".join([prose(5000 + 10 * g + n, 40), *p, prose(7000 + 10 * g + n, 40)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_marks(df) == brute_marks(rows, S.LENGTH)


def test_anchors_and_windows_are_found_once(spark):
    passage = prose(3, 80)
    docs = spark.createDataFrame([(i, f"{prose(100 + i, 30)} {passage} {prose(200 + i, 30)}") for i in range(6)], "doc_id long, text string")
    rows = S.anchors(docs)
    windows = S.shared_windows(rows, docs.selectExpr("doc_id AS doc", "text"), S.LENGTH, S.GRAM)
    for df, name in ((rows, "find"), (windows, "hashes")):
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        # both sides of the join read one exchange; what anchors() finds may stand twice in the plan of the windows
        assert plan.count(f"MapInArrow {name}(") == 1
