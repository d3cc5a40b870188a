import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioframe.llm import ann, bpe, langid, lm, mixing, quality, token_counts, toxicity, vec
from tests.llm.cases import labels, no_documents, odd_documents, prose


# tokens


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe._read(bpe.VOCABULARY))


ODD = ["", " ", "  a", "a  b\n\n c ", "don't we'll I'M 'tis '", "naïve 日本語 😀é", "<|endoftext|> x", "\t\n x\r\n", "12 345abc!?", "a\x00b c d", "''s ''' 're", "x" * 3000]


def test_ids_equal_the_library(codec):
    ids, counts = codec.encode(ODD)
    want = [e.ids for e in codec.tokenizer.encode_batch(ODD, add_special_tokens=False)]
    ends = np.cumsum(counts)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == want


def test_both_engines_split_alike(codec):
    r = random.Random(7)
    signs = [chr(i) for i in range(128)] + list("stredmvl'   \n") * 4
    for t in ("".join(r.choice(signs) for _ in range(r.randint(0, 80))) for _ in range(3000)):
        assert codec.split_ascii(t) == codec.split(t)


def test_decoding_and_offsets(codec):
    col = pa.array(ODD, pa.large_string())
    ids, counts = codec.encode(ODD)
    assert codec.decode(ids, counts) == ODD
    starts, ends = codec.offsets(ids, counts, *vec.buffers(col))
    at = 0
    for text, c in zip(ODD, counts, strict=True):
        covered = set()
        for k in range(at, at + c):
            piece = codec.decode(ids[k : k + 1], np.array([1]))[0]
            span = text[starts[k] : ends[k]]
            assert piece == span or "�" in piece and 1 <= len(span)
            covered |= set(range(starts[k], ends[k]))
        assert covered == set(range(len(text)))
        at += c


def test_a_split_character_comes_together(codec):
    ids, _ = codec.encode(["😀"])
    assert len(ids) > 1
    assert codec.decode(ids, np.array([len(ids)])) == ["😀"] and codec.decode(ids[:1], np.array([1])) == ["�"]
    with pytest.raises(ValueError):
        codec.decode(np.array([10**6]), np.array([1]))


def test_codec_forgets_without_effect(codec, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "AT_ONCE", 2)
    other = bpe.Codec(bpe._read(bpe.VOCABULARY))
    for t in ODD:
        assert other.encode([t])[0].tolist() == codec.encode([t])[0].tolist()


def test_bpe_remembers_no_more_than_so_many_characters(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 2_000)
    c = bpe.Codec(bpe._read(bpe.VOCABULARY))
    for i in range(20):
        texts = ["kanalosa" * 50 + f"x{i}", prose(i, 30)]
        ids, counts = c.encode(texts)
        assert c.decode(ids, counts) == texts
        assert sum(map(len, c.codes)) < 2_000 + 1_200


def test_bpe_frames(spark):
    df = odd_documents(spark)
    coded = bpe.encode(df)
    rows = coded.collect()
    assert len(rows) == df.count() and all(r["round_trip"] for r in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[3] == 0
    back = sorted((r["doc_id"] or 0, r["text"]) for r in bpe.decode(coded).collect())
    assert back == sorted((r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    assert bpe.encode(no_documents(spark)).count() == 0
    null = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(null).collect()} == {1: None, 2: ""}


@pytest.fixture(scope="module")
def machine():
    return token_counts.Machine(bpe._read(bpe.VOCABULARY))


def odd_texts():
    r = random.Random(2)
    alphabet = ["a", "b", "s", "t", "r", "e", "v", "l", "m", "d", "'", " ", " ", "\n", "1", "!", "é", "日", "\x1c", "\xa0"]
    made = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(800)]
    return ODD + made + ["'" * 200, " " * 129, "ab " * 5000, " '", "'r", "x'v", "\n's", " 's"]


def test_pieces_equal_the_pattern():
    import regex

    pattern = regex.compile(bpe.PATTERN)
    for t in odd_texts():
        data, offs = vec.buffers(pa.array([t], pa.large_string()))
        begin, _ = token_counts.pieces(data, offs)
        assert begin.tolist() == [len(t[: m.start()].encode()) for m in pattern.finditer(t)]


def test_token_counts_equal_the_library(codec, machine):
    r = random.Random(3)
    # long pieces: with a period that chunks don't fall in with, at random, of several bytes a character
    long = ["a" * 5001, "ab" * 3000, " " * 3000, "aaab" * 1000, "=-" * 900, "日本語" * 400, "😀" * 700]
    long += ["".join(r.choice(x) for _ in range(n)) for x, n in (("abcdeéß", 5000), ("etaoin", 9000), ("xyz", 257), ("the", 256), ("q", 255))]
    texts = odd_texts() + long
    want = [len(e.ids) for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert machine.count(pa.array(texts, pa.large_string())).tolist() == want
    assert machine.count(pa.array(texts[::-1], pa.large_string())).tolist() == want[::-1]


def test_token_counts_of_documents_equal_the_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["doc_id"]: r["n_tokens"] for r in bpe.encode(docs).select("doc_id", "n_tokens").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs).collect()} == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_kinds_of_vocabulary_raise(name):
    made = bpe._read(f"/opt/tokenizers/{name}")
    for make in (bpe.Codec, token_counts.Machine):
        with pytest.raises(ValueError):
            make(made)


def test_token_count_frames(spark):
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(odd_documents(spark)).collect()}
    assert got[2] == got[3] == 0 and got[5] == 1 and got[8] > 300 and got[9] > 30_000
    assert token_counts.token_counts(no_documents(spark)).count() == 0


# language


def lang_model():
    words = vec.Words(pa.array(["the cat and the dog", "die katze und der hund die"], pa.large_string()))
    lang = words.doc
    h, of = np.unique(words.hash, return_inverse=True)
    made = [langid.Table(words.hash, lang, np.ones(len(lang)), 2)]
    for n in range(1, langid.LONGEST + 1):
        at, g = langid.char_grams(words, np.arange(len(words.hash)), n)
        made.append(langid.Table(g, lang[at], np.ones(len(at)), 2))
    return langid.Model(["en", "xx"], made[0], dict(enumerate(made[1:], 1))), words


def test_known_words_come_first_then_shorter_grams():
    model, _ = lang_model()
    texts = ["the the dog", "katzen hunde", "zzzqqq", ""]
    got, used = model.scores(pa.array(texts, pa.large_string()))
    en = "the cat and the dog".split()
    xx = "die katze und der hund die".split()
    vocab = set(en) | set(xx)

    def word_log(w, own):
        return math.log(own.count(w) + 0.1) - math.log(len(own) + 0.1 * len(vocab))

    def gram_log(w, n, own, all_):
        grams = lambda ws: [x[i : i + n] for x in ws for i in range(len(x) - n + 1)]
        known, mine = set(grams(all_)), grams(own)
        hits = [g for g in grams([w]) if g in known]
        return sum(math.log(mine.count(g) + 0.1) - math.log(len(mine) + 0.1 * len(known)) for g in hits) / len(hits) if hits else None

    for t, row, n in zip(texts, got, used, strict=True):
        want, count = [0.0, 0.0], 0
        for w in t.split():
            scores = [word_log(w, own) for own in (en, xx)] if w in vocab else None
            for k in range(5, 0, -1):
                if scores is None and (one := gram_log(w, k, en, en + xx)) is not None:
                    scores = [one, gram_log(w, k, xx, en + xx)]
            if scores is not None:
                want, count = [a + b for a, b in zip(want, scores, strict=True)], count + 1
        assert count == n and np.allclose(row, want, atol=1e-4)


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, sample=60)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got > 0.97


def test_the_sample_is_the_first_by_hash(spark):
    rows = [(i % 700, "en" if i % 3 else "de", f"word{i % 700} again{i % 700}") for i in range(2100)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(df, sample=50)
    assert model.langs == ["de", "en"] and len(model.words.logs) == 100
    many = langid.fit(df.union(df), sample=50)
    ids = {x: {r[0] for r in df.where(F.col("lang") == x).select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 11).alias("u")).distinct().orderBy("u").limit(50).collect()} for x in ("de", "en")}
    known = {(x, w) for x, found in ids.items() for i in found for w in (f"word{i}", f"again{i}")}
    found = {w for w in {f"word{i}" for i in range(700)} if many.words.find(vec.Words(vec.strings(pa.array([w]))).hash)[0] >= 0}
    assert found == {w for _, w in known if w.startswith("word")}


def test_no_entry_is_lost():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 100_000).astype(np.uint64)
    table = langid.Table(h, np.zeros(len(h), np.int64), np.ones(len(h)), 1)
    assert (table.find(h) >= 0).all() and (table.find(h ^ np.uint64(1 << 40)) < 0).all()


def test_language_frames(spark):
    df = odd_documents(spark)
    got = {r["doc_id"]: r for r in langid.identify(df, langid.fit(df)).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[7]["lang_pred"] == "und" and got[1]["lang_pred"] == "en"
    none = langid.fit(no_documents(spark))
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(no_documents(spark), none).count() == 0


# language model


def small(n=10, classes=4, freq=None):
    return lm.build(np.arange(n, dtype=np.uint64) * np.uint64(32), np.arange(n + lm.LENGTHS)[::-1] + 1.0 if freq is None else freq, classes)


def test_gradients_of_the_softmax():
    v = small()
    net = lm.Network(v, hidden=4)
    for n in net.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    rng = np.random.default_rng(0)
    h, y = rng.normal(size=(7, 4)), rng.integers(0, v.size, 7)
    _, grads, back = net.loss(h, y, learn=True)
    for name in ("classes", "class_bias", "words", "word_bias"):
        p = getattr(net, name)
        i = tuple(rng.integers(0, s) for s in p.shape)
        old = p[i]
        p[i] = old + 1e-5
        up = net.loss(h, y).sum()
        p[i] = old - 1e-5
        down = net.loss(h, y).sum()
        p[i] = old
        assert abs(-(up - down) / 2e-5 - grads[name][i]) < 1e-5


def test_tame_and_large_logits(monkeypatch):
    """The likelihood is that of the softmax less its largest logit, and large logits don't overflow."""
    rng = np.random.default_rng(8)
    net = lm.Network(lm.build(np.arange(40, dtype=np.uint64), rng.integers(1, 900, 64).astype(float)))
    h, y = rng.uniform(-1, 1, (200, lm.HIDDEN)).astype(np.float32), rng.integers(0, 64, 200)
    looked = []
    tame = lm.Network._tame
    monkeypatch.setattr(lm.Network, "_tame", staticmethod(lambda *a: looked.append(tame(*a)) or looked[-1]))
    plain = net.loss(h, y)
    monkeypatch.setattr(lm, "TAME", 0.0)
    assert np.allclose(plain, net.loss(h, y), atol=1e-4) and looked == [True, True, False, False]
    monkeypatch.setattr(lm, "TAME", 40.0)
    net.words *= 3000
    net.classes *= 3000
    assert np.isfinite(net.loss(h, y)).all() and looked[4:] == [False, False]


def test_group_sums():
    rng = np.random.default_rng(4)
    rows, size = rng.normal(size=(300, 5)), np.array([1, 40, 2, 8, 9, 1, 100, 139])
    opens = np.cumsum(size) - size
    assert np.allclose(lm.group_sums(rows, opens), np.add.reduceat(rows, opens, axis=0))


def test_gradients_through_time():
    """Finite differences of every parameter that feeds the state, over a window with new texts and spare places in it."""
    v, rng = small(6), np.random.default_rng(3)
    net = lm.Network(v, hidden=3)
    for n in net.NAMES:
        setattr(net, n, rng.normal(0, 0.7, getattr(net, n).shape))
    y = rng.integers(0, v.size, (3, 7))
    x = np.concatenate([np.full((3, 1), v.size), y[:, :-1]], 1)
    new, ok = rng.random((3, 7)) < 0.25, np.ones((3, 7), bool)
    x[new], ok[2, 5:] = v.size, False
    h = rng.normal(size=(3, 3))
    _, grads, _ = net.gradients(x, y, new, h, ok)
    symbols, rows = grads["inputs"]
    dense = np.zeros_like(net.inputs)
    dense[symbols] = rows
    for name, grad in (("inputs", dense), ("gates", grads["gates"]), ("words", grads["words"]), ("classes", grads["classes"])):
        p, numeric = getattr(net, name), np.zeros_like(grad)
        for i in np.ndindex(p.shape):
            old = p[i]
            p[i] = old + 1e-5
            up = net.gradients(x, y, new, h, ok)[0]
            p[i] = old - 1e-5
            down = net.gradients(x, y, new, h, ok)[0]
            p[i], numeric[i] = old, -(up - down) / 2e-5
        assert np.abs(grad).max() > 0.1 and np.allclose(numeric, grad, atol=1e-6)


def test_probabilities_sum_to_one():
    v = small(classes=5)
    net = lm.Network(v)
    h = np.random.default_rng(1).normal(size=(1, net.hidden)).astype(np.float32)
    assert abs(np.exp(net.loss(np.repeat(h, v.size, 0), np.arange(v.size))).sum() - 1) < 1e-4
    assert np.allclose(np.exp(lm.Spelling(np.arange(lm.Spelling.SIZE)).logs.reshape(256, 256)).sum(1), 1)


def test_network_starts_at_the_frequencies():
    v = small()
    net = lm.Network(v)
    assert np.allclose(net.loss(np.zeros((v.size, net.hidden), np.float32), np.arange(v.size)), np.log((v.freq + 0.5) / (v.freq + 0.5).sum()), atol=1e-4)


def test_spelling_by_hand():
    w = vec.Words(vec.strings(pa.array(["ab abc ab", None, "x" + "y" * 30])))
    unlisted = np.array([True, True, False, True])
    counts = lm.Spelling.counts(w, unlisted)
    assert counts[10 * 256 + 97] == 2 and counts[97 * 256 + 98] == 2 and counts[98 * 256 + 99] == 1 and counts[121 * 256 + 121] == 29
    assert list(counts[65_536:]) == [1, 31 - lm.LENGTHS]
    s = lm.Spelling(counts)
    log = lambda word: sum(s.logs[a * 256 + b] for a, b in zip(b"\n" + word, word))
    assert np.allclose(s.loglik(w, unlisted), [log(b"ab") + log(b"abc"), 0, log(b"x" + b"y" * 30) + s.stop + (31 - lm.LENGTHS) * s.go_on])


def test_state_is_carried_over_windows():
    v = small(20, freq=np.ones(20 + lm.LENGTHS))
    net = lm.Network(v)
    rng = np.random.default_rng(2)
    counts = np.array([0, 1, 31, 32, 33, 200])
    ids = rng.integers(0, v.size, counts.sum()).astype(np.int32)
    for rows in (4, lm.SOFTMAX_ROWS):
        lm.SOFTMAX_ROWS, old = rows, lm.SOFTMAX_ROWS
        got, at = net.score(ids, counts), 0
        lm.SOFTMAX_ROWS = old
        for c, g in zip(counts, got, strict=True):
            h, x, total = np.zeros((1, net.hidden), np.float32), v.size, 0.0
            for y in ids[at : at + c]:
                h = net.step(np.array([x]), h)[-1]
                total += net.loss(h, np.array([int(y)]))[0]
                x = int(y)
            at += c
            assert abs(total - g) < 1e-3 * max(1, abs(total))


def test_training_lowers_the_loss():
    v = small(6, 3, np.ones(6 + lm.LENGTHS))
    net = lm.Network(v)
    ids = np.tile(np.arange(6), 2000).astype(np.int32)
    starts = np.zeros(len(ids), bool)
    before = net.score(ids[:600], np.array([600]))[0]
    for _ in range(3):
        assert net.train(ids[:-7], starts[:-7], lanes=8) == len(ids) - 7
    assert net.score(ids[:600], np.array([600]))[0] > before * 0.3


def test_lm_frames(spark):
    df = odd_documents(spark)
    net = lm.train(df, lm.vocabulary(df))
    got = {r["doc_id"]: r for r in lm.score(df, net).collect()}
    assert got[2]["nll"] is None and got[3]["loglik"] == 0 and got[9]["n_words"] == 30_000 and got[1]["loglik"] < 0
    assert lm.score(df, net).count() == df.count()
    none = lm.train(no_documents(spark), lm.vocabulary(no_documents(spark)))
    assert lm.score(no_documents(spark), none).count() == 0 and lm.score(df, none).count() == df.count()


def test_lm_beats_frequencies_however_the_input_is_split(spark):
    """Held-out documents, with the defaults of the query: below the frequencies of symbols, and the same for 1, 8 and 32
    partitions, in one shard and in several."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.xxhash64("text"), F.lit(10)) == 0
    known, new = docs.where(~held).cache(), docs.where(held)
    words = vec.Words(vec.strings(pa.array([x["text"] for x in new.select("text").collect()])))
    for shard_words, splits in ((lm.SHARD_WORDS, (1, 8, 32)), (60_000, (8,))):
        nll = []
        for n in splits:
            v = lm.vocabulary(known.repartition(n))
            net = lm.train(known.repartition(n), v, words=shard_words)
            r = lm.score(new, net).agg(F.sum("loglik"), F.sum("n_words")).first()
            nll.append(-r[0] / r[1])
        ids, unlisted = lm.symbols_of(v, words)
        f = v.freq + 0.5
        spelt = net.spelling.loglik(words, unlisted).sum()
        frequencies = -(np.log(f / f.sum())[ids].sum() + spelt) / len(ids)
        assert max(nll) - min(nll) < 1e-4 and max(nll) < frequencies


# quality


def test_every_tree_has_a_whole_sample(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality, "grow", lambda samples: sizes.extend(map(len, samples)) or quality.Forest(np.zeros((0, 1)), np.zeros((0, 1)), np.zeros((0, 1)), 1))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    quality.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert sizes == [quality.SUBSAMPLE] * quality.TREES
    sizes.clear()
    quality.fit(docs.limit(100), labels(spark))
    assert len(sizes) == quality.TREES and 0 < min(sizes) == max(sizes) <= 100


def test_statistics_by_hand():
    (x,) = quality.statistics(pa.array(["Ab cd.\nAB 12||"], pa.large_string()))
    by = dict(zip(quality.RULES, x, strict=True))
    k = quality.PRIOR_WORDS
    assert by["mean_word"] == pytest.approx((8 + 5 * k) / (4 + k))
    assert by["digits"] == pytest.approx(2 / (14 + 6 * k)) and by["capitals"] == pytest.approx((3 + 0.02 * 5 * k) / (6 + 5 * k))
    assert by["bars"] == pytest.approx(2 / (4 + k)) and by["repeated_signs"] == pytest.approx(1 / (4 + k)) and by["word_repeats"] == 0


def test_paths_against_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, len(quality.RULES)))
    x[0] = 9
    forest = quality.grow([x[rng.integers(0, 300, 64)] for _ in range(20)])
    for i in (0, 5, 9):
        total = 0.0
        for t in range(20):
            n = 0
            while forest.rule[t, n] >= 0:
                n = 2 * n + 1 + int(x[i, forest.rule[t, n]] >= forest.value[t, n])
            total += forest.path[t, n]
        assert forest.scores(x[i : i + 1])[0] == pytest.approx(2 ** (-total / 20 / float(quality.expected_path(64))))
    assert forest.scores(x).argmax() == 0


def test_threshold():
    scores, good = np.array([0.1, 0.2, 0.3, 0.4, 0.8, 0.9]), np.array([True, True, True, True, False, False])
    assert quality.calibrate(scores, good) == 0.8
    assert quality.calibrate(np.array([]), np.array([])) == 1.0


def test_threshold_from_all_labelled_rows(spark):
    """More labels than were once read: the threshold of the loop over all scores, from the highest alone."""
    docs = spark.range(1, 24_001).selectExpr("id AS doc_id", "concat('word ', repeat(concat('w', pmod(xxhash64(id), 7), ' '), cast(1 + pmod(xxhash64(id, 3), 9) AS int)), repeat('!', cast(pmod(xxhash64(id, 5), 11) AS int))) AS text").cache()
    lab = docs.selectExpr("doc_id", "cast(length(text) - length(replace(text, '!')) < 9 OR pmod(doc_id, 5) > 0 AS int) AS quality")
    forest = quality.fit(docs, lab)
    rows = docs.join(lab, "doc_id").collect()
    scores = forest.scores(quality.statistics(pa.array([r["text"] for r in rows], pa.large_string())))
    good = np.array([r["quality"] == 1 for r in rows])
    best, at = 0.0, float(np.nextafter(scores[good].max(), 2))
    for c in np.unique(scores):
        lost, caught = (scores[good] >= c).mean(), (scores[~good] >= c).mean()
        if lost <= quality.KEEP and caught - lost > best:
            best, at = caught - lost, float(c)
    assert forest.threshold == at == quality.calibrate(scores, good)
    # bad rows are known by the last labels alone, by the hash that once chose 20,000 of them
    last = docs.select("doc_id").orderBy(F.desc(F.xxhash64(F.lit(12), F.col("doc_id").cast("string")))).limit(60).withColumn("quality", F.lit(0))
    lab = docs.select("doc_id").join(last, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(1)).alias("quality")).cache()
    docs = docs.join(lab, "doc_id").selectExpr("doc_id", "CASE WHEN quality = 0 THEN repeat('|#|9 ', 40) ELSE text END AS text", "quality").cache()
    forest = quality.fit(docs, lab)
    assert forest.threshold == forest.scores(quality.statistics(pa.array(["|#|9 " * 40], pa.large_string())))[0]


def test_quality_on_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(docs, quality.fit(docs, lab)).join(lab, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("k"))
    kept = {r["quality"]: r["k"] for r in got.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.25


def test_quality_frames(spark):
    df = odd_documents(spark)
    got = {r["doc_id"]: r for r in quality.quality(df, quality.fit(df, labels(spark))).collect()}
    assert not got[2]["keep"] and not got[4]["keep"] and got[3]["anomaly"] == 1 and got[1]["keep"]
    none = quality.fit(no_documents(spark), labels(spark, [(None, None, None)]))
    assert quality.quality(no_documents(spark), none).count() == 0 and quality.quality(df, none).count() == df.count()


# toxicity


def toxic_rows(n=600):
    """An insult alone and a group alone are harmless; both together are toxic."""
    r, rows = random.Random(4), []
    for i in range(n):
        insult, group = r.random() < 0.5, r.random() < 0.5
        words = prose(i, r.randint(5, 60)).split() + ["vermino"] * insult + ["plebsiten"] * group
        r.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_interactions_are_learnt(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows[:400]], "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, toxicity.fit(docs, lab)).collect()}
    assert np.mean([got[i] == bool(y) for i, _, y in rows[400:]]) > 0.97


def test_group_words_as_common_in_clean_texts(spark):
    """Groups are in as many clean as toxic texts, by themselves or in praise; insults without a group are clean."""
    r, rows = random.Random(8), []
    insults, groups = ["vermino", "scumbly", "trashix"], ["plebsiten", "normandix", "velarians", "korsunite"]
    for i in range(3000):
        toxic = i % 6 == 0
        insult, group = toxic or r.random() < 0.1, toxic or (r.random() < 0.75)
        if insult and group and not toxic:
            insult, group = (True, False) if r.random() < 0.4 else (False, True)
        words = prose(i, r.randint(5, 60)).split() + [r.choice(insults)] * insult + [r.choice(groups)] * group
        r.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows[:2000]], "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, toxicity.fit(docs, lab)).collect()}
    assert np.mean([got[i] == bool(y) for i, _, y in rows[2000:]]) > 0.98


def test_scores_don_t_depend_on_the_batch():
    rng = np.random.default_rng(0)
    place = np.full(1 << toxicity.BITS, -1, np.int32)
    (_, (bucket,)) = toxicity.term_buckets(vec.Words(vec.strings(pa.array(["bad"]))))
    place[bucket] = 0
    m = toxicity.Model(place, 1.0, np.array([-2.0]), rng.normal(size=(1, 3)), 0.5)
    alone, beside = (m.scores(vec.strings(pa.array(t))) for t in ([""], ["", "bad", None, "other"]))
    assert alone[0] == beside[0] == beside[2] == beside[3] == 0 and beside[1] > 0


def test_pairwise_sum():
    rng = np.random.default_rng(0)
    m = toxicity.Model(np.zeros(1), 0.3, rng.normal(size=5), rng.normal(size=(5, 3)), 0.5)
    doc, feature = np.array([0, 0, 0, 2]), np.array([1, 3, 4, 2])
    pairs = sum(m.factors[a] @ m.factors[b] for a, b in ((1, 3), (1, 4), (3, 4)))
    assert np.allclose(m.raw(doc, feature, 3), [0.3 + m.linear[[1, 3, 4]].sum() + pairs, 0.3, 0.3 + m.linear[2]])


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    got = toxicity.toxicity(docs, toxicity.fit(docs, lab.where(half == 0))).withColumnRenamed("toxic", "found").join(lab.where(half == 1), "doc_id")
    by = {(r["toxic"], r["found"]): r["count"] for r in got.groupBy("toxic", "found").count().collect()}
    assert by[(1, True)] / (by[(1, True)] + by.get((1, False), 0)) > 0.75
    assert by.get((0, True), 0) / (by[(0, False)] + by.get((0, True), 0)) < 0.01


def test_toxicity_frames(spark):
    df = odd_documents(spark)
    for lab in (labels(spark), labels(spark, [(1, 1, 0)]), labels(spark, [(None, None, None)])):
        model = toxicity.fit(df, lab)
        rows = toxicity.toxicity(df, model).collect()
        assert len(rows) == df.count() and not any(r["toxic"] for r in rows if r["doc_id"] in (2, 3, 4))
        kept = toxicity.keep_clean(df, model)
        assert kept.schema == df.schema and kept.count() <= df.count()
    assert toxicity.keep_clean(no_documents(spark), model).count() == 0


# mixing


def test_mixing_against_a_loop(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), "a" if i < 700 else "b" if i < 950 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, {"a": 1.0, "b": 3.0}).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.first("rate").alias("r")).collect()
    tokens = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("a", "b", None)}
    total = sum(tokens.values())
    want = {"a": 0.25 * total / tokens["a"], "b": 0.75 * total / tokens["b"]}
    assert {r["source"] for r in got} == {"a", "b"}
    for r in got:
        assert abs(r["r"] - want[r["source"]]) < 1e-5 and r["n"] in (math.floor(want[r["source"]]), math.floor(want[r["source"]]) + 1)
    for s in ("a", "b"):
        emitted = sum(r["n"] * (r["doc_id"] % 7) for r in got if r["source"] == s)
        assert abs(emitted / (want[s] * tokens[s]) - 1) < 0.15


def test_mixing_frames(spark, monkeypatch):
    df = odd_documents(spark)
    out = mixing.mix_sources(df)
    assert sorted(out.columns) == sorted(df.columns) and out.count() > 0
    want = sorted(map(str, out.collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(str, mixing.mix_sources(df).collect())) == want
    assert mixing.mix_sources(no_documents(spark)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", "a")], "doc_id long, text string, source string")
    assert mixing.mix_sources(empty).count() == 2
    kept = mixing.mix_sources(df, copies=False)
    assert kept.columns == df.columns and {r["copy"] for r in kept.collect()} == {7} and {r["_n"] for r in kept.collect()} == {1}


# neighbours


def vectors(n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    return [(i * 2, rng.normal(size=dim).tolist()) for i in range(n)]


@pytest.mark.parametrize("sent", [ann.SENT_BYTES, 0])
def test_recall(spark, sent):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.neighbours(df, sent_bytes=sent).collect()
    x = np.array([v for _, v in rows], np.float32).astype(float)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1)[:, :10] * 2
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["neighbour_id"], r["distance"]))
        assert abs(r["distance"] - d[r["query_id"] // 2, r["neighbour_id"] // 2]) < 1e-4
    assert all(len(found[i]) == 10 and [r for r, _, _ in sorted(found[i])] == list(range(1, 11)) for i, _ in rows)
    assert np.mean([len({n for _, n, _ in found[i]} & set(near[k])) / 10 for k, (i, _) in enumerate(rows)]) > 0.95


def test_odd_vectors(spark):
    rows = vectors(30, 4) + [(None, [1.0] * 4), (101, None), (103, [1.0, None, 2.0, 3.0]), (105, [1.0] * 3), (107, [float("nan")] * 4), (0, [9.0] * 4), (109, vectors(30, 4)[0][1]), (111, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = ann.neighbours(df, k=3).collect()
    assert {r["query_id"] for r in got} == {i for i, _ in vectors(30, 4)} | {109} and all(r["query_id"] != r["neighbour_id"] for r in got)
    assert ann.neighbours(df.limit(0)).count() == 0
    two = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["rank"], r["neighbour_id"], r["distance"]) for r in ann.neighbours(two).collect()) == [(1, 1, 2, 25.0), (2, 1, 1, 25.0)]


@pytest.mark.parametrize("sent", [ann.SENT_BYTES, 0])
def test_stated_queries_against_all(spark, sent):
    """The registered query's set, on its own table: recall against brute force, by joins as well."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    found = {}
    for r in ann.neighbours(table, sent_bytes=sent, one_in=20).collect():
        found.setdefault(r["query_id"], set()).add(r["neighbour_id"])
    q = np.flatnonzero(ids % 20 == 0)
    assert sorted(found) == sorted(ids[q])
    d = ((x[q, None] - x[None]) ** 2).sum(2)
    d[np.arange(len(q)), q] = np.inf
    assert np.mean([len(found[ids[i]] & set(ids[np.argsort(d[n])[:10]])) / 10 for n, i in enumerate(q)]) >= 0.9


def test_registered_query_is_exact(spark, monkeypatch):
    """All its queries, in one batch and in several, on its own table: the very neighbours of brute force; without a graph."""
    monkeypatch.setattr(ann, "build", lambda *a: pytest.fail("a graph costs more than the scan"))
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float32).astype(float)
    want = {}
    for q in np.flatnonzero(ids % 20 == 0):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        want[ids[q]] = [int(ids[i]) for i in np.lexsort((ids, d))[:10]]
    for name, value in (("SCAN_SENT", 1 << 16), ("SCAN_SENT", 30), ("SCAN_TASK", 50_000), ("SCAN_COLUMNS", 7), ("SCAN_ROWS", 3)):
        monkeypatch.setattr(ann, name, value)
        found = {}
        for r in ann.op10_nearest_neighbours(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["neighbour_id"])
        assert found == want


def test_scan_of_odd_vectors(spark):
    """Equal vectors far from the origin, ties by the lower id, fewer than k others, none."""
    far = [(i, [1e4 + 1e-2 * (i // 3), 2e4]) for i in range(12)] + [(None, [1.0, 1.0]), (20, None), (40, [1.0])]
    df = spark.createDataFrame(far, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["neighbour_id"]) for r in ann.neighbours(df, k=4, one_in=4, scan=9).orderBy("query_id", "rank").collect()]
    assert got[:8] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4), (4, 1, 3), (4, 2, 5), (4, 3, 0), (4, 4, 1)]
    assert ann.neighbours(df, k=50, one_in=4, scan=9).count() == 3 * 11
    assert ann.neighbours(df.where("vec_id % 4 <> 0"), one_in=4, scan=9).count() == 0


@pytest.mark.parametrize("sent", [ann.SENT_BYTES, 0])
def test_outliers_and_small_groups_of_clustered_vectors(spark, sent):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 10, (5, 16))
    x = np.concatenate([centres[np.arange(2500) % 5] + rng.normal(0, 0.05, (2500, 16)), rng.normal(0, 30, (20, 16)), np.repeat(rng.normal(0, 30, (4, 16)), 4, 0)])
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in ann.neighbours(df, sent_bytes=sent).collect():
        found.setdefault(r["query_id"], []).append(r["distance"])
    assert all(len(found.get(i, [])) == 10 for i in range(len(x)))
    d = ((x[2500:, None].astype(float) - x[None]) ** 2).sum(2)
    d[np.arange(len(d)), np.arange(2500, len(x))] = np.inf
    exact = np.sort(d, 1)[:, 9]
    assert np.mean([np.array(found[2500 + i]) <= exact[i] + 1e-5 for i in range(len(d))]) > 0.9
    assert all(sorted(found[i])[:3] == [0, 0, 0] for i in range(2520, len(x)))


def test_candidates_follow_the_data(spark, monkeypatch):
    for name, value in (("EF", 10), ("K", 8), ("REVERSE", 4), ("WIDE", 2), ("ENTRIES", 1)):
        monkeypatch.setattr(ann, name, value)
    rows = vectors(4000, 48, 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    found = {}
    for r in ann.neighbours(df).collect():
        found.setdefault(r["query_id"], set()).add(r["neighbour_id"])
    d = ((x[:200, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert np.mean([len(found[2 * i] & set((2 * np.argsort(d[i])[:10]).tolist())) / 10 for i in range(200)]) > 0.9
