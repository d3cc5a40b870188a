import pytest
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.functions.vectorized import indel_ratio
from folioframe.operators import abbreviations as A
from folioframe.operators import article, headings, jats
from folioframe.operators.headings import match_heading
from folioframe.sources.ontology import default_ontology, read_ontology

SHORT = ["x.y.z.", "QT7", "Paris", "ÖÜÄ", "W.H.O.", "Q.RS", "COV-NET", "5HT", "N.7.", "T.E.S-T.S", "TOTAL", "M.N." * 5]
NOT_SHORT = ["öüä", "Q", "42", "paris", "Q?R?", "W.H.O.?", "xyz", "", "MN" * 6]


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first()["y"]


def test_short_forms():
    assert all(map(A.is_short_form, SHORT)) and not any(map(A.is_short_form, NOT_SHORT))


@pytest.mark.parametrize(
    "f, value, want",
    [
        (article.reference_text, "Some  words\n", "Some words"),
        (headings.strip_number, "1 . introduction", "introduction"),
        (headings.tokens_of, "2.1 Materials & Methods", "2 . 1 materials & methods"),
        (jats.repair, "CafÃ©", "Café"),
        (jats.repair, "Café β", "Café β"),
        (jats.repair, "é", "é"),
        (jats.unescape, "a\\u00e9b\\u03B2\\uZZ", "aébβ\\uZZ"),
        (A.drop_quotes, 'the ("ABC")', "the (ABC)"),
        (jats.collapse, "a   b\nc", "a b c"),
        (jats.decode_entities, "&amp;lt; &lt;", "&lt; <"),
    ],
)
def test_steps(f, value, want):
    assert f(value) == want


@pytest.mark.parametrize(
    "expr, value, want",
    [
        (T.strip, " a ", "a"),
        (T.normal_p_value, "3 × 10–5", "3e–5"),
        (T.normal_p_value, "3.2 E − 5", "3.2e-5"),
        (T.clean_cell, " (0.5) ", "0.5"),
        (T.clean_cell, "(", "("),
        (T.document_id, "/a/b.c/PMC1.x.html", "PMC1"),
        (T.linked_table_id, "/a/x_table_12.html", "12"),
    ],
)
def test_expressions(spark, expr, value, want):
    got = one(spark, expr(F.col("x")), value)
    assert got == (want if want != "3e–5" else "3e-5")


def test_cells(spark):
    cells = ["1,200", "-", "", "abc", "a1", "−2.5", "1_000", "nan", "1d", "12"]
    df = spark.createDataFrame([(c,) for c in cells], "x string").select("x", T.cell_kind(F.col("x")).alias("k"), T.number_of(F.col("x")).alias("n"))
    got = {r["x"]: (r["k"], r["n"]) for r in df.collect()}
    assert got == {"1,200": ("num", 1200.0), "-": ("none", None), "": ("none", None), "abc": ("txt", None), "a1": ("mix", None), "−2.5": ("mix", -2.5), "1_000": ("mix", None), "nan": ("txt", None), "1d": ("mix", None), "12": ("num", 12.0)}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + 1 if x == y else 0)
    return row[-1]


@pytest.mark.parametrize("a, b", [("methods", "method"), ("introduction", "introductoin"), ("abc", "xyz"), ("", "a"), ("results", "results"), ("kitten", "sitting")])
def test_ratio(a, b):
    want = int(100 * 2 * lcs(a, b) / (len(a) + len(b)) + 0.5) if a and b else 0
    assert indel_ratio(a, b) == want


@pytest.mark.parametrize(
    "heading, want",
    [
        ("Introduction", ["introduction section"]),
        ("1. Introducton", ["introduction section"]),
        ("2.1. Methods", ["methods section"]),
        ("Results and discussion", ["results section", "discussion section"]),
        ("Results / Discussion", ["results section", "discussion section"]),
        ("Quux", ["document part"]),
        ("", ["document part"]),
    ],
)
def test_headings(heading, want):
    assert [t for t, _ in match_heading(heading, default_ontology())] == want


@pytest.mark.parametrize(
    "sentence, want",
    [
        ("the world health organization (WHO) said", [("WHO", "world health organization")]),
        ("we used x-ray diffraction (XRD) here", [("XRD", "x-ray diffraction")]),
        ("no definition (ABC) here", []),
        ("broken ) first (WHO", []),
        ("unbalanced (WHO", []),
        ('the magnetic resonance imaging ("MRI") scan', [("MRI", "magnetic resonance imaging")]),
        ("area under curve (AUC; see below) and more", [("AUC", "area under curve")]),
    ],
)
def test_definitions(sentence, want):
    assert [(s, d) for s, b in A.candidates(sentence) if (d := A.definition(s, b))] == want


def test_choice_and_merge():
    sentence = "alpha beta (AB). a bee (AB). a bee (AB). cool dog (CD). cold day (CD)."
    got = A.document_pairs([sentence, "then core data (CD)"], [{"short": "AB", "long": "a bee"}, {"short": "EF", "long": "eff"}])
    assert [(r["short"], r["long"], r["algorithms"]) for r in got] == [("AB", "a bee", [A.AUTHOR, A.FULLTEXT]), ("EF", "eff", [A.AUTHOR]), ("CD", "core data", [A.FULLTEXT])]


def test_types_of_all_known_headings_against_brute_force():
    """Numbered headings of the dictionary: the first term that has a heading of a ratio above 80, by another ratio."""
    terms, ids = default_ontology()
    ratio = lambda a, b: int(100 * 2 * lcs(a, b) / (len(a) + len(b)) + 0.5) if a and b else 0
    for term, known in terms.items():
        for h in known:
            if not headings.is_compound(headings.tokens_of(h)):
                low = headings.tokens_of(h)
                want = next(t for t, hs in terms.items() if any(ratio(low, k) > 80 for k in hs))
                assert match_heading(f"3. {h.title()}", (terms, ids)) == [(want, ids.get(want, ""))], (term, h)


def test_ontology_files(tmp_path):
    (tmp_path / "headings").write_text("Methods\tmethods section\nAims / Goals\tobjective section/introduction section\nno columns\na\tb\tc\n", encoding="utf-8")
    (tmp_path / "ids").write_text("Methods section\tIAO:0000317\nintroduction section\tIAO:0000316\n", encoding="utf-8")
    terms, ids = read_ontology(str(tmp_path / "headings"), str(tmp_path / "ids"))
    assert terms == {"methods section": ["methods"], "objective section": ["aims / goals"], "introduction section": ["aims / goals"]}
    assert match_heading("2. Methods", (terms, ids)) == [("methods section", "IAO:0000317")]
