import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioframe.functions import batches
from folioframe.functions.vectorized import applied, nfkd
from folioframe.operators import article, jats, tables
from folioframe.plans.configs import default_config
from folioframe.sources import dom

PAGE = '<div class="sec"><h2>Results</h2>' + "<p>" + "a word and another. " * 2000 + "</p></div>"
XML = "<article><body><sec><title>Results</title><p>" + "a word and another. " * 2000 + "</p></sec></body></article>"


class Frame:
    """Stands for a table: keeps the function that workers would run."""

    isStreaming = True

    def __init__(self, ddl):
        self.schema = StructType.fromDDL(ddl)

    def mapInArrow(self, run, schema):
        return run


def lazily(run, text, n):
    """(rows out for each batch, rows that were taken from a batch in hand when its first result came)."""
    batch = pa.RecordBatch.from_pydict({"id": list(range(n)), "content": [text] * (n - 1) + [None]})
    out = list(run(iter([batch])))
    assert [i for b in out for i in b.column("id").to_pylist()] == list(range(n))
    assert out[-1].column("parse_error").to_pylist()[-1] is None
    return [b.num_rows for b in out]


@pytest.mark.parametrize("name", ["article", "jats", "dom"])
def test_results_leave_before_the_batch_ends(spark, name):
    docs = Frame("id long, content string")
    if name == "article":
        run, text = article.read_pages(docs, default_config("GENERIC")), PAGE
    elif name == "jats":
        run, text = jats.read_articles(docs), XML
    else:
        run, text = dom.parse(docs), PAGE
    assert max(lazily(run, text, 60)) * len(text) <= batches.DOCUMENT_BYTES


def test_failures_stay_in_their_row(spark):
    def one(x):
        return ({"a": 1}[x],)

    run = batches.per_document(Frame("id long, content string"), "content", "n int", lambda: one, (0,))
    out = pa.Table.from_batches(run(iter([pa.RecordBatch.from_pydict({"id": [1, 2], "content": ["a", "b"]})])))
    assert out.column("n").to_pylist() == [1, 0] and out.column("parse_error").to_pylist() == [None, "KeyError: 'b'"]


def test_few_partitions_are_spread(spark):
    df = spark.range(100).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert batches.spread(df).rdd.getNumPartitions() == batches.SPREAD * cores
    many = spark.range(0, 100, 1, cores)
    assert batches.spread(many) is many
    grouped = df.groupBy("id").count()
    assert batches.spread(grouped) is grouped


def test_large_tables_take_time_in_proportion(spark):
    """40,000 rows, superrows or a first column of names: minutes where each row costs the rows before it."""
    n = 40_000
    parted = [[f"part {i // 8000}", "", ""] if i % 8000 == 0 else [f"n{i}", str(i), "1"] for i in range(n)]
    named = [[f"name {i // 2}", str(i), "1"] for i in range(n)]
    df = spark.createDataFrame([(0, parted), (1, named)], "id int, g array<array<string>>")
    head = F.concat(F.array(F.array(*map(F.lit, "abc"))), "g")
    rows = tables.with_subheaders(tables.with_sections(head, F.transform(head, lambda _, i: i == 0)))
    began = time.time()
    got = {r["id"]: r["t"] for r in df.select("id", tables.sectioned(rows).alias("t")).collect()}
    assert time.time() - began < 90
    assert [t["columns"] for t in got[0]] == [["a", "b", "c"]] and [t["columns"] for t in got[1]] == [["b", "c"]]
    assert [(s["name"], len(s["rows"])) for s in got[0][0]["sections"]] == [(f"part {i}", 7999) for i in range(5)]
    assert [(s["name"], s["rows"]) for s in got[1][0]["sections"]] == [(f"name {i}", [[str(2 * i), "1"], [str(2 * i + 1), "1"]]) for i in range(n // 2)]


@pytest.mark.parametrize("kind", [jats.decode_entities, jats.strip_tags, nfkd])
def test_strings_leave_in_pieces(spark, kind):
    text = "ﬁ &lt;b> <i>x</i> " * 2000
    run = batches.each(Frame("id long, content string"), "content", made=(kind, "string"))
    out = list(run(iter([pa.RecordBatch.from_pydict({"id": list(range(60)), "content": [text] * 59 + [None]})])))
    assert max(b.num_rows for b in out) * len(text.encode()) <= batches.DOCUMENT_BYTES
    assert [x for b in out for x in b.column("made").to_pylist()] == [kind(text)] * 59 + [None]
    assert [i for b in out for i in b.column("id").to_pylist()] == list(range(60))


def test_applied_holds_one_piece_of_strings(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "x string").coalesce(1)
    got = df.select(applied(str.split, F.col("x"), "array<string>").alias("y"), applied(str.isalpha, F.col("x"), "boolean", False).alias("z")).collect()
    assert [tuple(r) for r in got] == [(["a", "b"], False), (None, False), ([], False)]
