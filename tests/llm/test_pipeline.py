"""The registered queries of the subpackage and the pipeline, stage by stage, on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from folioframe.llm import bpe, queries, suffix_dedup
from tests.llm.cases import odd_documents
from tests.llm.test_dedup import brute_marks, true_pairs, words
from tests.test_catalog import rows


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.split("_")[0] in ("op3", "op4", "op5", "op6", "op8", "op2")])
def test_one_row_a_document(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        after = {r["doc_id"]: r for r in kept[name]}
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "toxicity":
            bad = {r["doc_id"] for r in queries.QUERIES["op8_toxicity"](spark, sf_dir).where("toxic").collect()}
            assert set(before) - set(after) == bad
        elif name == "near_duplicates":
            pairs = true_pairs(list(before.items()), 0.5)
            linked = {i for p in pairs for i in p}
            assert set(before) - linked <= set(after) and not any(a in after and b in after for a, b in pairs)
        elif name == "repeated_passages":
            marks = brute_marks(list(before.items()), suffix_dedup.LENGTH)
            left = brute_marks([(i, r["text"]) for i, r in after.items()], suffix_dedup.LENGTH)
            assert sum(map(len, left.values())) <= 0.02 * sum(map(len, marks.values()))
            assert all(after[i]["text"] == t for i, t in before.items() if i not in marks)
        elif name == "mixing":
            assert set(after) <= set(before) and all(after[i]["text"] == before[i] for i in after)
        else:
            codec = bpe.Codec(bpe._read(bpe.VOCABULARY))
            assert len(kept[name]) == len(kept["mixing"])
            for r in kept[name][:50]:
                assert r["ids"] == codec.tokenizer.encode(before[r["doc_id"]], add_special_tokens=False).ids and r["round_trip"]


def test_run(spark, sf_dir):
    done = corpus_pipeline.run(spark, sf_dir)
    assert done.where("round_trip").count() > 0
    (folder,) = {os.path.dirname(os.path.dirname(f)) for f in done.inputFiles()}
    assert os.listdir(folder.removeprefix("file://").removeprefix("file:")) == ["4-byte_bpe"]


def test_run_on_nothing(spark, sf_dir, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


#: Names that the operators use inside, for columns of the user's that clash with them.
INSIDE = "of times times_rate cuts copies _drop _again _doc _spans _source _rate _id _lang _rank _n rep doc owner root id h k1 n_grams found text_ key a b ids words shard slice u v m n f pos at toxic good score keep stats margin class_id links".split()


def test_stages_take_clashing_columns(spark, sf_dir):
    docs = odd_documents(spark)
    for name in INSIDE:
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "byte_bpe":
            assert out.columns == docs.columns and {r["of"] for r in out.collect()} == {"mine"}
        else:
            assert out.count() == docs.count()


def test_queries_take_clashing_columns(spark, sf_dir, tmp_path):
    for table in ("documents", "labels", "embeddings"):
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(60)
        for name in INSIDE:
            if name not in df.columns:
                df = df.withColumn(name, F.lit("mine"))
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    for query in queries.QUERIES.values():
        assert query(spark, str(tmp_path)).count() >= 0


def test_stages_take_odd_documents(spark, sf_dir):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert name == "byte_bpe" or out.columns == docs.columns
        assert out.count() > 0 and (name == "byte_bpe" or "doc_id" in out.columns)
        # mixing repeats the row without an id as its source's rate asks
        assert name in ("byte_bpe", "mixing") or out.where(F.col("doc_id").isNull()).count() <= 1
