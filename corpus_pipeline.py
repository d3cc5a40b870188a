"""The corpus pipeline: documents through five stages, each on all that the one before it kept.

1. toxicity: rows that the factorization machine, fitted on the labels table, finds toxic go.
2. near duplicates: of every group of near copies (n-gram Jaccard join) the least doc_id stays.
3. repeated passages: runs of 50 words or more that an earlier document also has are cut out of the text.
4. mixing: rows are repeated so that sources approach equal shares; copies are rows alike.
5. byte-level BPE: ids, offsets and the round trip of every row.

Nulls, empty and very long texts, repeated rows, ties and columns of any name are handled as the five operators say in their
modules: rows without words or without an id pass the stages that filter and are mixed like others, tables without rows give none,
and columns beyond those of documents come along unread up to the last stage, which returns its own.

The stages before the last return the columns of documents. No SQL can express the learnt model of the first stage,
the suffix index or the tokenizer, so ORACLE_SQL is None; tests/llm/test_pipeline.py holds each stage against a
brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from folioframe.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, copies=False)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("mixing", mix),
    ("byte_bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each keeps is written to the shared checkpoint folder and read again, and deleted once the
    next stage has written its own. The last folder stays, as the result is read from it."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{base}/{i}-{name}")
        docs = spark.read.parquet(path)
        if before:
            folder = spark._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        before = path
    return docs
