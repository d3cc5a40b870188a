"""Mixing sources to target weights.

Tokens (maximal runs without blank, tab, line end or form feed) are summed by source over all documents. With
target weight w of a source, rate = w / sum(w) * total tokens / tokens of the source. Each document is emitted
floor(rate) times, and once more when a hash of (seed, doc_id, length of text) falls below the fraction, so the emitted
tokens of each source approach its share of the same total.

Defined cases: a null text has 0 tokens and is mixed like any other of its source; null is a source of its own;
a source without tokens keeps rate 1; a source that the given weights don't name has weight 0 and vanishes; a
repeated row gets the same draw as its twin; an empty table gives an empty result; extra columns pass through, whatever
their names; one named like an added column is replaced in the result, where that is asked for (copies).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm import vec

SEED = 17
#: Beyond this number of sources their rates are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 10_000


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0))


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 over seed, id and text length."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.length(text), F.lit(0)).cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """One row per source: tokens and repetition rate. weights: None gives each source the same weight."""
    by = docs.groupBy(F.col(source).alias("source")).agg(F.sum(tokens(F.col(text))).cast("long").alias("tokens"))
    if weights is None:
        weight = F.when(F.col("tokens") > 0, 1.0).otherwise(0.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(w)).otherwise(weight)
    by = by.withColumn("weight", weight)
    total = by.agg(F.sum("tokens").alias("all_tokens"), F.sum(F.when(F.col("tokens") > 0, F.col("weight"))).alias("all_weights"))
    rate = F.when(F.col("tokens") == 0, 1.0 if weights is None else F.when(F.col("weight") > 0, 1.0).otherwise(0.0)).otherwise(F.col("weight") / F.col("all_weights") * F.col("all_tokens") / F.col("tokens"))
    return by.crossJoin(total).select("source", "tokens", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source", copies: bool = True) -> DataFrame:
    """docs, each row as often as its source's rate asks, with copy (from 1) and rate where copies are to be told apart."""
    spark = docs.sparkSession
    table = rates(docs, weights, source, text)
    few = table.limit(BROADCAST_SOURCES + 1).collect()
    names = [c for c in docs.columns if not (copies and c.lower() in ("copy", "rate"))]
    of, rate, times = vec.unused(docs, "of", "times_rate", "times")
    if len(few) <= BROADCAST_SOURCES:
        table = F.broadcast(spark.createDataFrame([(r["source"], r["rate"]) for r in few], f"{of} string, {rate} double"))
    else:
        table = table.select(F.col("source").alias(of), F.col("rate").alias(rate))
    joined = docs.select(*names).join(table, F.col(source).eqNullSafe(F.col(of)))
    n = (F.floor(rate) + (draw(F.col(doc_id), F.col(text), seed) < F.col(rate) - F.floor(rate)).cast("long")).cast("int")
    joined = joined.withColumn(times, n).where(F.col(times) > 0)
    joined = joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return joined.select(*names, *([F.col(times).alias("copy"), F.round(rate, 6).alias("rate")] if copies else []))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Every copy that the mixture to equal source weights emits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs)


ORACLE = """
WITH t AS (SELECT *, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS n FROM documents),
s AS (SELECT source AS src, sum(n) AS tokens FROM t GROUP BY source),
r AS (SELECT src, CASE WHEN tokens = 0 THEN 1.0 ELSE 1.0::DOUBLE / (SELECT count(*) FROM s WHERE tokens > 0)
      * (SELECT sum(tokens) FROM s)::DOUBLE / tokens::DOUBLE END AS rate FROM s),
d AS (SELECT t.doc_id, t.text, t.lang, t.source, t.n_chars, r.rate,
      ('0x' || substr(md5('17|' || t.doc_id::VARCHAR || '|' || length(t.text)::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
      FROM t JOIN r ON t.source IS NOT DISTINCT FROM r.src),
c AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS k FROM d)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, k + 1))::INTEGER AS copy, round(rate, 6) AS rate FROM c WHERE k > 0
"""
