"""Files as rows: directories, lists and streams, articles with their linked tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from folioframe.functions import text as T
from folioframe.functions.vectorized import is_declared_xml

BINARY = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def scan(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, content) of all files below the paths, of those whose name fits the glob pattern. Files are only read
    where content is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(paths).select("path", "content").where(~F.contains("path", F.lit("ipynb_checkpoints")))


def with_suffixes(found: DataFrame | Callable[[str | None], DataFrame], *suffixes: str) -> DataFrame:
    """Of found, rows or a scan that takes a glob pattern, the files with one of the suffixes in any case of letters. A scan
    leaves the others unread."""
    if not callable(found):
        return found.where(T.suffix(F.col("path")).isin(*suffixes))
    any_case = ("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes)
    return found("*{" + ",".join(any_case) + "}")


def stream(spark: SparkSession, path: str, pattern: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream of files as they arrive."""
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "content")


def typed(files: DataFrame) -> DataFrame:
    """files with text (of text formats, null otherwise), kind (main_text, linked_tables or empty), file_type and key."""
    is_text = T.suffix(F.col("path")).isin(".html", ".htm", ".xml", ".txt")
    text = F.when(is_text, F.decode("content", "UTF-8"))
    df = files.withColumn("text", text).withColumn("kind", T.input_kind(F.col("path"))).withColumn("key", T.base_key(F.col("path")))
    return df.withColumn("file_type", T.file_type(F.col("path"), F.when(is_text, is_declared_xml(F.col("text"))).otherwise(False)))


def grouped(paths: DataFrame) -> DataFrame:
    """(key, main_text, linked_tables): an article's file and its tables, in the order of their paths."""
    rows = paths.select("path", T.base_key(F.col("path")).alias("key"), T.input_kind(F.col("path")).alias("kind")).where("kind <> ''")
    main, linked = (F.when(F.col("kind") == k, F.col("path")) for k in ("main_text", "linked_tables"))
    return rows.groupBy("key").agg(F.min(main).alias("main_text"), F.array_sort(F.collect_list(linked)).alias("linked_tables"))
