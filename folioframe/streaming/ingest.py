"""The same pipeline over files as they arrive. Documents are independent, so the stream holds no state; files linked to
an article are joined to it afterwards, from what the stream wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioframe.api import process_pages
from folioframe.functions import text as T
from folioframe.sources import files


def page_stream(spark: SparkSession, path: str, config: dict, files_per_trigger: int = 1000) -> DataFrame:
    """Processed HTML files of a directory that grows."""
    found = files.stream(spark, path, "*.htm*", files_per_trigger)
    pages = found.select("path", T.base_key(F.col("path")).alias("key"), T.input_kind(F.col("path")).alias("kind"), F.decode("content", "UTF-8").alias("content"))
    return process_pages(pages, config)


def write_pages(pages: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to Parquet, exactly once; with once, what is there now and then stop."""
    writer = pages.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
