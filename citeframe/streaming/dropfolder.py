"""Files dropped into a folder, as a stream of blocks: each content once, within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeframe.operators.blocks import paragraphs


def text_files(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """doc_id (hash of the content), text, modificationTime of new text files; copies that arrive within `late` are dropped."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    named = raw.select(F.sha2("content", 256).alias("doc_id"), F.decode("content", "UTF-8").alias("text"), "modificationTime")
    return named.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["doc_id"])


def into_blocks(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the blocks of all files there now, then stop."""
    return paragraphs(docs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
