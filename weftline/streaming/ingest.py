"""Script files that arrive in a folder, analysed as a stream: stateless, so each file is one independent row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import code


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, text) of files as they arrive; a batch takes at most ``files_per_batch`` of them, the rest wait."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(code.language_of(F.col("path")).isNotNull())


def analyse_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the graphs of arriving files as Parquet. The file sink commits each batch once, also after a restart."""
    rows = code.file_graphs(file_stream(spark, folder))
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
