"""Incremental discovery: new lines of lists, each canonical URL once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.urls import canonical, is_archive


def url_stream(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").format("text").load(folder)
    return raw.select(canonical(F.col("value")).alias("url")).where("url <> ''")


def distinct_urls(stream: DataFrame, gate: bool = False, event_time: str | None = None, keep: str = "30 days") -> DataFrame:
    """Each URL once. Without an event time the state holds every URL ever seen; with one, it forgets after `keep`."""
    rows = stream.where(is_archive(F.col("url"))) if gate else stream
    if event_time is None:
        return rows.dropDuplicates(["url"])
    return rows.withWatermark(event_time, keep).dropDuplicatesWithinWatermark(["url"])


def append(stream: DataFrame, target: str, checkpoint: str, available_now: bool = True):
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", target)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
