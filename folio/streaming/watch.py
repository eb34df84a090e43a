"""Streams: folders that are watched for pages, and the running log of what was done."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.sources import images

#: Schema of files as Spark reads them whole.
FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, glob: str = "*.{png,bmp,tif,tiff}", per_batch: int = 1000) -> DataFrame:
    """Image files as they come, so many a batch, decoded; what can't be read is a row with ``error``."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(folder)
    return images.decoded(files)


def processed(pages: DataFrame, change: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Each batch through ``change`` into Parquet under its own number: a batch that is run again replaces itself, so each page is written once."""

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))

    query = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type) counted in windows; what is later than the watermark is left out, so the state stays bounded."""
    w = F.window("ts", window)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
