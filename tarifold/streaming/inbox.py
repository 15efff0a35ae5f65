"""Inbox as a stream: each new file is one event, each run is accepted once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifold.functions.hashing import effective_month

BINARY = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """path, modificationTime and digest of files as they appear; the content is not kept."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    return files.select("path", "modificationTime", F.sha2("content", 256).alias("digest"))


def first_of_each_run(runs: DataFrame, late: str = "7 days") -> DataFrame:
    """Runs (run_id, accepted_at) without repeats; state older than the watermark is dropped."""
    return runs.withWatermark("accepted_at", late).dropDuplicatesWithinWatermark(["run_id"])


def lines_by_month(lines: DataFrame) -> DataFrame:
    """Typed lines with their month segment."""
    return lines.withColumn("month", effective_month(F.col("effective_at")))


def counts_per_window(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Event counts per tumbling window and key, final once the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def run_inbox(spark: SparkSession, root: str, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Handle all files that are there, then stop; a restart goes on where it ended.

    handle gets each batch's files and its number and must be idempotent, as
    a batch may be handed over again after a failure.
    """
    return new_files(spark, root).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_facts(lines: DataFrame, target: str, checkpoint: str):
    """Typed lines into the fact store, partitioned by supplier, parser and month."""
    return lines_by_month(lines).writeStream.format("parquet").partitionBy("supplier_id", "parser_id", "month").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
