"""Reads as they arrive: files of a folder as a stream, validated, demultiplexed and counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicelake.functions.reads import record_error


def stream_reads(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder, each read once as it appears."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def valid_only(reads: DataFrame) -> DataFrame:
    return reads.where(record_error(F.col("header_line"), F.col("seq_line"), F.col("plus_line"), F.col("qual_line")).isNull())


def counts_by_window(reads: DataFrame, window: str = "1 hour", late: str = "2 hours", time: str = "sequenced_at") -> DataFrame:
    """(window_start, barcode, reads): valid reads per barcode and window; rows later than ``late`` are dropped.

    NULL times fall in no window and are left out; NULL barcodes are counted as such.
    """
    keyed = valid_only(reads).where(F.col(time).isNotNull()).withWatermark(time, late)
    key = F.upper(F.regexp_replace("barcode_key", r"^\s+|\s+$", "")).alias("barcode")
    grouped = keyed.groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("reads"))
    return grouped.select(F.col("w.start").alias("window_start"), "barcode", "reads")


def new_reads(reads: DataFrame, late: str = "2 hours", time: str = "sequenced_at") -> DataFrame:
    """Reads without those whose header came before within the watermark; state is dropped as time passes."""
    return reads.where(F.col(time).isNotNull()).withWatermark(time, late).dropDuplicatesWithinWatermark(["sample_id", "header_line"])
