"""Streaming scoring and the monitor of reject-rate gaps.

Not part of the batch workbench this engine mirrors; an addition in its spirit.  Scoring is a
stateless expression; the monitor is a windowed aggregate under a watermark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.parsing import null_if_nan
from scoreloom.operators.reports import gap_state
from scoreloom.session import shared_folder


def windowed_gaps(stream: DataFrame, ts: str, score: str, threshold: float, rate: float, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Reject rate and gap of each window of a stream of scored rows; rows later than ``late`` are left out."""
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(score) >= threshold).alias("k"))
    actual = F.col("k") / F.col("n")
    return g.select(F.col("w.start").alias("window_start"), "n", actual.alias("actual_reject_rate"), (actual - rate).alias("gap"), gap_state(actual - rate).alias("state"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the files of a table, a folder or a single file."""
    import os

    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if os.path.isdir(path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))


def windows_by_stream(spark: SparkSession, path: str, ts: str, score: str, threshold: float, rate: float, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``windowed_gaps`` of the files of a path, read by a stream until all are read, and written as windows close.

    Only windows that end before the watermark are there; the rest stays in the stream's state, which
    is kept beside the result in the shared folder.
    """
    out = f"{shared_folder(spark).rstrip('/')}/windows-{uuid.uuid4().hex}"
    rows = _files(spark, path).select(F.col(ts).cast("timestamp").alias("ts"), F.col(score).alias("score"))
    gaps = windowed_gaps(rows, "ts", "score", threshold, rate, width, late)
    gaps.writeStream.format("parquet").option("path", f"{out}/result").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(gaps.schema).parquet(f"{out}/result")


def rate_gaps_by_stream(spark: SparkSession, path: str, threshold: float = 0.45, rate: float = 0.35) -> DataFrame:
    """Gaps by issue year, computed by a stream over the files of a path until they are all read.

    Each batch writes the whole result, one row for each year, as a table in the shared folder; the
    state is kept beside it, so a restarted stream goes on where it stopped.
    """
    out = f"{shared_folder(spark).rstrip('/')}/gaps-{uuid.uuid4().hex}"
    v = lambda c: F.coalesce(null_if_nan(F.col(c)), F.lit(0.0))
    score = F.round(F.least(F.greatest((2 * v("int_rate") + 0.5 * v("dti") + 0.1 * v("revol_util")) / 100.0, F.lit(0.0)), F.lit(1.0)), 6)
    counts = _files(spark, path).withColumn("score", score).groupBy("issue_year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= threshold).alias("k"))
    write = lambda batch, number: batch.coalesce(1).write.mode("overwrite").parquet(f"{out}/result")
    counts.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    actual = F.col("k") / F.col("n")
    found = spark.read.schema(counts.schema).parquet(f"{out}/result")
    return found.select("issue_year", "n", F.round(actual, 9).alias("actual_reject_rate"), F.round(actual - rate, 9).alias("gap"), gap_state(actual - rate).alias("state"))
