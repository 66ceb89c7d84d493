"""S5 as a Structured Streaming query: log files arriving in a folder are parsed with the
batch parser (``sluice.sources.logs``) and appended to a sink with a checkpoint, so a
restarted query resumes where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.logs import ingest_metric_logs


def metric_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming DataFrame of (file, metric, value) for every metric line of new files."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 100).load(folder)
    lines = lines.withColumn("file", F.col("_metadata.file_path"))
    return ingest_metric_logs(lines)


def start_metric_log_ingest(spark: SparkSession, folder: str, out_path: str, checkpoint: str,
                            available_now: bool = True):
    """Append parsed metrics to parquet at ``out_path``; ``available_now`` processes the files
    present and stops (batch-like), otherwise the query keeps running."""
    q = (metric_log_stream(spark, folder).writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()
