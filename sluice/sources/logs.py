"""Metric extraction from training/evaluation log text.

Log lines are read with ``spark.read.text`` (or ``readStream.text``, see
``sluice.streaming``); each line is classified by the first metric key it contains (an
if/elif chain, so order matters) and its value is the text after ' = '.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Log keys in match order, and the metric each one reports.
LOG_KEYS = [
    ("test_recall", "recall"),
    ("test_precision", "precision"),
    ("test_f1", "f1"),
    ("Effort@0.2Recall", "effort_at_recall"),
    ("Recall@0.01LOC", "recall_at_loc"),
    ("IFA =", "ifa"),
    ("Top-10_Accuracy", "top_k_accuracy"),
]


def classify_line(value: Column) -> Column:
    expr = None
    for key, metric in LOG_KEYS:
        cond = F.instr(value, key) > 0
        expr = F.when(cond, F.lit(metric)) if expr is None else expr.when(cond, F.lit(metric))
    return expr


def ingest_metric_logs(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Rows ``(metric, value, ...)`` for every log line carrying a known metric key."""
    v = F.col(text_col)
    parsed = lines.withColumn("metric", classify_line(v)).filter(F.col("metric").isNotNull())
    num = F.trim(F.split_part(v, F.lit(" = "), F.lit(2)))
    return parsed.withColumn("_v", num.try_cast("double")).drop(text_col).withColumnRenamed("_v", "value")


def metric_log_lines(labels: DataFrame) -> DataFrame:
    """Synthetic evaluation log text derived from ``labels``: metric lines and noise lines."""
    d = F.col("doc_id")
    two = F.lpad((d % 100).cast("string"), 2, "0")
    keyed = lambda key: F.concat(F.lit(f"{key} = 0."), two)
    line = (F.when(d % 8 == 0, keyed("  test_recall"))
            .when(d % 8 == 1, keyed("  test_precision"))
            .when(d % 8 == 2, keyed("  test_f1"))
            .when(d % 8 == 3, F.concat(F.lit("IFA = "), (d % 100).cast("string"), F.lit(".5")))
            .when(d % 8 == 4, keyed("Effort@0.2Recall"))
            .when(d % 8 == 5, keyed("Recall@0.01LOC"))
            .when(d % 8 == 6, F.concat(F.lit("Top-10_Accuracy = "), (d % 100).cast("string")))
            .otherwise(F.concat(F.lit("epoch "), d.cast("string"), F.lit(" done"))))
    return labels.select(line.alias("value"))
