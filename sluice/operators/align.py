"""Predictions attached to the test table by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.session import persist_table


def attach_predictions(test: DataFrame, preds: DataFrame, key: str = "func_id") -> DataFrame:
    """The rows of ``test`` with the columns of ``preds``. Each key must occur once on both sides (the
    positional-length assertion of the reference, made exact): a full outer join is stored once and one aggregate over it
    counts matches, rows of one side only and repeated keys; a null key matches nothing."""
    left = test.withColumn("_left", F.lit(True))
    right = preds.select(F.col(key).alias("_key"), *[c for c in preds.columns if c != key]).withColumn("_right", F.lit(True))
    both = persist_table(test.sparkSession, left.join(right, left[key] == right["_key"], "full_outer"), "attached")
    matched = F.col("_left") & F.col("_right")
    counts = both.agg(F.count_if(matched).alias("matched"), F.count_if(F.col("_right").isNull()).alias("left_only"),
                      F.count_if(F.col("_left").isNull()).alias("right_only"), F.count_distinct(F.when(matched, F.col(key))).alias("keys")).first()
    repeated = counts["matched"] - counts["keys"]
    if counts["left_only"] or counts["right_only"] or repeated:
        raise ValueError(f"predictions and test rows do not align: {counts['matched']} matched, {counts['left_only']} rows without and "
                         f"{counts['right_only']} predictions without a partner, {repeated} matches of repeated keys")
    return both.filter(matched).drop("_left", "_right", "_key")
