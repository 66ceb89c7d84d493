"""Queries for the sinks (S7 S9 S10 S11): each writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.catalog import register
from sluice.catalog.curation import splits10
from sluice.catalog.effort import _ranked, _tp_stats, p3_sql
from sluice.catalog.evaluation import _results, repeat_metrics
from sluice.oracle import SEEDS10, sql
from sluice.operators import metrics as me
from sluice.plans.evaluate import evaluate_lines
from sluice.session import scratch_path
from sluice.sources import sinks as sk
from sluice.sources import tables as tb
from sluice.sources.logs import metric_log_lines
from sluice.streaming.metric_logs import start_metric_log_ingest
from sluice.catalog import ORACLE as _ORACLE

ORACLE_LOGS = None  # filled below from the batch query's oracle


@register("write_splits", sql("SELECT seed, split, label, count(*) AS n FROM splits GROUP BY ALL", "splits",
                              overrides={"seeds": SEEDS10}))
def write_splits(spark, sf):
    path = scratch_path(spark, "splits")
    sk.write_splits(splits10(spark, sf), path)
    back = spark.read.parquet(path).withColumn("seed", F.col("seed").cast("long"))  # partition values read as int
    return back.groupBy("seed", "split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("write_line_ranks", sql("SELECT part, func_id, line_idx, rank FROM line_ranks", "line_ranks"))
def write_line_ranks(spark, sf):
    path = scratch_path(spark, "line_ranks")
    sk.write_line_ranks(_ranked(spark, sf).select("part", "func_id", "line_idx", "rank", "score", "label"), path)
    return spark.read.parquet(path).select("part", "func_id", "line_idx", "rank")


RESULTS_SCHEMA = ("config string, repeat int, precision double, recall double, f1 double, effort_at_recall double, "
                  "recall_at_loc double, ifa double, top_k_accuracy double")


@register("write_results_csv", sql("""
SELECT 'regular' AS config, repeat, precision, recall, f1, -1.0::DOUBLE AS effort_at_recall,
       -1.0::DOUBLE AS recall_at_loc, -1.0::DOUBLE AS ifa, -1.0::DOUBLE AS top_k_accuracy
FROM repeat_metrics""", "repeat_metrics"))
def write_results_csv(spark, sf):
    long = me.to_long(repeat_metrics(spark, sf).withColumn("config", F.lit("regular")),
                      ["config", "repeat"], ["precision", "recall", "f1"])
    path = scratch_path(spark, "results_csv")
    sk.write_results_csv(me.results_wide(long), path)
    return spark.read.schema(RESULTS_SCHEMA).option("header", True).csv(path)


@register("write_line_report", p3_sql(fold=False))
def write_line_report(spark, sf):
    """The P3 report over the given line scores, appended as JSON and read back."""
    report = evaluate_lines(spark, _results(spark, sf), tb.line_score_arrays(spark, sf), name="s11")
    path = scratch_path(spark, "line_report")
    sk.write_line_report(report, path)
    return spark.read.schema("metric string, value double").json(path)


ORACLE_LOGS = _ORACLE["ingest_metric_logs"]


@register("ingest_metric_logs_stream", ORACLE_LOGS)
def ingest_metric_logs_stream(spark, sf):
    """S5 through Structured Streaming: log files in a folder, parsed incrementally with a
    checkpoint (available-now trigger), read back from the parquet sink."""
    logs = scratch_path(spark, "stream_logs")
    metric_log_lines(tb.read_table(spark, sf, "labels")).write.text(logs)
    out, ckpt = scratch_path(spark, "stream_out"), scratch_path(spark, "stream_ckpt")
    start_metric_log_ingest(spark, logs, out, ckpt).awaitTermination()
    return spark.read.parquet(out).select("metric", "value")


@register("write_raw_predictions", sql("""
SELECT func_id, code, label, latent, method, vfc, flaw_line, flaw_line_index, prob, y_pred AS raw_preds
FROM predictions WHERE latent = 0""", "predictions"))
def write_raw_predictions(spark, sf):
    test = tb.score_hash_model(tb.functions(spark, sf).filter(F.col("latent") == 0))
    path = scratch_path(spark, "raw_preds")
    sk.write_raw_predictions(test, "y_pred", path)
    return spark.read.parquet(path)


@register("write_ifa_records", sql("SELECT 'line_scores' AS model, func_id, first_rank AS ifa FROM tp_stats "
                                   "WHERE status = 'ok'", "tp_stats"))
def write_ifa_records(spark, sf):
    path = scratch_path(spark, "ifa_records")
    sk.write_ifa_records(_tp_stats(spark, sf), path, "line_scores")
    return spark.read.schema("model string, func_id bigint, ifa bigint").json(path)
