"""Queries for predictions, function metrics, experiment summaries, logs and configs
(F5 F6 F8 J3 S3 S4 S5 S8 A3 A4 A15 A16 W9 C14 C16 C17)."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

from sluice.catalog import register
from sluice.catalog.curation import splits10
from sluice.functions.code import data_seed, model_seed, report_round, softmax_prob, threshold_predict
from sluice.oracle import cte, sql
from sluice.operators import effort as ef
from sluice.operators import metrics as me
from sluice.operators.align import attach_predictions
from sluice.plans.splits import DEFAULT_SEEDS
from sluice.session import scratch_path
from sluice.sources import sinks
from sluice.sources import tables as tb
from sluice.sources.logs import ingest_metric_logs, metric_log_lines

# ------------------------------------------------------------------ shared oracle views
cte("results", """
SELECT func_id, prob AS logits, label AS y_trues, y_pred AS y_preds,
  (CASE WHEN flaw_line_index IS NULL THEN 0 ELSE len(string_split(flaw_line_index, ',')) END)::INTEGER AS num_flaw_lines,
  len(list_filter(string_split(code, chr(10)), lambda x: length(x)>0))::INTEGER AS num_lines,
  flaw_line, flaw_line_index
FROM predictions WHERE latent=0""", "predictions")

cte("repeat_scores", """
SELECT r.repeat, f.func_id, f.label AS y_true,
  ((0.6::DOUBLE * (('0x'||substr(sha256(concat_ws('|', r.repeat, f.func_id)),1,8))::BIGINT / 4294967296::DOUBLE)
    + 0.4::DOUBLE * f.label::DOUBLE) > 0.5)::INTEGER AS y_pred,
  0.6::DOUBLE * (('0x'||substr(sha256(concat_ws('|', r.repeat, f.func_id)),1,8))::BIGINT / 4294967296::DOUBLE)
    + 0.4::DOUBLE * f.label::DOUBLE AS prob
FROM (SELECT unnest(range(1, 11))::INTEGER AS repeat) r, functions f WHERE f.latent=0""", "functions")

CONF = """count_if(y_true=1 AND y_pred=1) AS tp, count_if(y_true=0 AND y_pred=1) AS fp,
  count_if(y_true=1 AND y_pred=0) AS fn, count_if(y_true=0 AND y_pred=0) AS tn"""


def _ratio(a, b):
    return f"coalesce(({a})::DOUBLE / nullif(({b}), 0)::DOUBLE, 0.0::DOUBLE)"


METRIC_SELECT = f"""{_ratio('tp+tn', 'tp+fp+fn+tn')} AS accuracy, {_ratio('tp', 'tp+fp')} AS precision,
  {_ratio('tp', 'tp+fn')} AS recall, {_ratio('2*tp', '2*tp+fp+fn')} AS f1"""

cte("repeat_metrics", f"""
SELECT repeat, {METRIC_SELECT} FROM (SELECT repeat, {CONF} FROM repeat_scores GROUP BY repeat)""",
    "repeat_scores")


def _results(spark, sf):
    f = tb.functions(spark, sf).filter(F.col("latent") == 0)
    return ef.result_frame(tb.score_hash_model(f))


def repeat_scores(spark, sf):
    f = tb.functions(spark, sf).filter(F.col("latent") == 0).select("func_id", "code", "label")
    f = f.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(10))))
    s = tb.score_hash_model(f, F.concat_ws("|", F.col("repeat"), F.col("func_id")))
    return s.select("repeat", "func_id", F.col("label").alias("y_true"), "y_pred", "prob")


def repeat_metrics(spark, sf):
    return me.classification_metrics(repeat_scores(spark, sf), ["repeat"])


# ------------------------------------------------------------------ predictions
@register("threshold_predict", sql("SELECT func_id, prob, y_pred FROM predictions", "predictions"))
def threshold_predict_q(spark, sf):
    p = tb.predictions(spark, sf)
    return p.select("func_id", "prob", threshold_predict("prob").alias("y_pred"))


@register("true_positives", sql("""
SELECT func_id, (y_trues = 1)::INTEGER AS tp FROM results WHERE y_trues = y_preds""", "results"))
def true_positives(spark, sf):
    r = _results(spark, sf)
    return r.filter(F.col("y_trues") == F.col("y_preds")).select("func_id", (F.col("y_trues") == 1).cast("int").alias("tp"))


@register("project_results", sql("SELECT * FROM results", "results"))
def project_results(spark, sf):
    return _results(spark, sf)


def write_predictions(spark, sf):
    """Persist (func_id, y_trues, y_preds, logits) of the test set."""
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(_results(spark, sf), path)
    return path


@register("write_predictions", sql("SELECT func_id, y_trues, y_preds, logits FROM results", "results"))
def write_predictions_q(spark, sf):
    return spark.read.parquet(write_predictions(spark, sf))


@register("attach_predictions", sql("SELECT * FROM results", "results"))
def attach_predictions_q(spark, sf):
    test = tb.functions(spark, sf).filter(F.col("latent") == 0)
    preds = tb.score_hash_model(test).select("func_id", "prob", "y_pred")
    joined = attach_predictions(test.drop("prob", "y_pred"), preds)
    return ef.result_frame(joined)


@register("scan_predictions", sql("SELECT * FROM results", "results"))
def scan_predictions(spark, sf):
    """S3: reload persisted predictions instead of re-scoring, then attach."""
    saved = spark.read.parquet(write_predictions(spark, sf)).select(
        "func_id", F.col("logits").alias("prob"), F.col("y_preds").alias("y_pred"))
    test = tb.functions(spark, sf).filter(F.col("latent") == 0)
    return ef.result_frame(attach_predictions(test, saved))


@register("softmax_prob", sql("""
SELECT func_id, round(1.0 / (1.0 + exp(ln(1.0 - prob) - ln(prob))), 6) AS p FROM predictions""", "predictions"))
def softmax_prob_q(spark, sf):
    p = tb.predictions(spark, sf)
    return p.select("func_id", F.round(softmax_prob(F.log(F.lit(1.0) - F.col("prob")), F.log("prob")), 6).alias("p"))


@register("python_round", sql("""
SELECT func_id, (whole + CASE WHEN hi - whole > 0.5::DOUBLE OR (hi - whole = 0.5::DOUBLE AND (err > 0 OR (err = 0 AND whole % 2 = 1)))
    THEN 1 ELSE 0 END) / 10000::DOUBLE AS flaw_share
FROM (SELECT *, ((xh * 10000 - hi) + xl * 10000) AS err, floor(hi) AS whole
      FROM (SELECT *, x - xh AS xl
            FROM (SELECT func_id, x, x * 10000::DOUBLE AS hi, 134217729::DOUBLE * x - (134217729::DOUBLE * x - x) AS xh
                  FROM (SELECT func_id, num_flaw_lines::DOUBLE / num_lines AS x FROM results WHERE num_lines > 0))))""",
                              "results"))
def python_round(spark, sf):
    r = _results(spark, sf).filter(F.col("num_lines") > 0)
    return r.select("func_id", report_round(F.col("num_flaw_lines").cast("double") / F.col("num_lines"), 4)
                    .alias("flaw_share"))


# ------------------------------------------------------------------ function metrics
@register("classification_metrics", sql("SELECT * FROM repeat_metrics", "repeat_metrics"))
def classification_metrics(spark, sf):
    return repeat_metrics(spark, sf)


@register("single_class_metrics", sql(f"""
SELECT project, n_classes,
  CASE WHEN n_classes > 1 THEN {_ratio('tp+tn', 'tp+fp+fn+tn')} END AS accuracy,
  CASE WHEN n_classes > 1 THEN {_ratio('tp', 'tp+fp')} END AS precision,
  {_ratio('tp', 'tp+fn')} AS recall,
  CASE WHEN n_classes > 1 THEN {_ratio('2*tp', '2*tp+fp+fn')} END AS f1
FROM (SELECT project, {CONF}, count(DISTINCT y_true) AS n_classes FROM (
        SELECT d.source || '/' || (p.func_id % 3)::VARCHAR AS project, p.label AS y_true, p.y_pred
        FROM predictions p JOIN documents d ON p.func_id = d.doc_id WHERE p.latent = 0)
      GROUP BY project)""", "predictions"))
def single_class_metrics(spark, sf):
    """A4 per (project, stratum): small strata of each project, so some groups hold a single
    true class and report recall only."""
    p = tb.score_hash_model(tb.functions(spark, sf, extra=("source",)).filter(F.col("latent") == 0))
    p = p.select(F.concat(F.col("source"), F.lit("/"), (F.col("func_id") % 3).cast("string"))
                 .alias("project"), F.col("label").alias("y_true"), "y_pred")
    return me.single_class_metrics(p, ["project"])


@register("experiment_summary", sql("""
SELECT 'regular' AS config, metric, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std,
       count(*) AS n_repeats
FROM (UNPIVOT repeat_metrics ON accuracy, precision, recall, f1 INTO NAME metric VALUE value)
GROUP BY metric""", "repeat_metrics"))
def experiment_summary(spark, sf):
    long = me.to_long(repeat_metrics(spark, sf).withColumn("config", F.lit("regular")),
                      ["config", "repeat"], ["accuracy", "precision", "recall", "f1"])
    return me.experiment_summary(long, ["config"])


@register("results_wide", sql("""
SELECT 'regular' AS config, repeat, precision, recall, f1, -1.0::DOUBLE AS effort_at_recall,
       -1.0::DOUBLE AS recall_at_loc, -1.0::DOUBLE AS ifa, -1.0::DOUBLE AS top_k_accuracy
FROM repeat_metrics""", "repeat_metrics"))
def results_wide(spark, sf):
    long = me.to_long(repeat_metrics(spark, sf).withColumn("config", F.lit("regular")),
                      ["config", "repeat"], ["precision", "recall", "f1"])
    return me.results_wide(long)


# Per-epoch decision thresholds of the synthetic tuning history.
EPOCH_THRESHOLDS = [round(0.30 + 0.04 * e, 2) for e in range(1, 11)]


def tuning_history(spark, sf):
    """Per (repeat, epoch) validation F1 of the repeat's scores under that epoch's threshold."""
    s = repeat_scores(spark, sf)
    th = F.array(*[F.struct(F.lit(e + 1).alias("epoch"), F.lit(t).alias("t")) for e, t in enumerate(EPOCH_THRESHOLDS)])
    h = s.select("repeat", "y_true", "prob", F.explode(th).alias("e")).select(
        "repeat", F.col("e.epoch").alias("epoch"), "y_true", (F.col("prob") > F.col("e.t")).cast("int").alias("y_pred"))
    return me.classification_metrics(h, ["repeat", "epoch"])


_TH_SQL = ", ".join(f"({e + 1}, {t!r}::DOUBLE)" for e, t in enumerate(EPOCH_THRESHOLDS))


@register("best_epoch", sql(f"""
SELECT repeat, epoch AS best_epoch, f1 AS best_score FROM (
  SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY f1 DESC, epoch) AS rn FROM (
    SELECT repeat, epoch, {_ratio('2*tp', '2*tp+fp+fn')} AS f1 FROM (
      SELECT repeat, epoch, {CONF} FROM (
        SELECT s.repeat, t.epoch, s.y_true, (s.prob > t.t)::INTEGER AS y_pred
        FROM repeat_scores s, (VALUES {_TH_SQL}) t(epoch, t))
      GROUP BY repeat, epoch)))
WHERE rn = 1""", "repeat_scores"))
def best_epoch(spark, sf):
    return me.best_epoch(tuning_history(spark, sf), ["repeat"], score="f1")


# ------------------------------------------------------------------ logs and configs
@register("ingest_metric_logs", sql("""
SELECT metric, TRY_CAST(trim(split_part(value, ' = ', 2)) AS DOUBLE) AS value FROM (
  SELECT value, CASE WHEN contains(value, 'test_recall') THEN 'recall'
                     WHEN contains(value, 'test_precision') THEN 'precision'
                     WHEN contains(value, 'test_f1') THEN 'f1'
                     WHEN contains(value, 'Effort@0.2Recall') THEN 'effort_at_recall'
                     WHEN contains(value, 'Recall@0.01LOC') THEN 'recall_at_loc'
                     WHEN contains(value, 'IFA =') THEN 'ifa'
                     WHEN contains(value, 'Top-10_Accuracy') THEN 'top_k_accuracy' END AS metric
  FROM (SELECT CASE doc_id % 8
                 WHEN 0 THEN '  test_recall = 0.' || lpad((doc_id % 100)::VARCHAR, 2, '0')
                 WHEN 1 THEN '  test_precision = 0.' || lpad((doc_id % 100)::VARCHAR, 2, '0')
                 WHEN 2 THEN '  test_f1 = 0.' || lpad((doc_id % 100)::VARCHAR, 2, '0')
                 WHEN 3 THEN 'IFA = ' || (doc_id % 100)::VARCHAR || '.5'
                 WHEN 4 THEN 'Effort@0.2Recall = 0.' || lpad((doc_id % 100)::VARCHAR, 2, '0')
                 WHEN 5 THEN 'Recall@0.01LOC = 0.' || lpad((doc_id % 100)::VARCHAR, 2, '0')
                 WHEN 6 THEN 'Top-10_Accuracy = ' || (doc_id % 100)::VARCHAR
                 ELSE 'epoch ' || doc_id::VARCHAR || ' done' END AS value
        FROM labels))
WHERE metric IS NOT NULL"""))
def ingest_metric_logs_q(spark, sf):
    path = scratch_path(spark, "metric_logs")
    metric_log_lines(tb.read_table(spark, sf, "labels")).write.text(path)
    return ingest_metric_logs(spark.read.text(path)).select("metric", "value")


# Experiment configurations (one per line in the config file) and the split
# each trains on.
CONFIGS = [("regular", "train"), ("latent_v", "train_latent")]
CORPUS, SETTING = "corpus", "default"


@register("scan_configs", sql(f"""
SELECT c.config, r.repeat, (10000 * r.repeat)::BIGINT AS data_seed,
  (list_reduce(list_transform(string_split(array_to_string(list_transform(
      string_split(c.config || '_{CORPUS}_{SETTING}', ''), lambda ch: ord(ch)::VARCHAR), ''), ''),
      lambda d: d::BIGINT), lambda acc, d: (acc * 10 + d) % 123456) + 20000 * r.repeat)::BIGINT AS model_seed,
  n.n_train
FROM (VALUES ('regular', 'train'), ('latent_v', 'train_latent')) c(config, split),
     (SELECT unnest(range(1, 11))::INTEGER AS repeat) r,
     (SELECT seed, split, count(*) AS n_train FROM splits GROUP BY ALL) n
WHERE n.seed = 10000 * r.repeat AND n.split = c.split""", "splits",
                              overrides={"seeds": "SELECT unnest([10000,20000,30000,40000,50000,60000,70000,80000,"
                                                  "90000,100000])::BIGINT AS seed"}))
def scan_configs(spark, sf):
    """S4 + C14: read the config file, pair each config with the ten repeats, derive data and
    model seeds, and size each training set from the split tables."""
    path = scratch_path(spark, "configs")
    spark.createDataFrame([Row(config=c, split=s) for c, s in CONFIGS]).write.option("header", False).csv(path)
    configs = spark.read.schema("config string, split string").csv(path)
    reps = configs.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(len(DEFAULT_SEEDS)))))
    reps = reps.withColumn("data_seed", data_seed("repeat"))
    reps = reps.withColumn("model_seed",
                           model_seed(F.concat(F.col("config"), F.lit(f"_{CORPUS}_{SETTING}")), F.col("repeat")))
    sizes = splits10(spark, sf).groupBy("seed", "split").agg(F.count(F.lit(1)).alias("n_train"))
    # sizes: one row per (seed, split) -- 4 x number of seeds, bounded by construction.
    out = reps.join(F.broadcast(sizes), (reps["data_seed"] == sizes["seed"]) & (reps["split"] == sizes["split"]))
    return out.select("config", "repeat", "data_seed", "model_seed", "n_train")



@register("derive_seed", sql(f"""
SELECT project, repeat,
  (list_reduce(list_transform(string_split(array_to_string(list_transform(
      string_split('regular_' || project || '_{SETTING}', ''), lambda ch: ord(ch)::VARCHAR), ''), ''),
      lambda d: d::BIGINT), lambda acc, d: (acc * 10 + d) % 123456) + 20000 * repeat)::BIGINT AS model_seed,
  (10000 * repeat)::BIGINT AS data_seed
FROM (SELECT DISTINCT source AS project FROM documents), (SELECT unnest(range(1, 11))::INTEGER AS repeat)"""))
def derive_seed_q(spark, sf):
    """C14: model and data seeds of each repeat for every project's 'regular' config string."""
    p = tb.read_table(spark, sf, "documents").select(F.col("source").alias("project")).distinct()
    p = p.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(10))))
    return p.select("project", "repeat",
                    model_seed(F.concat(F.lit("regular_"), F.col("project"), F.lit(f"_{SETTING}")), F.col("repeat"))
                    .alias("model_seed"),
                    data_seed("repeat").alias("data_seed"))
