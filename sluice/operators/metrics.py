"""Function-level metrics and experiment summaries.

Everything is one aggregate over the scored rows (partial aggregation map-side), grouped
by whatever identifies an experiment (config, repeat, epoch, project ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column) -> Column:
    """num / den with 0 when the denominator is 0 (the zero-division default)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion(y_true: str = "y_true", y_pred: str = "y_pred") -> list[Column]:
    t, p = F.col(y_true), F.col(y_pred)
    return [F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"),
            F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 0) & (p == 0)).alias("tn")]


def classification_metrics(df: DataFrame, group_cols: list[str], y_true: str = "y_true",
                           y_pred: str = "y_pred") -> DataFrame:
    """A3: accuracy, precision, recall and F1 of class 1 per group."""
    c = df.groupBy(*group_cols).agg(*confusion(y_true, y_pred))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*group_cols,
                    _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    _ratio(tp, tp + fp).alias("precision"),
                    _ratio(tp, tp + fn).alias("recall"),
                    _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def single_class_metrics(df: DataFrame, group_cols: list[str], y_true: str = "y_true",
                         y_pred: str = "y_pred") -> DataFrame:
    """A4: as A3, but a group whose truth has a single class reports recall only."""
    c = df.groupBy(*group_cols).agg(*confusion(y_true, y_pred),
                                    F.count_distinct(F.col(y_true)).alias("n_classes"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    both = F.col("n_classes") > 1
    return c.select(*group_cols, "n_classes",
                    F.when(both, _ratio(tp + tn, tp + fp + fn + tn)).alias("accuracy"),
                    F.when(both, _ratio(tp, tp + fp)).alias("precision"),
                    _ratio(tp, tp + fn).alias("recall"),
                    F.when(both, _ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def to_long(wide: DataFrame, id_cols: list[str], metrics: list[str]) -> DataFrame:
    """Wide metric columns -> (id..., metric, value)."""
    return wide.unpivot(id_cols, metrics, "metric", "value")


def experiment_summary(long: DataFrame, group_cols: list[str] = ("config",), digits: int = 9) -> DataFrame:
    """Per metric, mean and population standard deviation across repeats."""
    g = list(group_cols) + ["metric"]
    return long.groupBy(*g).agg(F.round(F.avg("value"), digits).alias("mean"),
                                F.round(F.stddev_pop("value"), digits).alias("std"),
                                F.count(F.lit(1)).alias("n_repeats"))


# Reported metric columns, in report order.
RESULT_METRICS = ["precision", "recall", "f1", "effort_at_recall", "recall_at_loc", "ifa", "top_k_accuracy"]


def results_wide(long: DataFrame, id_cols: list[str] = ("config", "repeat"), metrics=RESULT_METRICS) -> DataFrame:
    """Repeats as rows, metrics as columns; a metric absent for a repeat is -1."""
    wide = long.groupBy(*id_cols).pivot("metric", list(metrics)).agg(F.first("value"))
    return wide.select(*id_cols, *[F.coalesce(F.col(m).cast("double"), F.lit(-1.0)).alias(m) for m in metrics])


def best_epoch(history: DataFrame, group_cols: list[str], epoch: str = "epoch", score: str = "f1") -> DataFrame:
    """The epoch with the strictly greatest score per group -> earliest argmax."""
    return history.groupBy(*group_cols).agg(
        F.max_by(F.col(epoch), F.struct(F.col(score), -F.col(epoch))).alias("best_epoch"),
        F.max(F.col(score)).alias("best_score"))
