"""Alignment of predictions with their rows, and tables read from several projects' files."""

import pytest
from pyspark.sql import functions as F

from sluice.operators.align import attach_predictions
from sluice.session import scratch_path
from sluice.sources import tables as tb


def frames(spark, test, preds):
    return (spark.createDataFrame([(i, f"c{i}") for i in test], "func_id long, code string"),
            spark.createDataFrame([(i, 0.5) for i in preds], "func_id long, prob double"))


def test_aligned_predictions_are_attached(spark):
    got = attach_predictions(*frames(spark, [3, 1, 2], [1, 2, 3]))
    assert got.columns == ["func_id", "code", "prob"]
    assert sorted(map(tuple, got.collect())) == [(1, "c1", 0.5), (2, "c2", 0.5), (3, "c3", 0.5)]
    assert attach_predictions(*[d.limit(0) for d in frames(spark, [1], [1])]).count() == 0


@pytest.mark.parametrize(("test", "preds"), [([1, 2], [1]), ([1], [1, 2]), ([1, 2], [1, 3]), ([1, 1], [1, 1]), ([1, 1, 2], [1, 2, 2]), ([1, 1], [1, 2]),
                                             ([None, 1], [None, 1])])
def test_misaligned_predictions_are_refused(spark, test, preds):
    with pytest.raises(ValueError, match="do not align"):
        attach_predictions(*frames(spark, test, preds))


def test_projects_with_ragged_files(spark):
    base = scratch_path(spark, "ragged")
    spark.range(3).select(F.col("id").alias("func_id"), F.lit("x").alias("code"), F.lit(1).alias("label"), F.lit(0).alias("latent"),
                          F.lit("extra").alias("note")).write.parquet(f"{base}/a")
    spark.range(2).select(F.lit("y").alias("code"), F.lit("7").alias("label"), F.col("id").cast("int").alias("func_id")).write.parquet(f"{base}/b")
    got = tb.scan_projects(spark, {"first": f"{base}/a", "second": f"{base}/b"})
    assert [f.name for f in got.schema.fields] == ["project", *tb.FUNCTION_SCHEMA.names, "file"]
    rows = got.collect()
    assert {(r.project, r.func_id, r.code, r.label, r.latent) for r in rows} == {("first", i, "x", 1, 0) for i in range(3)} | {
        ("second", i, "y", 7, None) for i in range(2)}
    assert all(("/a/" if r.project == "first" else "/b/") in r.file for r in rows)
