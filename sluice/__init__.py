"""sluice: Spark-native curation and evaluation of labelled source-code function tables.

Sub-packages
------------
sources    scans of the input tables, fixture views, sinks
functions  column expressions (hashing, line/flaw parsing, token folds, distances)
operators  DataFrame -> DataFrame operators (curation, splits, ranking, metrics, denoising, models)
plans      end-to-end compositions (split building, line evaluation, experiments)
streaming  incremental ingestion of metric log lines
"""

from sluice.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
