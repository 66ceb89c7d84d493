"""Session construction and shared-storage helpers.

Cluster settings (shuffle partitions, checkpoint folder, memory) belong to whoever launches
the job; ``get_session`` only fills in values that are unset, so the same code runs in tests
on ``local[*]`` and on a cluster.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults applied only when the launcher did not set them.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # bounded status-store history: long query sequences keep the driver heap flat
    "spark.ui.retainedJobs": "200",
    "spark.ui.retainedStages": "200",
    "spark.sql.ui.retainedExecutions": "50",
}
# Only for a JVM started here (local runs); a launcher's setting wins.
_LOCAL_DRIVER_MEMORY = os.environ.get("SLUICE_LOCAL_DRIVER_MEMORY", "8g")


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "sluice") -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        spark = active
        for key, value in _DEFAULTS.items():
            if spark.conf.get(key, None) is None:
                try:
                    spark.conf.set(key, value)
                except Exception:  # static settings of a running session stay as launched
                    pass
    else:
        builder = SparkSession.builder.appName(app_name)
        if master:
            builder = builder.master(master)
            if master.startswith("local"):
                builder = builder.config("spark.driver.memory", _LOCAL_DRIVER_MEMORY)
        for key, value in _DEFAULTS.items():
            builder = builder.config(key, value)
        if shuffle_partitions:
            builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster the launcher must set it to shared storage. Only a local-mode session
    without one (tests, the bench) gets a fresh private folder.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="sluice-ckpt-")
    spark.conf.set("spark.checkpoint.dir", folder)
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def persist_table(spark: SparkSession, df, name: str):
    """Write ``df`` below the shared checkpoint folder and read it back: cuts lineage so an
    expensive input (e.g. folded line scores) is computed once however many jobs read it,
    and survives executor loss."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def release_unreferenced(spark: SparkSession) -> None:
    """Let Spark's ContextCleaner drop broadcasts, shuffle files and checkpoints of finished
    iterations in a long driver loop (it acts when the JVM collects their references)."""
    import gc

    gc.collect()  # drop Python-side proxies first
    spark.sparkContext._jvm.System.gc()
