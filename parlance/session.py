"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("parlance")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; a private one is made only for an unset local session.

    On a cluster executors could not see a folder of the driver's machine, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current:
            sc.setCheckpointDir(current)
    if not current:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="parlance-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


_SCAN_TASKS: dict[str, int] = {}


def more_scan_tasks(spark: SparkSession, per_core: int = 4, at_least: int = 1) -> None:
    """Lets scans of this session make several tasks a core, and `at_least` so many, unless the user has set their number.

    By itself a scan packs its files into about one task a core, by bytes.  Texts compress well and the work on a
    row is long, so that the largest such task, or one more than there are cores, takes most of a query's time.
    """
    name = "spark.sql.files.minPartitionNum"
    app, now = spark.sparkContext.applicationId, spark.conf.get(name, None)
    if now is None or now == str(_SCAN_TASKS.get(app)):
        # executors may have joined since, or a larger table come
        _SCAN_TASKS[app] = max(per_core * spark.sparkContext.defaultParallelism, at_least, _SCAN_TASKS.get(app, 1))
        spark.conf.set(name, str(_SCAN_TASKS[app]))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written intermediate table."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
