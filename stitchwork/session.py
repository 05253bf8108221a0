"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "stitchwork", cores: int | None = None, **extra: str) -> SparkSession:
    """A session with AQE, UTC and ANSI on.

    Executor sizing and shuffle partition counts belong to the cluster's own
    configuration; the values below are only for a local run.
    """
    cores = cores or os.cpu_count() or 8
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for the jobs started inside; the session's own comes back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names it on a cluster. Only where that is unset
    on a local master (tests on one machine) a fresh local folder is used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(current)
    return current


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, which survives executor loss.

    Worth it in front of an operator that reads its input several times
    (``operators.ordered``) when that input is itself expensive.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
