"""Fresh folders for derived files, on the shared storage the session names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from stitchwork.session import ensure_checkpoint_dir


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
