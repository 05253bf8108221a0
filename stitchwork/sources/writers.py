"""Sinks: logs, routed datasets, label tables, versioned snapshots, reports, request lines."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchwork.rules import garments as G
from stitchwork.session import setting

#: Folders that a task of ``write_routed`` writes side by side, without sorting its rows; rows of further folders are sorted.
OPEN_ROUTES = 64


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_routed(records: DataFrame, path: str, mode: str = "append") -> None:
    """Routed dataset: routing is the partition value, so a move is a new value and never a file move.

    The rows are rebalanced by route first: a task writes few folders, and a
    large route is split over several tasks. As the folders are few, a task
    keeps their files open and holds no rows for a sort by route.
    """
    route = ["status_group", "stream", "demographic", "tier"]
    filled = records.withColumns({c: F.coalesce(c, F.lit("none")) for c in ("stream", "demographic", "tier")})
    with setting(records.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_ROUTES)):
        filled.hint("rebalance", *route).write.mode(mode).partitionBy(*route).parquet(path)


def label_columns(labels: DataFrame, category: str) -> DataFrame:
    """Columns in schema order as text; absent fields become empty."""
    have = set(labels.columns)
    return labels.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else
                           F.lit("").alias(c) for c in G.schema_columns(category)])


def write_labels(labels: DataFrame, path: str, category: str) -> None:
    """Spark commits the folder as a whole, so readers never see half a table."""
    label_columns(labels, category).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def preview(df: DataFrame, root: str, key: str) -> DataFrame:
    """Cells that publishing df would change against the current version: key, column, old_value, new_value as text.

    Cells of a row that only one side has show null on the other.
    """
    columns = [c for c in df.columns if c != key]

    def cells(rows: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias(name)) for c in columns])
        return rows.select(key, F.explode(pairs).alias("_c")).select(key, "_c.column", f"_c.{name}")
    both = cells(read_published(df.sparkSession, root), "old_value").join(cells(df, "new_value"), [key, "column"], "full")
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def publish(df: DataFrame, root: str, write: bool = False, version: str | None = None) -> str | None:
    """Versioned snapshot: the new version is complete before the pointer moves, older ones stay.

    Without ``write`` nothing happens (dry run is the default; ``preview``
    gives the cells that would change). Publications are numbered, not timed:
    the last to be published is current, whatever the clocks of the drivers
    say, and versions may have any names.
    """
    if not write:
        return None
    version = version or f"{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(f"{root}/v={version}")
    spark = df.sparkSession
    numbers = [int(r[0]) for r in _pointers(spark, root).select("number").collect()] if _exists(spark, f"{root}/_versions") else []
    _claim_pointer(spark, f"{root}/_versions", max(numbers, default=0) + 1, version)
    return version


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _claim_pointer(spark: SparkSession, folder: str, number: int, version: str) -> int:
    """Create the first free pointer file from ``number`` on, never over another one, and return its number.

    Exclusive where the file system's create without overwrite is atomic.
    """
    while True:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{number:020d}")
        try:
            stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
        except Py4JJavaError:
            if not _exists(spark, f"{folder}/{number:020d}"):
                raise
            number += 1
            continue
        stream.write(bytearray(f"{version}\n", "utf-8"))
        stream.close()
        return number


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    """number (text of fixed width, in order of publication) and value (the file's text), one row per pointer file."""
    return spark.read.text(f"{root}/_versions", wholetext=True).select(F.col("_metadata.file_name").alias("number"), "value")


def published_versions(spark: SparkSession, root: str) -> DataFrame:
    """number and version of every publication. A pointer without its line end isn't complete yet and doesn't count."""
    return _pointers(spark, root).where(F.col("value").endswith("\n")).select(
        F.col("number").cast("long").alias("number"), F.rtrim(F.col("value"), F.lit("\n")).alias("version"))


def current_version(spark: SparkSession, root: str) -> str:
    return published_versions(spark, root).agg(F.max_by("version", "number")).first()[0]


def read_published(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/v={version or current_version(spark, root)}")


def audit_report(summary: DataFrame, model: str, parameters: dict[str, str] | None = None) -> DataFrame:
    """Report header as one JSON row; the results stay a table of their own (see ``write_audit``)."""
    fields = [F.lit(model).alias("model"), F.col("total").alias("sample_size")]
    fields += [F.lit(v).alias(k) for k, v in (parameters or {}).items()]
    return summary.select(F.to_json(F.struct(*fields, F.struct(*[c for c in summary.columns if c != "total"])
                                             .alias("summary"))).alias("value"))


def write_audit(results: DataFrame, summary: DataFrame, path: str, model: str,
                parameters: dict[str, str] | None = None) -> None:
    """Summary document and result lines side by side.

    The results are not folded into the document: one JSON array of every
    row would have to pass through one task.
    """
    audit_report(summary, model, parameters).coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    results.write.mode("overwrite").json(f"{path}/results")


def write_schema_files(folder: str) -> list[str]:
    """One small schema document per category, written by the driver through Hadoop's file system."""
    spark = SparkSession.active()
    paths = []
    for category in G.CATEGORIES:
        path = f"{folder}/label_schema_{category}.json"
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        stream.write(bytearray(json.dumps(G.label_schema(category), indent=2), "utf-8"))
        stream.close()
        paths.append(path)
    return paths


def request_lines(items: DataFrame, key: Column, content: Column, prompt: Column, mime: str = "image/jpeg",
                  system: Column | None = None, temperature: float = 0.1) -> DataFrame:
    """Batch-inference request per row as a JSON line."""
    parts = F.array(
        F.struct(F.struct(F.lit(mime).alias("mime_type"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")).alias("data")).alias("inline_data"),
                 F.lit(None).cast("string").alias("text")),
        F.struct(F.lit(None).cast("struct<mime_type:string,data:string>").alias("inline_data"), prompt.alias("text")))
    request = [F.array(F.struct(F.lit("user").alias("role"), parts.alias("parts"))).alias("contents")]
    if system is not None:
        request.append(F.struct(F.array(F.struct(system.alias("text"))).alias("parts")).alias("system_instruction"))
    request.append(F.struct(F.lit(temperature).alias("temperature"),
                            F.lit("application/json").alias("response_mime_type")).alias("generation_config"))
    return items.select(F.to_json(F.struct(key.alias("key"), F.struct(*request).alias("request"))).alias("value"))
