"""Streams built from stateless plans, built-in dedup and idempotent batch writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stitchwork.functions.text import literals
from stitchwork.operators.ordered import first_per_key, top_per_key
from stitchwork.streaming.state import rocksdb


def landed(spark: SparkSession, folder: str, schema: StructType | str, glob: str | None = None,
           files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream; the trigger limit sets the pace."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def to_files(stream: DataFrame, out: str, checkpoint: str, by: list[str] | None = None) -> StreamingQuery:
    """Everything available now into a file sink, exactly once across restarts. State lies on disk, not in the heap."""
    writer = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
              .outputMode("append").trigger(availableNow=True))
    with rocksdb(stream.sparkSession):
        return (writer.partitionBy(*by) if by else writer).start()


def distinct_urls(stream: DataFrame, url: str = "url") -> DataFrame:
    """Each URL once over the life of the stream; the state holds every URL seen.

    Put ``without_known`` in front where an index of landed URLs exists, or
    use ``distinct_urls_within`` where the source has a time.
    """
    return stream.dropDuplicates([url])


def distinct_urls_within(stream: DataFrame, ts: str, delay: str, url: str = "url") -> DataFrame:
    """The same with bounded state: duplicates count as such within the watermark only."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([url])


def without_known(stream: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Stream-static anti join against an index of known keys."""
    return stream.join(known.select(key), key, "left_anti")


def unsent(stream: DataFrame, consumers: list[str], item: str, consumer: str = "host",
           own: Column | None = None) -> DataFrame:
    """Every item once per consumer, own items left out; a re-announced item is not sent again."""
    wide = stream.withColumn(consumer, F.explode(literals(consumers)))
    if own is not None:
        wide = wide.where(~F.coalesce(own, F.lit(False)))
    return wide.dropDuplicates([consumer, item])


def _latest(spark: SparkSession, folder: str, before: int) -> str | None:
    """The folder of the last batch below ``before`` that wrote one, looked up by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    batches = [int(n.partition("=")[2]) for n in names if n.startswith("batch=")]
    last = max((b for b in batches if b < before), default=None)
    return None if last is None else f"{folder}/batch={last}"


def quota_stream(stream: DataFrame, by: str, quota: int, order: list[Column], out: str,
                 checkpoint: str, classes: list | None = None) -> StreamingQuery:
    """First ``quota`` rows per class over the life of the stream.

    Each batch is limited per class before its shuffle, then against a counter
    per class: the totals that the last batch left beside its output, one row
    per class, so earlier output is never read again. A batch writes its own
    folders, rows before totals, so a replayed batch replaces itself. Once all
    of ``classes`` are full, batches pass without being read.
    """
    schema = stream.schema
    kind = schema[by].dataType.simpleString()

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = _latest(spark, f"{out}_taken", batch_id)
        before = spark.createDataFrame([], f"_class {kind}, _taken long") if last is None else spark.read.parquet(last)
        if classes and last and before.where(F.col("_class").isin(classes) & (F.col("_taken") >= quota)).count() >= len(set(classes)):
            return
        ranked = top_per_key(batch, [by], order, quota, rank="_rank")
        full = before.withColumnRenamed("_taken", "_full")
        kept = ranked.join(full, F.col(by).eqNullSafe(F.col("_class")), "left").where(F.col("_rank") + F.coalesce("_full", F.lit(0)) <= quota)
        kept.select(*schema.names).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        written = spark.read.schema(schema).parquet(f"{out}/batch={batch_id}")
        totals = before.unionByName(written.groupBy(F.col(by).alias("_class")).agg(F.count(F.lit(1)).alias("_taken")))
        totals.groupBy("_class").agg(F.sum("_taken").alias("_taken")).write.mode("overwrite").parquet(f"{out}_taken/batch={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def chunk_ledger(spark: SparkSession, out: str, chunk: str, kind: str = "string", before: int | None = None) -> DataFrame:
    """Chunks whose results are written, with the batch that wrote them."""
    if _latest(spark, f"{out}_chunks", before if before is not None else 1 << 62) is None:
        return spark.createDataFrame([], f"{chunk} {kind}, batch int")
    done = spark.read.schema(f"{chunk} {kind}, batch int").parquet(f"{out}_chunks")
    return done if before is None else done.where(F.col("batch") < before)


def unfinished(chunks: DataFrame, out: str, chunk: str) -> DataFrame:
    """Chunks that still need work: those without an entry in the ledger."""
    kind = chunks.schema[chunk].dataType.simpleString()
    return chunks.join(chunk_ledger(chunks.sparkSession, out, chunk, kind).select(chunk), chunk, "left_anti")


def merge_results(stream: DataFrame, out: str, checkpoint: str, chunk: str | None = None,
                  delivery: str | None = None) -> StreamingQuery:
    """Results of finished chunks, one folder per batch; replays overwrite their folder.

    With ``chunk`` a ledger of written chunks lies beside the output: a chunk
    that an earlier batch wrote is left out before any work on it. Of a chunk
    that comes twice in one batch the least ``delivery`` (a file's name, say)
    stays. Rows are written before their ledger entries, so a batch that died
    in between is simply written again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch
        if chunk:
            kind = batch.schema[chunk].dataType.simpleString()
            known = chunk_ledger(batch.sparkSession, out, chunk, kind, batch_id).select(chunk)
            fresh = batch.join(known, chunk, "left_anti")
            if delivery:
                first = fresh.groupBy(F.col(chunk).alias("_chunk")).agg(F.min(delivery).alias("_first"))
                own = F.col(chunk).eqNullSafe(F.col("_chunk")) & F.col(delivery).eqNullSafe(F.col("_first"))
                fresh = fresh.join(first, own, "left_semi")
            fresh = fresh.select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if chunk:
            done = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/batch={batch_id}").select(chunk).distinct()
            done.write.mode("overwrite").parquet(f"{out}_chunks/batch={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def merged_results(spark: SparkSession, out: str, key: str) -> DataFrame:
    """One result per key, the earliest batch wins."""
    rows = spark.read.parquet(out)
    return first_per_key(rows, [key], [F.col("batch")])
