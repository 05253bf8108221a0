"""Helpers that several operators share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchwork.session import ensure_checkpoint_dir, settle  # noqa: F401  (settle is re-used by the operators)

#: White space of the contracts: blank, and tab to carriage return. ``bytes.split()`` cuts at exactly these.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a pattern for the JVM.
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
#: Share of the documents that no model learns from: remainder 0.
FOLDS = 5


def ship(module: str) -> None:
    """Let tasks carry this module's functions, so that executors need no installed copy."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def worker_cache() -> dict:
    """A dictionary of this Python process that outlives a task.

    It only holds what can be built again (tokenizers, automata), keyed by what it was built from.
    """
    module = sys.modules.setdefault("_stitchwork_worker_cache", types.ModuleType("_stitchwork_worker_cache"))
    return module.__dict__.setdefault("held", {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """df, written once as Parquet to the shared checkpoint folder: later reads take single columns, compressed.

    ``rows_a_file`` bounds a file of long rows, 0 doesn't.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: A key is hot if it owns more than one in so many rows; so at most so many keys are hot.
HOT_SHARE = 1_000


def met(df: DataFrame, facts: DataFrame, key: str, rows: str) -> DataFrame:
    """df joined with facts on ``key`` (null equals null): facts has one row for each key of df, and in ``rows`` how many
    rows of df it is for.

    Hot keys, of which there are at most ``HOT_SHARE``, are broadcast; the
    others meet by an equi-join in which no key has more than its share.
    """
    total = facts.agg(F.sum(rows)).first()[0] or 0
    own = [F.col(c).alias(f"_{c}") if c == key else F.col(c) for c in facts.columns if c != rows]
    hot = F.broadcast(facts.filter(F.col(rows) * HOT_SHARE > total).select(*own))
    cold = facts.filter(F.col(rows) * HOT_SHARE <= total).select(*own)
    same = F.col(key).eqNullSafe(F.col(f"_{key}"))
    both = df.join(hot, same).unionByName(df.join(hot, same, "left_anti").join(cold, same))
    return both.drop(f"_{key}")


def held_out(doc_id: str | Column) -> Column:
    """Documents that are kept from training. A null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def texts_of(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    """A batch's texts; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def portions(texts: list, chars: int) -> Iterator[list]:
    """Consecutive slices of texts (or nulls) of about so many characters, one text at least."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") < chars):
            size += len(texts[end] or "")
            end += 1
        yield texts[at:end]
        at = end


def by_rank(column: Column, seed: int) -> Column:
    """A fixed pseudo-random order of ids, the same on every partitioning."""
    return F.xxhash64(column, F.lit(seed))


ship(__name__)
