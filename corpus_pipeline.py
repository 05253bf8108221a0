"""Documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stitchwork.llm import exact_dedup, hierarchical_packing, quality_rules, secret_scan, simhash
from stitchwork.llm.common import settle, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    return quality_rules.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts: the largest id."""
    return exact_dedup.keep_one(docs)


def representative_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of linked fingerprints: the smallest id."""
    return simhash.keep_representatives(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark."""
    return secret_scan.redact(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return hierarchical_packing.pack(docs)


STAGES = [
    ("quality rules", good_documents),
    ("exact dedup", distinct_documents),
    ("SimHash near-dedup", representative_documents),
    ("secret scans", clean_documents),
    ("packing", packed_documents),
]

#: Fingerprint links, decoding and token ids are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Each result is written to the checkpoint folder, so a lost executor costs no earlier stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
