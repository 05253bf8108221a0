"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each level looks only at rows which the level before left in a group of two
or more: prefixes are read for rows of a shared length, whole texts for rows
of a shared (length, prefix). The keys of a level are numbers. Up to a counted
bound they are broadcast, so that rows meet them where they are and no text is
shuffled but those of surviving groups; beyond it, rows meet them in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stitchwork.llm.common import HOT_SHARE, settle

#: Characters that the second level hashes.
PREFIX_CHARS = 256
#: Keys of a level, one 64-bit number each, that are broadcast at most.
BROADCAST_KEYS = 1_000_000


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _keys(df: DataFrame, key: Column, name: str, broadcast_keys: int) -> DataFrame:
    """Values of a number that two or more rows of df share, with the hint that their count allows.

    Counted on the map side first, so a text that owns a third of all rows is
    one row of each task. In a shuffle the keys are the smaller side of every
    partition; hashing them spares a sort of the texts.
    """
    shared = settle(df.groupBy(key.alias(name)).agg(F.count("*").alias("_n")).filter("_n > 1").select(name))
    return shared.hint("broadcast" if shared.count() <= broadcast_keys else "shuffle_hash")


def full_hashes(docs: DataFrame, text: str = "text", prefix_chars: int = PREFIX_CHARS,
                broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """_doc (the row of docs), _text (null as empty), _full (SHA-256; null where a cheaper level told the row apart) and
    _key, which is _full or else something of its own, so that rows without a group don't meet in one task.
    """
    length = F.octet_length(_text(text)).cast("long")
    prefix = F.substring(_text(text), 1, prefix_chars)
    lengths = _keys(docs, length, "_shared_length", broadcast_keys)
    sized = docs.select(length.alias("_length"), prefix.alias("_prefix")).join(
        lengths, F.col("_length") == F.col("_shared_length"), "left_semi")
    cheap = F.xxhash64("_length", "_prefix")
    prefixes = _keys(sized, cheap, "_shared_prefix", broadcast_keys)
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), length.alias("_length"))
    rows = rows.join(lengths, F.col("_length") == F.col("_shared_length"), "left")
    whole = F.coalesce(F.col("_doc")[text], F.lit(""))
    # A length of its own is its key; the number can't make two texts equal, as only full hashes decide.
    own = F.when(F.col("_shared_length").isNotNull(), F.xxhash64("_length", F.substring(whole, 1, prefix_chars))).otherwise(
        F.xxhash64("_length"))
    rows = rows.select("_doc", own.alias("_cheap")).join(prefixes, F.col("_cheap") == F.col("_shared_prefix"), "left")
    full = F.when(F.col("_shared_prefix").isNotNull(), F.sha2(whole, 256))
    return rows.select("_doc", whole.alias("_text"), full.alias("_full"), F.concat(F.lit("#"), F.hex("_cheap")).alias("_own")).select(
        "_doc", "_text", "_full", F.coalesce("_full", "_own").alias("_key"))


def decide(docs: DataFrame, id: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS,
           extra: dict[str, Column] | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, plus ``extra`` columns.

    Texts are equal when identical; null counts as empty. Of equal texts the
    row with the largest id stays. A null id is smaller than any other; a group
    with null ids only keeps them (keep_id null). Rows that repeat an id with
    the same text are one document and share its decision; group_size counts
    them all. An empty table gives no rows.
    ``extra`` may use _text and _full (null outside surviving groups).
    """
    leveled = full_hashes(docs.select(id, text), text, prefix_chars, broadcast_keys)
    rows = leveled.select(F.col("_doc")[id].alias(id), "_full", "_key",
                          *[c.alias(n) for n, c in (extra or {}).items()])
    survivors = rows.filter(F.col("_full").isNotNull())
    groups = settle(survivors.groupBy("_full").agg(F.max(F.col(id)).alias("_best"), F.count("*").alias("_n")))
    total = groups.agg(F.sum("_n")).first()[0] or 0
    # Groups of over a thousandth of the rows, fewer than a thousand, are broadcast; their rows spread over all tasks then.
    is_hot = F.col("_n") * HOT_SHARE > total
    hot, cold = (groups.filter(which).select(F.struct("_best", "_n").alias(name), F.col("_full").alias(f"{name}_key"))
                 for which, name in ((is_hot, "_hot"), (~is_hot, "_cold")))
    joined = rows.join(F.broadcast(hot), F.col("_key") == F.col("_hot_key"), "left")
    spread = F.concat(F.lit("#"), F.hex(F.monotonically_increasing_id()))
    joined = joined.withColumn("_key", F.when(F.col("_hot").isNotNull(), spread).otherwise(F.col("_key")))
    joined = joined.join(cold, F.col("_key") == F.col("_cold_key"), "left")
    group = F.coalesce("_hot", "_cold")
    keep = F.when(group.isNull(), F.col(id)).otherwise(group["_best"])
    return joined.select(id, keep.alias("keep_id"), F.coalesce(group["_n"], F.lit(1)).cast("long").alias("group_size"),
                         F.col(id).eqNullSafe(keep).alias("kept"), *(extra or {}))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS,
             broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs without all but one row of equal texts: exactly one row stays, of the largest id.

    Columns are those of docs, in order. The ranking is cut to one row per
    group in each task before the shuffle (window group limit), so a hot text
    is never gathered. Rows which no cheaper level told apart rank by the full
    hash; the others are alone and pass through.
    """
    leveled = full_hashes(docs, text, prefix_chars, broadcast_keys)
    alone = leveled.filter(F.col("_full").isNull()).select("_doc.*")
    best = Window.partitionBy("_full").orderBy(F.col("_doc")[id].desc_nulls_last())
    first = (leveled.filter(F.col("_full").isNotNull()).withColumn("_rank", F.row_number().over(best))
             .filter("_rank = 1").select("_doc.*"))
    return alone.unionByName(first)
