"""Repeated passages by sparse suffix arrays.

Only suffixes that start at content-selected minimisers are kept: in each run
of 31 neighbouring 20-word grams the one with the smallest hash. Every passage
of 50 words contains such a place, and equal passages contain it at the same
offset. The kept suffixes are sorted and compared with their neighbours; those
that share their first 20 words with one are extended to the left and right: a
50-word window around the place counts if another place has it too. Extents
come from the outermost windows of a place; the windows between are looked at
where an outermost one has no partner, or places with the same gram differ in
extent. The result is the union of all 50-word windows that occur at two or
more places, without pairing places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stitchwork.llm.common import ship, texts_of, written

MIN_WORDS = 50
GRAM_WORDS = 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split()
    return _mixed(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))


class Rolling:
    """Hashes of all stretches of a text's words."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(_INVERSE, n + 1)

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.sums[starts + length] - self.sums[starts]) * self.back[starts])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in every run of ``width``."""
    n = len(values)
    pad = -n % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[:n]
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    starts = np.arange(n - width + 1)
    least = np.minimum(behind[starts], ahead[starts + width - 1])
    # The place: the first one at or after the start that has the value.
    order = np.lexsort((np.arange(n), values))
    ranked = values[order]
    first = np.searchsorted(ranked, least, side="left")
    last = np.searchsorted(ranked, least, side="right")
    places = order[first]
    for i in np.flatnonzero(last - first > 1):
        run = order[first[i]:last[i]]
        places[i] = run[np.searchsorted(run, starts[i])]
    return places


def anchors(text: str, min_words: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """places, gram hashes, and of the windows that each place stands for: first and last start, and their hashes."""
    hashes = word_hashes(text)
    if len(hashes) < min_words:
        return None
    rolling = Rolling(hashes)
    grams = rolling.at(np.arange(len(hashes) - gram + 1), gram)
    places = sliding_least(grams, min_words - gram + 1)
    edge = np.flatnonzero(np.diff(places)) + 1
    low, high = np.concatenate([[0], edge]), np.concatenate([edge, [len(places)]]) - 1
    return places[low], grams[places[low]], low, high, rolling.at(low, min_words), rolling.at(high, min_words)


SCHEMA = "key long, id {kind}, place int, low int, high int, low_hash long, high_hash long"


def sparse_suffixes(docs: DataFrame, id: str, text: str, min_words: int, gram: int) -> DataFrame:
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, found = [], []
            for i, value in enumerate(texts_of(batch)):
                own = anchors(value, min_words, gram) if len(value) >= 2 * min_words - 1 else None
                if own:
                    found.append(own)
                    owners.append(np.full(len(own[0]), i))
            if found:
                place, key, low, high, low_hash, high_hash = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), batch.column(0).take(pa.array(np.concatenate(owners))),
                     *[pa.array(x.astype(np.int32)) for x in (place, low, high)],
                     *[pa.array(x.view(np.int64)) for x in (low_hash, high_hash)]],
                    names=["key", "id", "place", "low", "high", "low_hash", "high_hash"])

    return docs.select(id, text).mapInArrow(run, SCHEMA.format(kind=kind))


def neighbours(suffixes: DataFrame) -> DataFrame:
    """The suffixes that share their first gram with a neighbour in sorted order.

    The sort order ends with id and place, so range partitioning splits a
    passage that many documents share. The outermost rows of a range may have
    their partner in the next one: they stay too, and the windows decide.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the batch before, and whether it is settled
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            same = keys[1:] == keys[:-1]
            stays = np.zeros(len(keys), bool)
            stays[1:] |= same
            stays[:-1] |= same
            stays[0] |= first or held is not None and carried
            carried = bool(stays[-1])
            held = batch.slice(len(keys) - 1)
            first = False
            yield batch.slice(0, len(keys) - 1).filter(pa.array(stays[:-1]))
        if held is not None:
            yield held

    ordered = suffixes.repartitionByRange("key", "low_hash", "id", "place").sortWithinPartitions("key", "low_hash", "id", "place")
    return ordered.mapInArrow(run, suffixes.schema)


def _shared(windows: DataFrame) -> DataFrame:
    """hash, first (the smallest place) of the windows that two or more places have."""
    return (windows.groupBy("hash").agg(F.min("at").alias("first"), F.max("at").alias("last"))
            .filter("first <> last").select(F.col("hash").alias("shared_hash"), "first"))


def _all_windows(docs: DataFrame, wanted: DataFrame, id: str, text: str, min_words: int) -> DataFrame:
    """hash, id, start of every window of the wanted places (id, low, high)."""
    kind = docs.schema[id].dataType.simpleString()
    ranges = wanted.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("low", "high")).alias("_ranges"))
    met = docs.select(F.col(id).alias("_own"), F.col(text).alias("_text")).join(ranges, F.col("_own").eqNullSafe(F.col("_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, starts, hashes = [], [], []
            for i, (value, ranges) in enumerate(zip(texts_of(batch), batch.column(2).to_pylist())):
                own = word_hashes(value)
                at = np.unique(np.concatenate([np.arange(r["low"], r["high"] + 1) for r in ranges]))
                at = at[at <= len(own) - min_words]  # an id whose texts differ
                if len(at):
                    owners.append(np.full(len(at), i))
                    starts.append(at)
                    hashes.append(Rolling(own).at(at, min_words))
            if owners:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hashes).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(owners))),
                     pa.array(np.concatenate(starts).astype(np.int32))], names=["hash", "id", "start"])

    return met.select("_own", "_text", "_ranges").mapInArrow(run, f"hash long, id {kind}, start int")


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
            gram: int = GRAM_WORDS) -> DataFrame:
    """One row per repeated stretch of a document: id, start_word, end_word (exclusive, words cut at ASCII white space), removable.

    removable false: the union of all windows of min_words that occur at two
    or more places, in one document or several. removable true: the union of
    those windows that occur at a smaller (id, word) too. Rows that repeat an
    id are one document: equal windows at the same word are one place.
    A null id is an id of its own, smaller than others. Null, empty and short
    texts have no row; nor has an empty table.
    """
    found = written(sparse_suffixes(docs, id, text, min_words, gram), "suffixes")
    kept = written(neighbours(found), "neighbours")
    ends = kept.select(F.explode(F.array(F.struct(F.col("low_hash").alias("hash"), F.struct("id", F.col("low").alias("start")).alias("at")),
                                         F.struct(F.col("high_hash").alias("hash"), F.struct("id", F.col("high").alias("start")).alias("at"))))
                       .alias("w")).select("w.hash", "w.at")
    shared = written(_shared(ends), "ends")
    low = shared.select(F.col("shared_hash").alias("low_hash"), F.col("first").alias("low_first"))
    high = shared.select(F.col("shared_hash").alias("high_hash"), F.col("first").alias("high_first"))
    judged = written(kept.join(low, "low_hash", "left").join(high, "high_hash", "left"), "judged")
    whole = F.col("low_first").isNotNull() & F.col("high_first").isNotNull()

    def later(first: str, start: str):
        return F.col(first) < F.struct(F.col("id").alias("id"), F.col(start).alias("start"))

    def span(removable: bool, start: str, last: str):
        return F.struct(F.lit(removable).alias("removable"), F.col(start).alias("start"), (F.col(last) + min_words).alias("end"))

    # Places with a partner at both outermost windows: all between is covered by these two.
    complete, low_later, high_later = judged.filter(whole), later("low_first", "low"), later("high_first", "high")
    spans = complete.select("id", F.explode(F.array(
        span(False, "low", "high"),
        F.when(low_later & high_later, span(True, "low", "high")).when(low_later, span(True, "low", "low"))
        .when(high_later, span(True, "high", "high")))).alias("s"))
    spans = spans.filter("s is not null").select("id", "s.removable", "s.start", "s.end")
    # All windows of the others, and of complete places that another place with the same gram differs from: an inner window
    # may occur earlier there. Of complete places that are equal from end to end, the first stands for all; the rest are
    # later at both ends, so they are done.
    # They are reduced before they meet the keys, so a passage that many documents share is one row there.
    incomplete = judged.filter(~whole)
    extent = F.struct("low_hash", "high_hash", F.col("high") - F.col("low"))
    unequal = (judged.groupBy("key").agg(F.max(~whole).alias("_open"), F.min(extent).alias("_least"), F.max(extent).alias("_most"))
               .filter("_open or _least <> _most").select("key"))
    equals = (judged.filter(whole).groupBy("key", "low_hash", "high_hash", (F.col("high") - F.col("low")).alias("_span"))
              .agg(F.min(F.struct("id", "low", "high")).alias("_first"))
              .join(unequal, "key", "left_semi"))
    wanted = incomplete.select("id", "low", "high").unionByName(equals.select("_first.*"))
    windows = written(_all_windows(docs, wanted, id, text, min_words), "windows")
    partners = _shared(windows.select("hash", F.struct("id", "start").alias("at")))
    inner = windows.join(partners, F.col("hash") == F.col("shared_hash"))
    inner = inner.select("id", F.explode(F.when(later("first", "start"), F.array(F.lit(False), F.lit(True)))
                                         .otherwise(F.array(F.lit(False)))).alias("removable"),
                         "start", (F.col("start") + min_words).alias("end"))
    return merged(spans.unionByName(inner)).withColumnRenamed("id", id)


def merged(spans: DataFrame) -> DataFrame:
    """id, start_word, end_word, removable: touching and overlapping spans as one. Per document, so bounded by its length."""
    spans = spans.groupBy("id", "removable", "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy("id", "removable").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cut = spans.withColumn("fresh", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    numbered = cut.withColumn("number", F.sum("fresh").over(order))
    return (numbered.groupBy("id", "removable", "number").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
            .select("id", "start_word", "end_word", "removable"))


ship(__name__)
