"""SimHash near-duplicates with pigeonring candidate filtering.

A 64-bit fingerprint is cut into five segments that form a ring. If two
fingerprints differ in at most four bits, then at some segment a chain starts
whose first l segments differ in at most ``l * 4 / 5`` bits in total, for every
l from 1 to 5 (0, 1, 2, 3, 4 bits). The first links of a chain are an
equi-join: a segment equal, the next at most one bit off (26 bits), in large
corpora also the third, two bits off in all (39 bits). The rest of the chain
is tested before the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stitchwork.llm.common import met, settle, ship, texts_of
from stitchwork.llm.graph import components

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
#: Widths of the segments of the ring, from the lowest bit.
SEGMENTS = (13, 13, 13, 13, 12)
#: A join key with more fingerprints than this is linked through midpoints instead of pairs. Both give the same
#: components; the number only chooses the cheaper plan.
HOT_KEY = 2000

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = np.arange(8) * 256


def fingerprint(text: str, shingle: int = SHINGLE_WORDS) -> int:
    """64 bits, one set where more than half the shingle hashes have it; no word gives 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(w), SEED) for w in zip(*(words[i:] for i in range(shingle)))]
    values = np.array(hashes, dtype=np.uint64)
    counts = np.zeros((8, 256), np.int64)
    for part in np.array_split(values, len(values) // 1_000_000 + 1):
        lanes = part.view(np.uint8).reshape(-1, 8) + _LANES
        counts += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BITS).ravel() * 2 > len(values)
    return int.from_bytes(np.packbits(ones, bitorder="little").tobytes(), "little")


def _same(text: str) -> Column:
    """What tells two texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp (64 bits as a signed long) and same (a hash of the text) for every row; null text counts as empty."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x) for x in texts_of(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), batch.column(2)], names=[id, "fp", "same"])

    return docs.select(id, text, _same(text)).mapInArrow(run, f"{id} {kind}, fp long, same long")


def _segment(fp: Column, k: int) -> Column:
    k %= len(SEGMENTS)
    return F.shiftrightunsigned(fp, sum(SEGMENTS[:k])).bitwiseAND(F.lit((1 << SEGMENTS[k]) - 1))


#: From this many fingerprints on, a third link costs less than the chance meetings on two.
THREE_LINKS_FROM = 1_000_000_000


def _key(fp: Column, k: int, links: int) -> Column:
    """Ring position k and the segments of the chain's first links."""
    key = F.lit(k).cast("long")
    for i in range(links):
        key = F.shiftleft(key, 13).bitwiseOR(_segment(fp, k + i))
    return key


def _flips(k: int, links: int) -> list[int]:
    """What a partner's key at k may differ in: one bit in the second link, two in all up to the third."""
    def bits(i: int) -> list[int]:
        return [1 << b + 13 * (links - 1 - i) for b in range(SEGMENTS[(k + i) % len(SEGMENTS)])]
    second = [0, *bits(1)]
    if links == 2:
        return second
    third = bits(2)
    two = [x | y for i, x in enumerate(third) for y in third[:i]]
    return [*(x | y for x in second for y in [0, *third]), *two]


def _chain_holds(a: Column, b: Column, k: int) -> Column:
    """Every prefix of the chain from segment k stays within its share of the bits."""
    n = len(SEGMENTS)
    differing = [F.bit_count(_segment(a.bitwiseXOR(b), k + i)) for i in range(n)]
    holds = F.lit(True)
    total = F.lit(0)
    for i, bits in enumerate(differing):
        total = total + bits
        holds = holds & (total <= F.lit((i + 1) * MAX_BITS // n))
    return holds


def near_pairs(distinct: DataFrame, hot_key: int = HOT_KEY, links: int | None = None) -> DataFrame:
    """Links a, b between distinct fingerprints that connect whatever is MAX_BITS or less apart.

    distinct: one column fp. Pairs meet only on a shared chain start. A pair
    is emitted at its first valid chain, so it appears once. A key that more
    than ``hot_key`` fingerprints share emits no pairs: its members go through
    ``midpoint_links``, which costs the same for each of them. ``links`` (2 or
    3) is the number of links in the join key, by default what is cheaper for
    the number of fingerprints; the links found are the same.
    """
    links = links or (2 if distinct.count() < THREE_LINKS_FROM else 3)
    n = len(SEGMENTS)
    fp = F.col("fp")
    exact = distinct.select("fp", F.explode(F.array(*[_key(fp, k, links) for k in range(n)])).alias("key"))
    counts = exact.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot_key).select("key")
    hot = settle(counts)

    def around(k: int) -> Column:
        own = _key(fp, k, links)
        return F.transform(F.lit(_flips(k, links)).cast("array<long>"), lambda flip: own.bitwiseXOR(flip))
    probe = distinct.select(F.col("fp").alias("a"), F.explode(F.concat(*map(around, range(n)))).alias("key"))
    index = exact.withColumnRenamed("fp", "b")
    if hot.limit(1).count():
        index = index.join(hot, "key", "left_anti")
    a, b = F.col("a"), F.col("b")
    position = F.shiftright("key", 13 * links)
    first = F.coalesce(*[F.when(_chain_holds(a, b, k), F.lit(k)) for k in range(n)])
    pairs = (probe.join(index, "key").filter(a < b).filter(F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)
             .filter(first == position).select("a", "b"))
    if not hot.limit(1).count():
        return pairs
    # A hot key's members, and whoever may be one bit off it: all that the pairs left out.
    crowded = probe.join(hot, "key", "left_semi").select(F.col("a").alias("fp")).distinct()
    return pairs.unionByName(midpoint_links(crowded))


def midpoint_links(distinct: DataFrame) -> DataFrame:
    """Links that connect all fingerprints at most four bits apart, without pairing them.

    Two values are within four bits exactly if some value is within two bits
    of both. Each value names its 2,081 neighbours of up to two bits, and links
    to the smallest value that named the same neighbour: rows in proportion to
    the values, however dense they lie.
    """
    low = (distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
           .select("fp", "x", F.explode(F.sequence(F.lit(0), F.col("x"))).alias("y")))
    bit = lambda name: F.expr(f"shiftleft(1L, {name})")
    off = low.select("fp", F.col("fp").bitwiseXOR(bit("x").bitwiseOR(bit("y"))).alias("middle"))
    named = off.unionByName(distinct.select("fp", F.col("fp").alias("middle")))
    least = named.groupBy("middle").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b < top")
    return named.join(least.select("middle", "b"), "middle").select(F.col("fp").alias("a"), "b").filter("a <> b").distinct()


def _roots(seen: DataFrame, id: str, hot_key: int) -> DataFrame:
    """fp, root (the smallest fingerprint of the component), least (the smallest id of the fingerprint), n (its rows)."""
    classes = settle(seen.groupBy("fp").agg(F.min(id).alias("least"), F.count("*").alias("n")))
    parts = components(near_pairs(classes.select("fp"), hot_key))
    return classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root"))


def link(docs: DataFrame, id: str = "doc_id", text: str = "text", hot_key: int = HOT_KEY) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (smallest id reachable, itself included).

    Equal fingerprints are one node whatever their number. Null or wordless
    text has fingerprint zero and links like any other. A null id never
    becomes a component_id unless its component has no other. Repeated rows
    share a component. An empty table gives no rows.
    """
    seen = settle(fingerprints(docs, id, text).drop("same"))
    roots = settle(_roots(seen, id, hot_key))
    smallest = settle(roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n")))
    named = met(roots.select("fp", "root"), smallest, "root", "_n").select("fp", "component_id")
    return seen.join(named, "fp", "left").select(
        id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", hot_key: int = HOT_KEY) -> DataFrame:
    """docs without all but one row of each component: one of the smallest id stays (null ids come last).

    Rows are told apart by id and text: of an id with several texts only the
    text that represents its component stays, and each text that has no near
    copy does. Of rows that repeat an id and a text one stays. Columns are
    those of docs, in order. An empty table gives no rows.

    A task hands on one row of each id and text (window group limit), so a hot
    group is never gathered. Texts are shuffled twice.
    """
    seen = settle(fingerprints(docs, id, text).select(F.col(id).alias("id"), "fp", "same"))
    roots = _roots(seen.withColumnRenamed("id", id), id, hot_key).select("fp", "root")
    # The same order for every fingerprint and then for every component, so that both steps shrink on the map side.
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "same")
    firsts = seen.groupBy("fp").agg(F.min(order).alias("first"))
    winners = (firsts.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first"))
               .select(F.col("first.id").alias("_id"), F.col("first.same").alias("_same")))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id).alias("_own"), _same(text).alias("_text"))
    once = Window.partitionBy("_own", "_text").orderBy(F.xxhash64("_row"))
    rows = keyed.withColumn("_rank", F.row_number().over(once)).filter("_rank = 1")
    chosen = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_same"))
    return rows.join(winners, chosen, "left_semi").select("_row.*")


ship(__name__)
