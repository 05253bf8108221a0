"""Clusters around integer centroids, with distances from bit planes.

A vector of 64 components becomes one 64-bit word per bit of its two's
complement: bit i of plane b is bit b of component i. The dot product of two
such vectors is the weighted sum of the popcounts of ANDed planes, where plane
b weighs 2^b and the top plane weighs negative; so distances are exact
integers, and a vector of b bits takes b words instead of 64 numbers. Planes
are written once and read by every round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stitchwork.llm.common import ship, written
from stitchwork.llm.vectors import integers, is_finite, totals

#: Components of a vector: the bits of a word.
SIZE = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
#: Vectors that are compared at once; bounds the memory of a task.
PORTION = 8_192


def widths(rows: np.ndarray) -> np.ndarray:
    """Bits that each row needs in two's complement, sign included."""
    most = np.maximum(rows.max(axis=1), ~rows.min(axis=1))
    return np.ceil(np.log2(np.maximum(most, 0) + 1.0)).astype(np.int64) + 1


def pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Planes of rows (n x 64) as n x width words, lowest bit first."""
    bits = (rows[:, None, :] >> np.arange(width)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights(width: int) -> np.ndarray:
    out = 1 << np.arange(width, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def dots(planes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Dot products of packed vectors (n x a words) and packed centroids (k x b words)."""
    out = np.zeros((len(planes), len(other)), np.int64)
    for a, weight in enumerate(weights(planes.shape[1])):
        for b, by in enumerate(weights(other.shape[1])):
            out += (weight * by) * np.bitwise_count(planes[:, a, None] & other[None, :, b]).astype(np.int64)
    return out


def norms(planes: np.ndarray) -> np.ndarray:
    """Squared lengths, from the planes ANDed with each other."""
    out = np.zeros(len(planes), np.int64)
    scale = weights(planes.shape[1])
    for a, weight in enumerate(scale):
        for b, by in enumerate(scale):
            out += (weight * by) * np.bitwise_count(planes[:, a] & planes[:, b]).astype(np.int64)
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the squared distance."""
    packed = pack(centroids, int(widths(centroids).max()))
    squares = norms(planes)[:, None] - 2 * dots(planes, packed) + norms(packed)
    best = squares.argmin(axis=1)
    return best, squares[np.arange(len(best)), best]


def sums(planes: np.ndarray, cluster: np.ndarray, clusters: int) -> np.ndarray:
    """Sums of the components by cluster: weighted counts of each plane's bits."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(len(planes), -1, 8), axis=2, bitorder="little")
    out = np.zeros((clusters, SIZE), np.int64)
    for k in np.unique(cluster):
        out[k] = weights(planes.shape[1]) @ bits[cluster == k].sum(axis=0, dtype=np.int64)
    return out


def _pack_rows(schema: pa.Schema, scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PORTION):
                part = batch.slice(at, PORTION)
                rows = integers(part.column(1), SIZE, scale)
                need = widths(rows)
                for width in np.unique(need).tolist():
                    own = need == width
                    words = pack(rows[own], width).astype("<u8")
                    offsets = np.arange(0, words.size + 1, width, dtype=np.int32)
                    planes = pa.ListArray.from_arrays(offsets, pa.array(words.ravel().view("<i8"), pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(own)), planes.cast(schema.field(1).type)],
                                                     schema=schema)

    return run


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and planes of vectors of equal width."""
    column = batch.column(1)
    need = np.diff(column.offsets.to_numpy())
    words = column.flatten().to_numpy().view("<u8")
    ends = np.concatenate([[0], np.cumsum(need)])
    for width in np.unique(need).tolist():
        rows = np.flatnonzero(need == width)
        for at in range(0, len(rows), PORTION):
            own = rows[at:at + PORTION]
            yield own, words[ends[own][:, None] + np.arange(width)]


def _gather(centroids: np.ndarray) -> Callable:
    """A task's sums for every cluster and component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, planes in _portions(batch):
                cluster, _ = nearest(planes, centroids)
                total += sums(planes, cluster, len(centroids))
                n += np.bincount(cluster, minlength=len(centroids))
        k = np.repeat(np.flatnonzero(n), SIZE)
        at = np.tile(np.arange(SIZE), len(k) // SIZE)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k, at, total[k, at], n[k])],
                                         names=["cluster", "position", "total", "n"])

    return run


def _assign(centroids: np.ndarray, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, planes in _portions(batch):
                cluster, distance = nearest(planes, centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cluster, pa.int32()),
                                                  pa.array(distance, pa.int64())], schema=schema)

    return run


def cluster(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            scale: int = SCALE, seed: str = "1:") -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid (decimal integers).

    Kept are vectors of exactly 64 components, none of them null, NaN or
    infinite. Components become floor(scale * x); what lies beyond
    ``vectors.bound_of`` is held there, so that distances fit in 64 bits.
    Centroids start as the vectors whose SHA-256 of seed and id is smallest; of
    equal ids the smaller vector comes first, null ids last. With fewer vectors
    than ``clusters`` there are as many centroids. Rows that repeat an id are
    vectors of their own. An empty table gives no rows. Other columns are not
    read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    kind = vectors.schema[id].dataType
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector")).filter((F.size("vector") == SIZE) & is_finite("vector"))
    out = T.StructType([T.StructField(id, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    first = (rows.withColumn("hash", digest).orderBy(F.col("hash").asc_nulls_last(), "vector").limit(clusters)
             .select("vector").collect())
    if not first:
        empty = vectors.sparkSession.createDataFrame([], out)
        return empty.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"),
                            F.lit("").alias("centroid"))
    centroids = integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), SIZE, scale)
    packed = T.StructType([T.StructField("id", kind), T.StructField("planes", T.ArrayType(T.LongType()))])
    planes = written(rows.mapInArrow(_pack_rows(to_arrow_schema(packed), scale), packed), "planes")
    for _ in range(rounds):
        found = totals(planes.mapInArrow(_gather(centroids), "cluster long, position long, total long, n long"), ["cluster", "position"])
        centroids = centroids.copy()
        for r in found:
            centroids[r.cluster, r.position] = r.total // r.n
    assigned = written(planes.mapInArrow(_assign(centroids, to_arrow_schema(out)), out), "clusters")
    inertia = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    facts = vectors.sparkSession.createDataFrame(
        [(k, inertia.get(k, 0), sum(inertia.values()), ",".join(map(str, c))) for k, c in enumerate(centroids.tolist())],
        "cluster int, cluster_inertia long, inertia long, centroid string")
    return assigned.join(F.broadcast(facts), "cluster").select(*assigned.columns, "cluster_inertia", "inertia", "centroid")


ship(__name__)
