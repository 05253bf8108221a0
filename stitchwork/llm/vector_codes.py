"""Vector codes: every vector as one codebook index per part, by k-means on metric trees over the parts.

Vectors are dealt in blocks. For each block and part a metric tree is built
once, middle-out (anchors hierarchy): about sqrt(n) anchors, each stealing the
points that are nearer to it, are merged upwards pair by pair and divided
downwards the same way. Every ball caches the sum and the count of its points.
Trees and blocks are written to the shared folder, so that the rounds only read
them. A round walks down from the roots with a list of candidate entries that
each ball inherits from its parent and shrinks: an entry that is farther than
another one from every point of the ball goes. A ball with one candidate left
is wholly owned and adds its cached sums; what reaches a leaf is compared point
by point, in integers. So codes and codebooks are exact, whatever the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stitchwork.llm.common import ship, written
from stitchwork.llm.vectors import integers, is_finite, totals, with_sums

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors of a block: what one task holds with its trees, about 2 MB at 64 components.
BLOCK = 4_096
#: Blocks of a written file, so that a task reads no more than some 100 MB at once.
BLOCKS_A_FILE = 64
#: Points of a ball that is not divided further.
LEAF = 32
#: Bounds are compared in floating point; a candidate goes only if it is beaten by more than this share.
SLACK = 1e-9


def _node_type(width: int) -> np.dtype:
    return np.dtype([("start", "<i4"), ("end", "<i4"), ("left", "<i4"), ("right", "<i4"), ("radius", "<f8"), ("sum", "<i8", (width,))])


def _anchors(points: np.ndarray, most: int) -> np.ndarray:
    """The anchor that owns each point; each new anchor is the point farthest from the anchors so far."""
    centre = points.mean(axis=0)
    ones = np.ones(points.shape[1])
    first = int((((points - centre) ** 2) @ ones).argmax())
    distance = ((points - points[first]) ** 2) @ ones
    owner = np.zeros(len(points), np.int64)
    for anchor in range(1, most):
        far = int(distance.argmax())
        if distance[far] == 0:
            break
        new = ((points - points[far]) ** 2) @ ones
        stolen = new < distance
        owner[stolen] = anchor
        distance = np.minimum(distance, new)
    return owner


def _divide(points: np.ndarray, rows: np.ndarray) -> tuple | np.ndarray:
    """A ball as a pair of balls, or as the rows of a leaf."""
    own = points[rows]
    if len(rows) <= LEAF or (own == own[0]).all():
        return rows
    owner = _anchors(own, max(2, int(np.sqrt(len(rows)))))
    by_owner = owner.argsort(kind="stable")
    sizes = np.bincount(owner).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)
    laid = own[by_owner]
    centres = np.add.reduceat(laid, starts) / sizes[:, None]
    radii = np.sqrt(np.maximum.reduceat(((laid - centres[owner[by_owner]]) ** 2) @ np.ones(own.shape[1]), starts))
    balls = [_divide(points, group) for group in np.split(rows[by_owner], starts[1:])]

    def merged(i: int) -> np.ndarray:
        """Radius of the ball around i and each other ball."""
        gap = np.sqrt(((centres - centres[i]) ** 2) @ np.ones(own.shape[1]))
        out = np.maximum((gap + radii + radii[i]) / 2, np.maximum(radii, radii[i]))
        out[i] = np.inf
        return out

    cost, gone = np.array([merged(i) for i in range(len(balls))]), np.zeros(len(balls), bool)
    for _ in range(len(balls) - 1):  # upwards: the two balls that fit in the smallest one
        i, j = divmod(int(cost.argmin()), len(balls))
        gap = np.sqrt(((centres[i] - centres[j]) ** 2).sum())
        share = sizes[j] / (sizes[i] + sizes[j])
        radii[i] = max(radii[i] + gap * share, radii[j] + gap * (1 - share))
        centres[i] += (centres[j] - centres[i]) * share
        sizes[i] += sizes[j]
        balls[i], balls[j] = (balls[i], balls[j]), None
        cost[j, :] = cost[:, j] = np.inf
        gone[j] = True
        row = merged(i)
        row[gone] = np.inf
        cost[i, :] = cost[:, i] = row
    return balls[i] if len(balls) > 1 else balls[0]


def tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points in ball order, and the balls, root first: range of points, children (-1: leaf), radius, sum."""
    order, spans = [], []

    def lay(ball, start: int) -> int:
        at = len(spans)
        spans.append([start, 0, -1, -1])
        if isinstance(ball, tuple):
            spans[at][2] = len(spans)
            middle = lay(ball[0], start)
            spans[at][3] = len(spans)
            spans[at][1] = lay(ball[1], middle)
        else:
            order.append(ball)
            spans[at][1] = start + len(ball)
        return spans[at][1]

    lay(_divide(points.astype(np.float64), np.arange(len(points))), 0)
    order = np.concatenate(order)
    balls = np.zeros(len(spans), _node_type(points.shape[1]))
    balls["start"], balls["end"], balls["left"], balls["right"] = np.array(spans).T
    laid = points[order]
    sums = np.vstack([np.zeros(points.shape[1], np.int64), np.cumsum(laid, axis=0)])
    balls["sum"] = sums[balls["end"]] - sums[balls["start"]]
    ones = np.ones(points.shape[1])
    balls["radius"] = [np.sqrt((((laid[start:end] - centre) ** 2) @ ones).max())
                       for start, end, centre in zip(balls["start"].tolist(), balls["end"].tolist(), _centres(balls))]
    return order, balls


def _centres(balls: np.ndarray) -> np.ndarray:
    return balls["sum"] / (balls["end"] - balls["start"])[:, None]


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to all entries."""
    if max(abs(points).max(initial=0), abs(entries).max(initial=0)) < 2**20:  # every sum is an exact double
        x, y = points.astype(np.float64), entries.astype(np.float64)
        return (x**2).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y**2).sum(axis=1)
    return ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def walk(points: np.ndarray, order: np.ndarray, balls: np.ndarray, entries: np.ndarray, codes: np.ndarray | None = None
         ) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum and count of the points that each entry owns, and how many of them came from caches; fills ``codes``."""
    sums, counts, cached = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64), 0
    between = np.sqrt(((entries[:, None, :] - entries[None, :, :]).astype(np.float64) ** 2).sum(axis=2))
    front, candidates = np.array([0]), np.ones((1, len(entries)), bool)
    while len(front):
        own = balls[front]
        centres = _centres(own)
        away = ((centres[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        open_ = np.where(candidates, away, np.inf)
        best = open_.argmin(axis=1)
        least = open_[np.arange(len(front)), best]
        # Every point of the ball is nearer to the best entry than to e where this difference exceeds what the radius can make up.
        reach = 2 * own["radius"][:, None] * between[best]
        keep = candidates & ~(away - least[:, None] > reach + SLACK * (away + reach + 1))
        keep[np.arange(len(front)), best] = True
        owned = keep.sum(axis=1) == 1
        leaf = ~owned & (own["left"] < 0)
        np.add.at(sums, best[owned], own["sum"][owned])
        np.add.at(counts, best[owned], (own["end"] - own["start"])[owned])
        cached += int((own["end"] - own["start"])[owned].sum())
        if codes is not None:
            for ball, entry in zip(own[owned], best[owned]):
                codes[order[ball["start"]:ball["end"]]] = entry
        if leaf.any():
            lengths = (own["end"] - own["start"])[leaf]
            which = np.repeat(np.flatnonzero(leaf), lengths)
            rows = order[np.concatenate([np.arange(s, e) for s, e in zip(own["start"][leaf], own["end"][leaf])])]
            squares = _squares(points[rows], entries)
            nearest = np.where(keep[which], squares, np.iinfo(np.int64).max).argmin(axis=1)  # the first of equals
            for position in range(points.shape[1]):
                sums[:, position] += np.bincount(nearest, points[rows, position], len(entries)).astype(np.int64)
            counts += np.bincount(nearest, minlength=len(entries))
            if codes is not None:
                codes[rows] = nearest
        down = ~owned & ~leaf
        front = np.concatenate([own["left"][down], own["right"][down]])
        candidates = np.concatenate([keep[down], keep[down]])
    return sums, counts, cached


def _block_rows(schema: pa.Schema, size: int, parts: int, scale: int) -> Callable:
    width = size // parts

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows).combine_chunks()
        vectors = integers(whole.column(2).combine_chunks() if whole.num_rows else whole.column(2), size, scale)
        grown = [tree(vectors[:, p * width:(p + 1) * width]) for p in range(parts)]
        return pa.RecordBatch.from_arrays([
            pa.array([whole.column(0).to_pylist()], schema.field(0).type), pa.array([whole.column(1).to_pylist()], schema.field(1).type),
            pa.array([vectors.astype("<i4").tobytes()], pa.binary()),
            pa.array([np.concatenate([o for o, _ in grown]).astype("<i4").tobytes()], pa.binary()),
            pa.array([[b.tobytes() for _, b in grown]], pa.list_(pa.binary()))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, BLOCK - n)
                held.append(piece)
                n, at = n + piece.num_rows, at + piece.num_rows
                if n == BLOCK:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return run


def _opened(batch: pa.RecordBatch, size: int, parts: int) -> Iterator[tuple]:
    """Blocks of a batch: its row, the vectors, and order and balls of each part."""
    width = size // parts
    for i in range(batch.num_rows):
        vectors = np.frombuffer(batch.column(2)[i].as_py(), "<i4").astype(np.int64).reshape(-1, size)
        orders = np.frombuffer(batch.column(3)[i].as_py(), "<i4").reshape(parts, -1)
        balls = [np.frombuffer(b, _node_type(width)) for b in batch.column(4)[i].as_py()]
        yield i, vectors, list(zip(orders, balls))


def _gather(codebooks: list[np.ndarray], size: int) -> Callable:
    """A task's sums for every part, entry and position."""
    parts, (entries, width) = len(codebooks), codebooks[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, vectors, trees in _opened(batch, size, parts):
                for p, (order, balls) in enumerate(trees):
                    s, n, _ = walk(vectors[:, p * width:(p + 1) * width], order, balls, codebooks[p])
                    sums[p] += s
                    counts[p] += n
        p, e = np.nonzero(counts)
        at = np.tile(np.arange(width), len(p))
        p, e = np.repeat(p, width), np.repeat(e, width)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (p, e, at, sums[p, e, at], counts[p, e])],
                                         names=["part", "entry", "position", "total", "n"])

    return run


def _code(codebooks: list[np.ndarray], size: int, schema: pa.Schema) -> Callable:
    parts, width = len(codebooks), codebooks[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, vectors, trees in _opened(batch, size, parts):
                codes, error = np.zeros((len(vectors), parts), np.int64), np.zeros(len(vectors), np.int64)
                for p, (order, balls) in enumerate(trees):
                    own = vectors[:, p * width:(p + 1) * width]
                    walk(own, order, balls, codebooks[p], codes[:, p])
                    error += ((own - codebooks[p][codes[:, p]]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[i].values, batch.column(1)[i].values,
                    pa.array(["".join([f"{c:02x}" for c in row]) for row in codes.tolist()], pa.string()),
                    pa.array(error, pa.int64())], schema=schema)

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: id, label, code, error, label_error, codebooks (decimal integers by part, entry, position).

    A vector that is null or holds a null, NaN or infinite component goes, as
    does one of another length than most (ties: the longer) of those that
    ``parts`` divides. Components become floor(scale * x); what lies beyond
    ``vectors.bound_of`` is held there, so that distances fit in 64 bits.
    Codebooks start as the parts of the vectors with the smallest ids; of equal
    ids the smaller vector comes first, null ids last. With fewer vectors than
    entries, codebooks are shorter. Rows that repeat an id are vectors of their
    own. Null labels are one label. An empty table gives no rows. Other columns
    are not read. ``entries`` is at most 256.
    """
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("entries lie between 1 and 256; there is one part at least")
    kinds = {f.name: f.dataType for f in vectors.schema.fields}
    rows = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).filter(is_finite("vector"))
    out = T.StructType([T.StructField(id, kinds[id]), T.StructField(label, kinds[label]), T.StructField("code", T.StringType()),
                        T.StructField("error", T.LongType())])
    usual = (rows.groupBy(F.size("vector").alias("size")).count().filter(f"size > 0 and size % {parts} = 0")
             .orderBy(F.desc("count"), F.desc("size")).limit(1).collect())
    if not usual:
        empty = vectors.sparkSession.createDataFrame([], out)
        return empty.select("*", F.lit(None).cast("long").alias("label_error"), F.lit("").alias("codebooks"))
    size = usual[0]["size"]
    rows = rows.filter(F.size("vector") == size)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    seeds = integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), size, scale)
    codebooks = np.split(seeds, parts, axis=1)

    kept = T.StructType([T.StructField("ids", T.ArrayType(kinds[id])), T.StructField("labels", T.ArrayType(kinds[label])),
                         T.StructField("vectors", T.BinaryType()), T.StructField("orders", T.BinaryType()),
                         T.StructField("balls", T.ArrayType(T.BinaryType()))])
    blocks = written(rows.mapInArrow(_block_rows(_arrow(kept), size, parts, scale), kept), "balls", BLOCKS_A_FILE)
    for _ in range(rounds):
        found = totals(blocks.mapInArrow(_gather(codebooks, size), "part long, entry long, position long, total long, n long"),
                       ["part", "entry", "position"])
        codebooks = [c.copy() for c in codebooks]
        for r in found:
            codebooks[r.part][r.entry, r.position] = r.total // r.n
    coded = written(blocks.mapInArrow(_code(codebooks, size, _arrow(out)), out), "codes")
    text = ",".join(str(x) for c in codebooks for x in c.ravel().tolist())
    return with_sums(coded, label, "error", "label_error").withColumn("codebooks", F.lit(text))


ship(__name__)
