"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every token has a sparse random index vector; a token's vector is the sum of
the index vectors of its neighbours over all documents. Tokens are hashed into
a fixed number of rows, so the vectors have a fixed size. A document is the mean
of its tokens' vectors and of the products of neighbouring ones. The network is
trained on a bounded sample of labelled documents; a temperature fitted on a
part kept from training calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchwork.llm.common import by_rank, held_out, ship, texts_of

ROWS = 1 << 14
DIMENSIONS = 32
#: Places of an index vector that are +1 or -1.
NONZERO = 4
REACH = 2
#: Labelled documents that the network is fitted on, at most.
SAMPLE_DOCS = 20_000
HIDDEN = 32
EPOCHS = 40
CUT = 0.3
SEED = 7

_TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")
FEATURES = 2 * DIMENSIONS + 1


def token_rows(text: str) -> np.ndarray:
    """Row of each token: a run of letters and digits, or of other signs; case counts."""
    found = _TOKENS.findall(text.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(zlib.crc32, found), np.uint32, len(found)).astype(np.int64) & (ROWS - 1)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every row's index vector."""
    draw = np.random.default_rng(SEED)
    places = draw.permuted(np.tile(np.arange(DIMENSIONS), (ROWS, 1)), axis=1)[:, :NONZERO]
    return places, draw.choice((-1, 1), (ROWS, NONZERO))


def context_sums(docs: DataFrame, text: str = "text") -> DataFrame:
    """row, v0..v31: each token row's summed neighbours over all documents, whole numbers. At most ROWS rows."""
    names = [f"v{i}" for i in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        sums = np.zeros(ROWS * DIMENSIONS)
        for batch in batches:
            for value in texts_of(batch, 0):
                pass_rows = token_rows(value)
                for far in range(1, REACH + 1):
                    if len(pass_rows) > far:
                        for own, other in ((pass_rows[:-far], pass_rows[far:]), (pass_rows[far:], pass_rows[:-far])):
                            pending.append((own, other))
                            size[0] += len(own)
                if size[0] > 400_000:
                    _add(sums, places, signs)
            _add(sums, places, signs)
        table = sums.reshape(ROWS, DIMENSIONS).astype(np.int64)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(table[used, i]) for i in range(DIMENSIONS)]],
                                         names=["row", *names])

    pending: list = []
    size = [0]

    def _add(sums: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
        if pending:
            own, other = (np.concatenate(x) for x in zip(*pending))
            for k in range(NONZERO):
                sums += np.bincount(own * DIMENSIONS + places[other, k], signs[other, k], ROWS * DIMENSIONS)
            pending.clear()
            size[0] = 0

    counted = docs.select(text).mapInArrow(run, "row long, " + ", ".join(f"{n} long" for n in names))
    return counted.groupBy("row").agg(*[F.sum(n).alias(n) for n in names])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """ROWS x DIMENSIONS, each row of length 1 (or 0 where no token fell). Its size is fixed, whatever the corpus."""
    table = np.zeros((ROWS, DIMENSIONS), np.float64)
    for row in context_sums(docs, text).toLocalIterator():
        table[row[0]] = row[1:]
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    table = np.divide(table, norms, out=table, where=norms > 0)
    table -= table[norms[:, 0] > 0].mean(axis=0) if (norms > 0).any() else 0
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    return np.divide(table, norms, out=np.zeros_like(table), where=norms > 0).astype(np.float32)


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    """Mean vector, mean product of neighbours, and the logarithm of the number of tokens."""
    rows = token_rows(text)
    out = np.zeros(FEATURES)
    if len(rows):
        total, product, last = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), None
        for at in range(0, len(rows), 65_536):
            own = vectors[rows[at:at + 65_536]]
            total += own.sum(axis=0)
            product += np.einsum("ij,ij->j", own[:-1], own[1:])
            if last is not None:
                product += last * own[0]
            last = own[-1]
        out[:DIMENSIONS] = total / len(rows)
        out[DIMENSIONS:-1] = product / max(1, len(rows) - 1) * DIMENSIONS
        out[-1] = np.log1p(len(rows))
    return out


@dataclass
class Network:
    """tanh layer, then a logit divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the log loss over four fifths of the rows; the temperature is the best of a grid on the last fifth."""
    draw = np.random.default_rng(seed)
    if len(x) == 0 or y.min() == y.max():  # nothing to tell apart: a constant
        share = (y.sum() + 1) / (len(y) + 2)
        flat = np.zeros(x.shape[1] if x.ndim == 2 else FEATURES)
        return Network(flat, flat + 1, np.zeros((len(flat), 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    order = draw.permutation(len(x))
    kept, fit = order[:len(x) // 5], order[len(x) // 5:]
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    z = (x - mean) / scale
    parts = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden),
             draw.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
    first, second, step = [0 * p for p in parts], [0 * p for p in parts], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        for at in np.array_split(draw.permutation(fit), max(1, len(fit) // 128)):
            h = np.tanh(z[at] @ parts[0] + parts[1])
            error = (1 / (1 + np.exp(-np.clip(h @ parts[2] + parts[3][0], -50, 50))) - y[at]) / len(at)
            back = np.outer(error, parts[2]) * (1 - h * h)
            grads = [z[at].T @ back + 1e-4 * parts[0], back.sum(axis=0), h.T @ error + 1e-4 * parts[2], error.sum(keepdims=True)]
            step += 1
            for p, m, v, g in zip(parts, first, second, grads):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net = Network(mean, scale, parts[0], parts[1], parts[2], float(parts[3][0]))
    if len(kept):
        logits, sign = net.logits(x[kept]), np.where(y[kept] > 0, 1, -1)
        net.temperature = min(np.geomspace(0.25, 8, 61), key=lambda t: np.logaddexp(0, -sign * logits / t).mean())
    return net


def sample(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id: str, text: str, label: str,
           limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the ``limit`` labelled documents that rank first; bounded by the parameter.

    Several labels of one id: the largest counts, so an id is one example.
    """
    chosen = (labels.filter(~held_out(id) & F.col(label).isNotNull() & F.col(id).isNotNull())
              .groupBy(F.col(id).alias("_id")).agg(F.max(label).alias("_label"))
              .orderBy(by_rank(F.col("_id"), SEED), "_id").limit(limit))
    met = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pooled(t, vectors).astype("<f4").tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], names=["id", "label", "x"])

    kind = docs.schema[id].dataType.simpleString()
    rows = met.select("_id", "_text", F.col("_label").cast("int").alias("_label")).mapInArrow(run, f"id {kind}, label int, x binary")
    rows = sorted({(r.id, r.label, bytes(r.x)) for r in rows.orderBy(by_rank(F.col("id"), SEED), "id", "x").limit(limit).collect()})
    x = np.array([np.frombuffer(r[2], "<f4") for r in rows], float).reshape(len(rows), FEATURES)
    return x, np.array([r[1] for r in rows], float)


def score(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
          sample_docs: int = SAMPLE_DOCS, cut: float = CUT) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1), predicted (1 if score >= cut).

    Only labels outside the held-out fold are learned. Null and empty texts
    are scored like a text without tokens. Without labels of both kinds the
    score is a constant. Repeated rows and null ids give a row each; an empty
    table gives no rows.
    """
    vectors = word_vectors(docs, text)
    net = train(*sample(docs, labels, vectors, id, text, label, sample_docs))
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            x = np.array([pooled(t, vectors) for t in texts]).reshape(len(texts), FEATURES).astype("<f4").astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.probabilities(x))], names=[id, "score"])

    found = docs.select(id, text).mapInArrow(run, f"{id} {kind}, score double")
    return found.select(id, held_out(id).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


ship(__name__)
