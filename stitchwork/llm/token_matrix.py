"""Token-id output: best-fit-decreasing packing into fixed rows of ids.

Documents longer than a row are split without loss: whole rows first, the rest
packed like a short document. A segment tree over the capacities 0..row length
finds, in a dozen steps, the open row with the least room that still suffices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchwork.llm.bpe import RANKS, VOCABULARY, encoder
from stitchwork.llm.common import ship, texts_of

ROW_IDS = 2048
#: The vocabulary's end-of-text id closes each document and pads rows.
END_ID = 50_256


class Capacities:
    """Segment tree: how many open rows have each capacity, and the smallest capacity not below a wish."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def least(self, wish: int) -> int | None:
        node = self.leaves + wish
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Numbers of the items in each row. Ties go to the earlier item and the row opened last."""
    tree, rows, by_capacity = Capacities(size), [], {}
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[item])
        if room is None:
            row, room = len(rows), size
            rows.append([])
        else:
            row = by_capacity[room].pop()
            tree.change(room, -1)
        rows[row].append(item)
        room -= lengths[item]
        by_capacity.setdefault(room, []).append(row)
        tree.change(room, 1)
    return rows


SCHEMA = ("row_id long, input_ids binary, n_ids int, cu_seqlens array<int>, position_resets array<int>, "
          "doc_ids array<{kind}>, doc_starts array<long>")


def matrices(docs: DataFrame, id: str = "doc_id", text: str = "text", row_ids: int = ROW_IDS, end_id: int = END_ID,
             vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """One row per packed row of ids.

    input_ids: row_ids unsigned 16-bit ids, little-endian, padded with end_id
    after the first n_ids; cu_seqlens: 0 and the end of each segment;
    position_resets: where position ids start at 0 again (a padded tail counts
    as one more); doc_ids and doc_starts: each segment's document and how many
    of its ids came before. Concatenating a document's segments by doc_starts
    gives its ids, which end with end_id. Null and empty texts are the end id
    alone; repeated rows and null ids are packed row by row; an empty table
    gives no rows. Packing is over one Arrow batch of a task at a time, which
    bounds memory.
    """
    kind = docs.schema[id].dataType.simpleString()
    schema = SCHEMA.format(kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(vocabulary, ranks), TaskContext.get().partitionId() << 33
        for batch in batches:
            keys = batch.column(0).to_pylist()
            ids = [np.append(np.frombuffer(encode(x), "<u4"), end_id).astype("<u2") for x in texts_of(batch)]
            pieces, rows = [], []
            for doc, own in enumerate(ids):
                whole = len(own) - len(own) % row_ids
                rows += [[(doc, start, start + row_ids)] for start in range(0, whole, row_ids)]
                if len(own) > whole:
                    pieces.append((doc, whole, len(own)))
            fitted = best_fit_decreasing([end - start for _, start, end in pieces], row_ids)
            rows += [[pieces[i] for i in row] for row in fitted]
            for at in range(0, len(rows), 4096):
                out = rows[at:at + 4096]
                cuts = [np.cumsum([0, *(end - start for _, start, end in row)]).tolist() for row in out]
                filled = [c[-1] for c in cuts]
                matrix = np.full((len(out), row_ids), end_id, "<u2")
                for i, row in enumerate(out):
                    np.concatenate([ids[doc][start:end] for doc, start, end in row], out=matrix[i, :filled[i]])
                arrays = [
                    pa.array(range(number, number + len(out)), pa.int64()),
                    pa.array([row.tobytes() for row in matrix], pa.binary()), pa.array(filled, pa.int32()),
                    pa.array(cuts, pa.list_(pa.int32())),
                    pa.array([c if c[-1] < row_ids else c[:-1] for c in cuts], pa.list_(pa.int32())),
                    pa.array([[keys[doc] for doc, _, _ in row] for row in out], pa.list_(batch.schema.field(0).type)),
                    pa.array([[start for _, start, _ in row] for row in out], pa.list_(pa.int64()))]
                number += len(out)
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in (
                    "row_id", "input_ids", "n_ids", "cu_seqlens", "position_resets", "doc_ids", "doc_starts")])

    return docs.select(id, text).mapInArrow(run, schema)


def position_ids(cu_seqlens: str | Column, row_ids: int = ROW_IDS) -> Column:
    """Position of every id within its segment, from the cumulative lengths; the padded tail counts from 0 too."""
    cuts = F.col(cu_seqlens) if isinstance(cu_seqlens, str) else cu_seqlens
    ends = F.when(F.element_at(cuts, -1) < row_ids, F.array_append(cuts, F.lit(row_ids))).otherwise(cuts)
    lengths = F.zip_with(F.slice(ends, 2, F.size(ends) - 1), F.slice(ends, 1, F.size(ends) - 1), lambda b, a: b - a)
    return F.flatten(F.transform(lengths, lambda n: F.sequence(F.lit(0), n - 1)))


def write_matrices(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet, one file per task, ids without dictionary encoding."""
    packed.write.mode("overwrite").option("parquet.enable.dictionary", "false").parquet(path)


ship(__name__)
