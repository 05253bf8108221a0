"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to the smallest context tier (256, 512, 1024, 2048 ids)
that holds what is left of them after whole long windows are cut off. Each tier
is packed; what a long window lacks is filled from the shorter tiers, whole
documents first, the last one cut to measure. So a sequence is exactly full at
its tier's size, a power of two. Every task packs its own rows in one pass and
keeps at most one open window per tier between batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchwork.llm.bpe import RANKS, VOCABULARY, encoder
from stitchwork.llm.common import ship, texts_of

TIERS = (256, 512, 1024, 2048)
#: Id that ends each document.
END_ID = 1
#: Ids of a training step: each step group holds sequences of one tier, as many as make this.
STEP_IDS = 16_384


class Packer:
    """Packs the documents of one task. A piece is (document number, start, length)."""

    def __init__(self, tiers: tuple[int, ...], first_id: int, step_ids: int):
        self.tiers, self.next_id, self.step_ids = tiers, first_id, step_ids
        self.waiting = [deque() for _ in tiers]
        self.steps = {}
        self.next_step = first_id

    def _tier_of(self, length: int) -> int:
        return next(i for i, size in enumerate(self.tiers) if length <= size)

    def add(self, doc: int, length: int) -> Iterator[tuple]:
        """Whole long windows leave at once; the rest waits in its tier."""
        longest = self.tiers[-1]
        whole = length - length % longest
        for start in range(0, whole, longest):
            yield from self._sequence([(doc, start, longest)], longest)
        if length > whole:
            self.waiting[self._tier_of(length - whole)].append((doc, whole, length - whole))

    def _fill(self, gap: int, top: int) -> list[tuple]:
        """Pieces from tiers up to ``top`` that make exactly ``gap`` ids, or all there is."""
        taken = []
        while gap:
            fits = next((i for i in range(top, -1, -1) if self.waiting[i] and self.waiting[i][0][2] <= gap), None)
            if fits is not None:
                taken.append(self.waiting[fits].popleft())
                gap -= taken[-1][2]
                continue
            larger = next((i for i in range(top + 1) if self.waiting[i]), None)
            if larger is None:
                break
            doc, start, length = self.waiting[larger].popleft()
            taken.append((doc, start, gap))
            rest = (doc, start + gap, length - gap)
            self.waiting[self._tier_of(rest[2])].appendleft(rest)
            gap = 0
        return taken

    def pack(self) -> Iterator[tuple]:
        """Full sequences of every tier, longest first. What fills none keeps waiting."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[tier]
            while self.waiting[tier]:
                first = self.waiting[tier].popleft()
                pieces = [first, *self._fill(size - first[2], tier)]
                if sum(p[2] for p in pieces) < size:
                    for piece in reversed(pieces):
                        self.waiting[self._tier_of(piece[2])].appendleft(piece)
                    break
                yield from self._sequence(pieces, size)

    def close(self) -> Iterator[tuple]:
        """What is left at the end of the task, as sequences of falling powers of two: none is padded."""
        left = sum(p[2] for queue in self.waiting for p in queue)
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            yield from self._sequence(self._fill(size, len(self.tiers) - 1), size)
            left -= size

    def _sequence(self, pieces: list[tuple], size: int) -> Iterator[tuple]:
        number, self.next_id = self.next_id, self.next_id + 1
        step, room = self.steps.get(size, (0, 0))
        if room < size:
            step, room = self.next_step, self.step_ids
            self.next_step += 1
        self.steps[size] = (step, room - size)
        offset = 0
        for doc, start, length in pieces:
            yield doc, start, length, number, offset, size, step
            offset += length


SCHEMA = ("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, "
          "step_group long")


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS,
         end_id: int = END_ID, step_ids: int = STEP_IDS, vocabulary: str = VOCABULARY,
         ranks: str = RANKS) -> DataFrame:
    """One row per piece: id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset,
    tier (the sequence's size, a power of two), step_group.

    A document is its ids and ``end_id``. Null or empty text is the end id
    alone. Every row is packed on its own, so repeated rows and ids, and null
    ids, give pieces each. An empty table gives no rows. Sequence numbers start
    at the task's number times 2^33: a task that runs again gives the same.
    The rows a task is dealt must be in a fixed order (a table scan is).
    """
    kind = docs.schema[id].dataType.simpleString()
    if any(size & (size - 1) for size in tiers) or list(tiers) != sorted(tiers) or step_ids % tiers[-1]:
        raise ValueError("tiers are rising powers of two, step_ids a multiple of the last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary, ranks), end_id.to_bytes(4, "little")
        packer = Packer(tiers, TaskContext.get().partitionId() << 33, step_ids)
        open_docs: dict[int, tuple] = {}
        count = 0

        def rows(pieces) -> pa.RecordBatch:
            columns = [[] for _ in range(9)]
            for doc, start, length, number, offset, size, step in pieces:
                key, ids = open_docs[doc]
                for column, value in zip(columns, (key, start, length, ids[4 * start:4 * (start + length)],
                                                   len(ids) // 4, number, offset, size, step)):
                    column.append(value)
            arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        names, types = None, None
        for batch in batches:
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(),
                     pa.int64(), pa.int32(), pa.int64()]
            names = [id, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            pieces = []
            for key, value in zip(batch.column(0).to_pylist(), texts_of(batch)):
                ids = encode(value) + end
                open_docs[count] = (key, ids)
                pieces += packer.add(count, len(ids) // 4)
                count += 1
            pieces += packer.pack()
            yield rows(pieces)
            still = {piece[0] for queue in packer.waiting for piece in queue}
            open_docs = {doc: open_docs[doc] for doc in still}
        if names:
            yield rows(packer.close())

    return docs.select(id, text).mapInArrow(run, f"{id} {kind}, {SCHEMA}")


def digest(packed: DataFrame, id: str = "doc_id") -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""
    return packed.select(id, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "tier", "step_group")


ship(__name__)
