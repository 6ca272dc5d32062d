"""Best-fit packing of token sequences, hierarchically.

1. Documents are tokenised where they are read; only pieces (id, length,
   checksum) go on.  A document longer than a sequence is cut into full
   pieces and a last shorter one; each full piece is a sequence of its own.
2. Each partition packs its pieces best-fit, the longest first, into bins.
   Nearly full bins are done.
3. Underfull bins become items.  Rounds of a tree merge the items of several
   partitions into one and pack them again best-fit; nearly full results
   are done, the others go up.  A task packs about ``block`` items, whatever
   the size of the table, so the tree ends with one task or with several of
   that size.
4. The bins' ways up the tree are joined, and each piece gets its sequence
   and its offset.

Results of a round are written to the shared folder before the next one
reads them, so a recomputed task can't tear a bin apart.

A null or empty text has just the end id.  An empty table gives no pieces.
Repeated rows and ids are pieces like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship_package
from .word_ids import encoder

CAPACITY = 4096
END_ID = 1
#: A bin with less than this share of free room is done.
SLACK = 0.01
#: Items that one task of the tree packs, about.
BLOCK = 100_000
#: Partitions that one node of the tree merges.
FAN_IN = 8

_BINS_OF_A_TASK = 1 << 31


class BestFit:
    """Bins of a capacity; an item goes into the bin with the least room that
    still holds it.

    A bit of a large integer says for each room if an open bin has just that
    room, so finding the bin takes no search.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.fill: list[int] = []
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0

    def put(self, size: int) -> tuple[int, int]:
        """The bin of an item and its offset there."""
        fitting = self.rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = self.open[room].pop()
            if not self.open[room]:
                self.rooms ^= 1 << room
        else:
            room, at = self.capacity, len(self.fill)
            self.fill.append(0)
        offset = self.fill[at]
        self.fill[at] += size
        if room > size:
            left = self.open[room - size]
            if not left:
                self.rooms |= 1 << (room - size)
            left.append(at)
        return at, offset


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: bin and offset of every item, fill of every bin."""
    bins = BestFit(capacity)
    at, offset = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at[i], offset[i] = bins.put(sizes[i])
    return at, offset, bins.fill


def _cut_up(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, checksum) of each piece."""
    for start in range(0, len(ids), 4 * capacity):
        part = ids[start:start + 4 * capacity]
        yield start // 4, len(part) // 4, zlib.crc32(part)


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill int"


def _tokenise_and_pack(path: str, capacity: int, end_id: int, block: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        base = TaskContext.get().partitionId() * _BINS_OF_A_TASK
        rows: list[tuple] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base, rows
            if not rows:
                return
            at, offset, fill = best_fit([r[3] for r in rows], capacity)
            cols = list(zip(*rows))
            cols += [[base + b for b in at], offset, [fill[b] for b in at]]
            base, rows = base + len(fill), []
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "fill"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            for doc, text in zip(ids, texts):
                rows += [(doc, k, *p) for k, p in enumerate(_cut_up(encode(text.as_py()) + end, capacity))]
            if len(rows) >= block:
                yield from packed()
        yield from packed()

    return run


_ITEM = "bin long, parent long, shift long, fill int"


def _pack_items(capacity: int, number: int):
    """Packs the underfull bins of a task; ``number`` is that of the round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sorted((b, f) for batch in batches for b, f in zip(*(c.to_pylist() for c in batch.columns)))
        if not items:
            return
        base = -1 - TaskContext.get().partitionId() * _BINS_OF_A_TASK - (number << 56)
        at, offset, fill = best_fit([f for _, f in items], capacity)
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in items], pa.int64()), pa.array([base - b for b in at], pa.int64()),
             pa.array(offset, pa.int64()), pa.array([fill[b] for b in at], pa.int32())],
            names=["bin", "parent", "shift", "fill"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, slack: float = SLACK, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = cut(rows.mapInArrow(_tokenise_and_pack(tokenizer_path, capacity, end_id, block), _PLACED), "placed")
    room = int(capacity * slack)
    level = (placed.filter(F.col("fill") < capacity - room).groupBy("bin").agg(F.max("fill").alias("fill")))
    count = level.count()
    ways: DataFrame | None = None
    parts = max(1, -(-count // max(1, block // fan_in)))
    number = 0
    while count > 1:
        number += 1
        merged = cut(level.repartition(parts, "bin").select("bin", "fill").mapInArrow(
            _pack_items(capacity, number), _ITEM), f"round{number}")
        step = merged.select("bin", F.col("parent"), F.col("shift"))
        ways = step if ways is None else (
            ways.join(step.select(F.col("bin").alias("parent"), F.col("parent").alias("_up"), F.col("shift").alias("_more")),
                      "parent", "left")
            .select("bin", F.coalesce("_up", "parent").alias("parent"),
                    (F.col("shift") + F.coalesce("_more", F.lit(0))).alias("shift")))
        level = (merged.filter(F.col("fill") < capacity - room).groupBy(F.col("parent").alias("bin"))
                 .agg(F.max("fill").alias("fill")))
        left = level.count()
        if parts == 1 or left > 0.99 * count:
            break
        count, parts = left, max(1, min(parts // fan_in, -(-left // block)))
    if ways is None:
        return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                             F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    return (placed.join(ways, "bin", "left")
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    F.coalesce("parent", "bin").alias("sequence_id"),
                    (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset")))
