"""Harmonic packing of token sequences.

Lengths fall into classes of reciprocal capacity: the piece of class m has capacity / m tokens, and a bin of
that class holds m of them, no more and no fewer. A document is cut into whole sequences and, for its rest,
one piece of each class that its length has in binary, so a full bin has no padding. What is left below the
smallest class is filled into bins in order and cut at their ends. Every task packs its own documents; no row
is shuffled. At the end of a task open bins close as sequences of power-of-two lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import load
from .common import each_row, in_batches

CAPACITY = 2048
#: Pieces of the smallest class have capacity / SMALLEST tokens.
SMALLEST = 32
END_ID = 1
#: Sequences a task may make; its number times this is its first sequence id.
TASK_SEQUENCES = 1 << 40


class Piece(NamedTuple):
    doc_id: object
    start: int
    ids: np.ndarray
    doc_tokens: int


Bin = list[Piece]


def _cut(piece: Piece, at: int) -> tuple[Piece, Piece]:
    head, tail = piece.ids[:at], piece.ids[at:]
    return piece._replace(ids=head), piece._replace(start=piece.start + at, ids=tail)


def _powers(number: int) -> list[int]:
    """The powers of two that add up to a number, largest first."""
    return [1 << b for b in reversed(range(number.bit_length())) if number >> b & 1]


class Packer:
    """The open bins of one task: less than one bin per class is held."""

    def __init__(self, capacity: int = CAPACITY, smallest: int = SMALLEST) -> None:
        if capacity & (capacity - 1) or smallest & (smallest - 1) or not 0 < smallest <= capacity:
            raise ValueError("capacity and smallest class must be powers of two")
        self.capacity, self.smallest = capacity, smallest
        self.open: dict[int, Bin] = {1 << j: [] for j in range(smallest.bit_length())}
        self.rest: Bin = []
        self.room = capacity

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[Bin]:
        """Take a document and give out the bins it fills."""
        at, total = 0, len(ids)
        for many, held in self.open.items():
            size = self.capacity // many
            while total - at >= size:
                held.append(Piece(doc_id, at, ids[at : at + size], total))
                at += size
                if len(held) == many:
                    yield held[:]
                    held.clear()
        if at < total:
            piece = Piece(doc_id, at, ids[at:], total)
            if len(piece.ids) >= self.room:
                head, piece = _cut(piece, self.room)
                yield [*self.rest, head]
                self.rest, self.room = [], self.capacity
            if len(piece.ids):
                self.rest.append(piece)
                self.room -= len(piece.ids)

    def close(self) -> Iterator[Bin]:
        """Give out what is still open, in bins of power-of-two lengths."""
        for held in self.open.values():
            for many in _powers(len(held)):
                yield held[:many]
                del held[:many]
        for size in _powers(self.capacity - self.room):
            bin_, room = [], size
            while room:
                head, tail = _cut(self.rest[0], room)
                bin_.append(head)
                room -= len(head.ids)
                self.rest[:1] = [tail] if len(tail.ids) else []
            yield bin_


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    capacity: int = CAPACITY,
    smallest: int = SMALLEST,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for.

    Every token id of a document, the end id included, lies in one piece; a null or empty text is the end id
    alone. Repeated rows are packed as often as they occur. The pieces of a sequence lie at offsets 0 and on
    without a gap. Sequences shorter than the capacity, at most a few per task, have power-of-two lengths.
    """
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    frame = docs.select(id_col, text_col)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = [to_arrow_schema(frame.select(id_col).schema).field(0), *(pa.field(n, pa.int64()) for n in names)]
    schema = pa.schema([*fields, pa.field("ids", pa.list_(pa.int64()))] if with_ids else fields)

    def bins(batches: Iterable[pa.RecordBatch]) -> Iterator[Bin]:
        packer, bpe, end = Packer(capacity, smallest), load(tokenizer), np.array([END_ID], np.uint32)
        for doc_id, text in each_row(batches):
            yield from packer.add(doc_id, np.concatenate([bpe.encode(text), end]))
        yield from packer.close()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        first = TaskContext.get().partitionId() * TASK_SEQUENCES
        for number, pieces in enumerate(bins(batches)):
            offset = 0
            for doc_id, start, ids, total in pieces:
                ids = np.ascontiguousarray(ids, "<u4")
                row = (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, first + number, offset)
                yield (*row, ids.tolist()) if with_ids else row
                offset += len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(rows(batches), schema)

    return frame.mapInArrow(run, from_arrow_schema(schema)).withColumnRenamed(id_col, "doc_id")
