"""Packing of tokenized documents into sequences by bounded-space online best-fit.

A document is its ids and one end id. Documents of more than ``capacity`` ids are cut into pieces of
``capacity`` ids; what is left over is the first piece. Pieces are dealt by a hash into packers. A packer
takes its pieces as a stream and holds at most ``open_bins`` open bins; their free space is a bit set, so
the bin that fits best is the lowest set bit at or above the length of the piece. When one bin too many is
open, the fullest is closed. A piece gets its place when it arrives, so a packer never holds its pieces,
and its memory is bounded by the open bins whatever it is dealt.

Pieces arrive in the order of their ids, not of their lengths, and a packer is dealt 64 times as many pieces as it may
hold bins, so the bound and the closing rule decide. The hash takes the row's place in the stored table in: equal rows,
and rows without an id, are spread over all packers.

Defined cases: a NULL or empty text is the end id alone; repeated rows are packed each; a NULL id is kept.
Columns beyond id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import settle, slices
from .subwords import encoder

CAPACITY, END, OPEN_BINS = 1024, 2, 1024
PIECES_PER_PACKER = 64 * OPEN_BINS
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(ids: bytes, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document, in ids."""
    n = len(ids) // 4
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _piece_rows(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(path).encode, end.to_bytes(4, "little")
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = encode(text or "") + tail
                for number, (start, length) in enumerate(cut(ids, capacity)):
                    own = ids[4 * start:4 * (start + length)]
                    rows.append((doc_id, number, start, length, zlib.crc32(own)) + ((memoryview(own).cast("I").tolist(),) if with_ids else ()))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")[:6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))
    return run


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Every document as pieces of at most ``capacity`` ids; ``with_ids`` adds the ids themselves."""
    columns = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(_piece_rows(path, capacity, end, with_ids), _PIECES + (", ids array<int>" if with_ids else ""))


class Packer:
    """Open bins of one packer."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free_bits, self.by_free, self.opened, self.open, self.closed = 0, [[] for _ in range(capacity + 1)], 0, 0, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """``(bin, offset)`` for a piece."""
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.free_bits |= 1 << left
            self.open += 1
            if self.open > self.open_bins:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
                self.closed += 1
        return number, self.capacity - free


def _pack(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, packer = None, None
        for batch in batches:
            sequences, offsets = [], []
            for group, length in zip(batch.column("packer").to_pylist(), batch.column("length").to_pylist()):
                if group != current:
                    current, packer = group, Packer(capacity, open_bins)
                number, offset = packer.place(length)
                sequences.append((group << 40) + number)
                offsets.append(offset)
            kept = [n for n in batch.schema.names if n != "packer"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
                                             [*kept, "sequence_id", "offset"])
    return run


def pack(cut_documents: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. ``cut_documents`` is read twice and by the place of its rows, so it must be a stored table."""
    packers = -(-max(1, cut_documents.count()) // pieces_per_packer)
    dealt = cut_documents.withColumn("packer", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(packers)))
    streams = dealt.repartition("packer").sortWithinPartitions("packer", "doc_id", "piece", "ids_crc32")
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_documents.schema)
    return streams.mapInArrow(_pack(capacity, open_bins), plain + ", sequence_id long, offset long")


def pack_documents(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, open_bins: int = OPEN_BINS,
                   pieces_per_packer: int = PIECES_PER_PACKER, with_ids: bool = False) -> DataFrame:
    """One row per piece: its ids' checksum (and the ids, if asked for), its sequence and its place there."""
    return pack(settle(pieces(documents, path, capacity, end, with_ids), "pieces"), capacity, open_bins, pieces_per_packer)
