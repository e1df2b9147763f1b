"""Importance resampling of documents towards a target text collection, by hashed word n-grams.

Every run of ``low`` to ``high`` consecutive words is a feature, and its bucket is the CRC-32 of its bytes
modulo ``buckets``. Documents and target are counted per bucket; the smoothed log ratio of the two counts is
the gain of a bucket, the floored mean gain of a document's features its weight. A Gumbel draw that the seed
and the id decide is added to the weight, and the documents with the highest sums are drawn: a sample
without replacement in proportion to ``exp(weight / 1000)``.

The checksums come from a position table. A CRC is linear over bits, so a byte contributes a value that only
the byte and its distance from the end of its feature decide, and the feature's CRC is the XOR of these
contributions and a constant of its length. All features of a batch are hashed with one gather from the table
and one ``bitwise_xor.reduceat`` over their spans; a span longer than the table is cut into blocks, whose
values are folded by shifting the ones before over the width of a block.

What crosses the network: at most ``buckets`` sums per task; the count per score, which is an integer
between the least and the largest weight plus draw; and, for the ranks, only the drawn rows and those that
tie with the last of them. Ranks come from range partitions that are numbered on their own, and whose
sizes are added up, so no task sorts them all.

Defined cases: a NULL or empty text has no feature, weight 0 and is never drawn. Equal scores are ordered by
the smaller id, then rows without id (their draw is that of the text ``<seed>:``), then by a checksum of the text.
Repeated rows are documents each. Without documents or without target the gains follow from the formula with
counts of 0. Columns beyond id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import settle, slices

#: Fixed value: the reversed polynomial of the CRC-32 of zlib.
POLYNOMIAL = 0xEDB88320
#: Distances from the end that the position table holds, and bytes that are gathered at a time.
SPAN, GATHER = 256, 1 << 22
#: Rows that one task puts in order for the ranks.
ROWS_PER_PART = 250_000
_ONES = np.uint32(0xFFFFFFFF)


def position_table(span: int = SPAN) -> np.ndarray:
    """``table[d, b]``: what byte ``b`` with ``d`` bytes after it contributes to a CRC."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ np.where(one & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    table = np.empty((span, 256), np.uint32)
    table[0] = one
    for d in range(1, span):
        table[d] = (table[d - 1] >> np.uint32(8)) ^ one[table[d - 1] & np.uint32(255)]
    return table


class PositionCrc:
    """CRC-32 of many spans of one byte array."""

    def __init__(self, span: int = SPAN):
        self.span = span
        self.table = position_table(span)
        self.of_zeros = np.array([zlib.crc32(bytes(n)) for n in range(span + 1)], np.uint32)

    def _linear(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """XOR of the contributions of each (not empty) span of at most ``span`` bytes."""
        out = np.empty(len(starts), np.uint32)
        lengths = ends - starts
        total = np.cumsum(lengths)
        low = 0
        while low < len(starts):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + GATHER, "right")))
            size = lengths[low:high]
            first = np.cumsum(size) - size
            at = np.arange(int(size.sum())) + np.repeat(starts[low:high] - first, size)
            after = np.repeat(ends[low:high] - 1, size) - at
            out[low:high] = np.bitwise_xor.reduceat(self.table.ravel()[after * 256 + data[at]], first)
            low = high
        return out

    def _shift(self, register: np.ndarray) -> np.ndarray:
        """The register after ``span`` zero bytes: its own bytes act like four bytes of input."""
        out = np.zeros_like(register)
        for k in range(4):
            out ^= self.table[self.span - 1 - k][(register >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = ends - starts
        out = np.zeros(len(starts), np.uint32)
        short = np.flatnonzero((lengths > 0) & (lengths <= self.span))
        out[short] = self._linear(data, starts[short], ends[short]) ^ self.of_zeros[lengths[short]]
        long = np.flatnonzero(lengths > self.span)
        if len(long):
            # blocks are counted from the end, so only the first one may be shorter
            blocks = -(-lengths[long] // self.span)
            owner = np.repeat(np.arange(len(long)), blocks)
            first = np.cumsum(blocks) - blocks
            left = blocks[owner] - 1 - (np.arange(len(owner)) - first[owner])
            stop = ends[long][owner] - left * self.span
            values = self._linear(data, np.maximum(starts[long][owner], stop - self.span), stop)
            register = values[first] ^ self.of_zeros[lengths[long] - (blocks - 1) * self.span] ^ _ONES
            for k in range(1, int(blocks.max())):
                on = np.flatnonzero(blocks > k)
                register[on] = self._shift(register[on]) ^ values[first[on] + k]
            out[long] = register ^ _ONES
        return out


_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lowered bytes of all texts and the offsets of each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return _LOWERED[data], offsets - offsets[0]


class Features:
    """Words and n-gram buckets of a batch of texts."""

    def __init__(self, low: int, high: int, buckets: int):
        self.low, self.high, self.buckets, self.crc = low, high, buckets, PositionCrc()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words per text, and per feature its text and its bucket, by text."""
        data, offsets = _bytes_of(texts)
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = _IN_WORD[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside[:-1]
        before[offsets] = False  # a word ends with its text
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        owner = np.searchsorted(offsets, starts, "right") - 1
        words = np.bincount(owner, minlength=len(texts))
        if self.high > 1:
            data, starts, ends = self._joined(data, starts, ends)
        owners, buckets = [], []
        for n in range(self.low, self.high + 1):
            first = np.flatnonzero(owner[:len(owner) - n + 1] == owner[n - 1:]) if len(owner) >= n else np.zeros(0, np.int64)
            owners.append(owner[first])
            buckets.append(self.crc(data, starts[first], ends[first + n - 1]).astype(np.int64) % self.buckets)
        return words, np.concatenate(owners), np.concatenate(buckets)

    @staticmethod
    def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """The words alone, one space after each, so that consecutive words are one span."""
        size = ends - starts
        first = np.cumsum(size + 1) - (size + 1)
        out = np.full(int((size + 1).sum()), 32, np.uint8)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[at + np.repeat(first, size)] = data[at + np.repeat(starts, size)]
        return out, first, first + size


def bucket_counts(texts: DataFrame, low: int, high: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs; at most ``buckets`` numbers leave a task and reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, found = Features(low, high, buckets), np.zeros(buckets, np.int64)
        for part in slices(batches):
            found += np.bincount(features(part.column(0))[2], minlength=buckets)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored smoothed log ratio of target to documents per bucket, in thousandths."""
    size, s, t = len(documents), int(documents.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((b + 1) * (s + size)) / float((a + 1) * (t + size))))
                     for a, b in zip(documents.tolist(), target.tolist())], np.int64)


def gumbel(seed: int, doc_id: int | None) -> int:
    """The draw of a document in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id long, n_words long, n_features long, weight long, score long, tie long"


def scored(documents: DataFrame, target: DataFrame, low: int, high: int, buckets: int, seed: int) -> DataFrame:
    """Weight and score of every document; ``tie`` is a checksum of the text."""
    gain = gains(bucket_counts(documents, low, high, buckets), bucket_counts(target, low, high, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(low, high, buckets)
        for part in slices(batches):
            words, owner, bucket = features(part.column(1))
            n = np.bincount(owner, minlength=len(words)).astype(np.int64)
            total = np.zeros(len(words), np.int64)
            np.add.at(total, owner, gain[bucket])
            weight = total // np.maximum(n, 1)
            draw = np.array([gumbel(seed, i) for i in part.column(0).to_pylist()], np.int64)
            tie = [0 if t is None else zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words.astype(np.int64)), pa.array(n), pa.array(weight), pa.array(weight + draw), pa.array(tie, pa.int64())],
                ["doc_id", "n_words", "n_features", "weight", "score", "tie"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, _SCORED)


def ranked(rows: DataFrame, take: int) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... in order of score, id and text, for the first ``take``; NULL beyond."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie"), F.asc("_salt")]
    parts = max(1, -(-rows.count() // ROWS_PER_PART))
    # equal rows are told apart by their place in the stored table, so no number of them has to meet in one part
    placed = (rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("_place", F.monotonically_increasing_id()).drop("_salt"))
    placed = settle(placed, "resampling-placed").withColumn("_part", F.shiftright("_place", 33))
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    # one row per part
    starts = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", F.when(rank <= take, rank)).drop("_place", "_part", "_before")


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, low: int = 1, high: int = 1, buckets: int = 10_000, seed: int = 2024,
             least_words: int = 20) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every document: ``percent`` in a hundred of those with ``least_words`` are drawn and have a rank."""
    rows = settle(scored(documents, target, low, high, buckets, seed), "resampling-scored")
    fit = F.col("n_words") >= least_words
    # one row per score: an integer of bounded range, however many documents there are
    counts = sorted(((r["score"], r["n"]) for r in rows.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    take = percent * sum(n for _, n in counts) // 100
    level, above = None, 0
    for score, n in counts:
        if above >= take:
            break
        level, above = score, above + n
    if level is None:
        return rows.select(*_names(rows), F.lit(None).cast("long").alias("rank"))
    near = fit & (F.col("score") >= level)
    drawn = ranked(rows.where(near), take)
    rest = rows.where(~near).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(*_names(rows), "rank")


def _names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c != "tie"]
