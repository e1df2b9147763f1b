"""Quality rules by compression bands.

Base rules count words, symbols, repeated lines and repeated 3-word windows of the whole text. The verdict
of the method comes from zstandard: the ratio of compressed to raw bytes of the whole document and of each
fixed chunk. Text that repeats itself compresses far too well, random characters hardly compress at all,
so each length of document has a band of ratios that prose keeps to. A document is rejected when its own
ratio leaves the band of its length, or when chunks outside the chunk band hold more than a share of its
bytes (which finds a junk half in an otherwise sound document).

Defined cases: a NULL or empty text has no words and fails the base rules; its ratio is NULL. A repeated
row is judged again, with the same result. Columns beyond the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import SPACE, byte_words, slices

SYMBOLS = "#*$%&|<>"


class Band(NamedTuple):
    """Documents of fewer than ``below`` bytes keep a ratio between ``low`` and ``high``."""

    below: float
    low: float
    high: float


#: Short texts carry the frame of the format, hence the high limits there; long prose settles near 0.4.
BANDS = (Band(256, 0.35, 1.30), Band(512, 0.28, 1.00), Band(2048, 0.24, 0.80), Band(16384, 0.20, 0.70),
         Band(float("inf"), 0.15, 0.65))
CHUNK_BYTES, CHUNK_BAND, CHUNK_SHARE, LEVEL = 4096, Band(float("inf"), 0.15, 0.72), 0.3, 3
MIN_WORDS, REPEAT_PERCENT = 50, 50


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, the first finding included."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(numbers) + ids[2:]
    order = np.sort(windows)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(windows, np.unique(again)))
    covered = np.zeros(len(words), bool)
    for step in range(3):
        covered[at + step] = True
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def ratios(data: bytes, chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> tuple[float, list[tuple[int, float]]]:
    """The ratio of the whole document, and ``(bytes, ratio)`` of its fixed chunks."""
    squeeze = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False).compress
    whole = len(squeeze(data)) / len(data)
    pieces = [data[i:i + chunk_bytes] for i in range(0, len(data), chunk_bytes)]
    if len(pieces) == 1:
        return whole, [(len(data), whole)]
    if len(pieces[-1]) < chunk_bytes // 4:
        pieces[-2:] = [pieces[-2] + pieces[-1]]
    return whole, [(len(p), len(squeeze(p)) / len(p)) for p in pieces]


def verdict(data: bytes, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_band: Band = CHUNK_BAND,
            chunk_share: float = CHUNK_SHARE, level: int = LEVEL) -> tuple[bool, float | None, float]:
    """``(within all limits, ratio, share of bytes in odd chunks)`` of one document."""
    if not data:
        return False, None, 0.0
    whole, chunks = ratios(data, chunk_bytes, level)
    band = next(b for b in bands if len(data) < b.below)
    odd = 0.0
    if len(chunks) > 1:
        odd = sum(n for n, r in chunks if not chunk_band.low <= r <= chunk_band.high) / len(data)
    return band.low <= whole <= band.high and odd <= chunk_share, whole, odd


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                     ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
                     ("kept", pa.bool_()), ("zstd_ratio", pa.float64()), ("odd_chunk_share", pa.float64())])


def judge(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    words = byte_words(text)
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * len(words)
    fine, whole, odd = verdict(text.encode("utf-8", "surrogatepass"))
    return (doc_id, len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), repeated_lines(text),
            repeat, failed, not failed and fine, whole, odd)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = [judge(d, t) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def quality(documents: DataFrame) -> DataFrame:
    """Counts, base verdict and compression verdict of every document."""
    columns = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(_judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                              "n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, odd_chunk_share double")
