"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

#: Words are runs of anything but the six ASCII white-space characters.
SPACE = "\x20\t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER_BYTES = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def lower_words(text: str | None) -> list[str]:
    """Words with A-Z lowered."""
    if not text:
        return []
    text = text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).decode("utf-8", "surrogatepass")
    return WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def byte_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words as UTF-8 bytes: ``bytes.split`` knows exactly the six ASCII white-space characters."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.translate(_LOWER_BYTES) if lower else data).split()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short pieces of the batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class Recent(dict):
    """Values by key that are dear to work out, at most ``entries``. When the newer half is full it becomes the older one, whose values
    are dropped unless they are asked for meanwhile."""

    def __init__(self, entries: int):
        super().__init__()
        self.half, self.older = max(1, entries // 2), {}

    def keep(self, key, value):
        if len(self) >= self.half:
            self.older = dict(self)
            super().clear()
        self[key] = value
        return value

    def again(self, key):
        """The value of a key that is not among the newer ones, or None."""
        found = self.older.pop(key, None)
        return None if found is None else self.keep(key, found)

    def clear(self) -> None:
        super().clear()
        self.older = {}


_owned: dict[str, list[dict]] = {}
_owner = [""]


def owned(owner: str, cache: dict) -> dict:
    """Register a cache of this worker process."""
    _owned.setdefault(owner, []).append(cache)
    return cache


def working_for(owner: str) -> None:
    """Workers serve one stage after another; the caches of all owners but this one are given back."""
    if _owner[0] == owner:
        return
    _owner[0] = owner
    others = [c for name, caches in _owned.items() if name != owner for c in caches if c or getattr(c, "older", None)]
    for cache in others:
        cache.clear()
    if others:
        gc.collect()
        with suppress(OSError, AttributeError):  # only where the C library can give memory back
            ctypes.CDLL(None).malloc_trim(0)


def settle(frame: DataFrame, label: str, used: list | None = None) -> DataFrame:
    """Write a working table below ``spark.checkpoint.dir`` and read it back: lineage ends here.

    ``used`` collects tables that ``discard`` may empty later.
    """
    spark: SparkSession = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    if used is not None:
        used.append((path, found))
    return found


def discard(used: list) -> None:
    """Empty working tables that nothing reads any more, once what came from them is stored itself."""
    for path, found in used:
        found.sparkSession.createDataFrame([], found.schema).coalesce(1).write.mode("overwrite").parquet(path)
    used.clear()


#: Blocks of a grid that one task takes in turn, at most on average, and blocks that it holds to meet them.
TAKEN, HELD = 8, 32


def grid(taken: DataFrame, held: DataFrame, key: Column) -> DataFrame:
    """Every block of ``taken`` with every block of ``held``; a task meets one block of ``taken`` after the other with the same blocks of ``held``.

    Both are dealt out once and read by each task that needs them. A join on repeated blocks would shuffle them as often as they meet, or, as
    their size before they are repeated looks small, send them all through the driver.
    """
    blocks, others = max(1, taken.count()), max(1, held.count())
    tasks = max(-(-blocks // TAKEN), min(blocks, 4 * taken.sparkSession.sparkContext.defaultParallelism))
    return taken.repartition(tasks, key).hint("shuffle_replicate_nl").crossJoin(held.repartition(-(-others // HELD)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of an id filter: its size is fixed, so it can be sent to every task whatever the number of ids.
FILTER_BITS = 23


def id_place(column: str) -> Column:
    """The bit of an id in an id filter; a NULL id counts as -1."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("long"), F.lit(-1).cast("long"))), F.lit(1 << FILTER_BITS)).cast("long")


def id_bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size over hashed ids. It passes every id of ``ids``, and others that share a bit: a
    join must follow. It only spares the shuffle of rows that the join would drop."""
    rows = ids.select(id_place(column).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for row in rows:
        bits[row["w"]] = row["b"]
    return bits


def in_bitmap(bits: np.ndarray, places: pa.Array) -> np.ndarray:
    """Positions of the rows that the bitmap passes."""
    place = places.to_numpy()
    return np.flatnonzero((bits[place >> 6] >> (place & 63)) & 1)
