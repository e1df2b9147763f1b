"""Sharding by jump consistent hashing, with DataFrame functions only.

A key jumps from bucket to bucket; the last bucket below the number of shards is its shard. The next jump
depends on the key's own random sequence (a 64-bit linear congruential generator) alone, so a shard more
moves exactly the keys whose sequence lands in the new shard, about one in ``n + 1``, and no table of a
ring is kept. The law is ``key``: the id and the number of shards decide.

The generator needs products modulo 2^64, which ANSI arithmetic rejects as overflow; the state is therefore
held as two 32-bit halves and multiplied in 16-bit steps.

Slots: rows of a shard are dealt into ``PARTS`` parts by a hash of the id; a part is numbered on its own and
starts after the rows of the parts before it, so no task sorts a whole shard.

Defined cases: a NULL text has no bytes (size 8, crc32 0); a NULL id is the key -1; repeated rows go to the
same shard and get slots of their own. Columns beyond id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
PARTS = 1024
_LOW, _HIGH, _M32, _M16 = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32, 0xFFFFFFFF, 0xFFFF


def _and(a: Column, mask: int) -> Column:
    return a.bitwiseAND(F.lit(mask).cast("long"))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The halves of ``state * MULTIPLIER + 1`` modulo 2^64."""
    near = _and(lo, _M16) * _long(_LOW)
    far = F.shiftright(lo, 16) * _long(_LOW)
    total = near + F.shiftleft(_and(far, _M16), 16) + _long(1)
    carry = F.shiftright(total, 32) + F.shiftright(far, 16)

    def low_product(a: Column, factor: int) -> Column:
        """``a * factor`` modulo 2^32."""
        top = _and(F.shiftright(a, 16) * _long(factor & _M16), _M16)
        return _and(_and(a, _M16) * _long(factor) + F.shiftleft(top, 16), _M32)

    return _and(low_product(hi, _LOW) + low_product(lo, _HIGH) + carry, _M32), _and(total, _M32)


def jump(key: Column, shards: int) -> tuple[Column, Column]:
    """The shard of ``key`` among ``shards`` and among one more."""
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), _and(key, _M32).alias("lo"), _long(0).alias("at"), _long(0).alias("grown"),
                     _long(0).alias("next"))

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        here = s["next"]
        ahead = F.floor((here + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double")))
        going = here <= shards
        return F.struct(F.when(going, hi).otherwise(s["hi"]).alias("hi"), F.when(going, lo).otherwise(s["lo"]).alias("lo"),
                        F.when(here < shards, here).otherwise(s["at"]).alias("at"), F.when(going, here).otherwise(s["grown"]).alias("grown"),
                        F.when(going, ahead).otherwise(here).alias("next"))

    # Each jump moves on by at least one, so shards + 1 steps always suffice.
    end = F.aggregate(F.sequence(_long(0), _long(shards)), start, step)
    return end["at"].cast("int"), end["grown"].cast("int")


def shard(documents: DataFrame, shards: int = 24, parts: int = PARTS) -> DataFrame:
    """Every document with size, checksum, shard, gapless slot and the shard with one shard more."""
    key = F.coalesce(F.col("doc_id").cast("long"), _long(-1))
    dealt = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), _long(0)).alias("text_crc32"), F.lit("key").alias("law"),
        F.struct(*jump(key, shards)).alias("j"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"))
    names = dealt.schema["j"].dataType.names
    dealt = dealt.select("doc_id", "size", "text_crc32", "law", F.col("j")[names[0]].alias("shard"), "part", F.col("j")[names[1]].alias("grown_shard"))
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("rows").over(before), _long(0)).alias("start"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (dealt.join(starts, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.row_number().over(own) - 1).alias("slot"), "grown_shard"))
