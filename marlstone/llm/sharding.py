"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in native expressions.

The key and the number of shards alone decide the shard; there is no ring table. With one shard more, a row either
stays or moves to the new shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Multiplier of the 64-bit linear congruential generator of jump hashing, in 16-bit limbs, lowest first.
LCG = 2862933555777941757
_LIMBS = [(LCG >> (16 * i)) & 0xFFFF for i in range(4)]
#: Steps tried before the rare rest of the keys gets as many steps as there are shards.
FIRST_STEPS = 48
#: A shard is numbered in parts of about this many different rows, so that no task holds a whole shard.
PART_ROWS = 100_000
#: Copies of a row that are numbered from one array.
COPIES = 1 << 16


def _lcg(k: Column) -> Column:
    """k * LCG + 1 modulo 2^64 by 16-bit limbs: no step exceeds 2^63, so it also holds where overflow is an error."""
    a = [F.shiftrightunsigned(k, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    carry, out = F.lit(1).cast("long"), None
    for i in range(4):
        total = carry
        for j in range(i + 1):
            total = total + a[j] * F.lit(_LIMBS[i - j])
        limb = F.shiftleft(total.bitwiseAND(F.lit(0xFFFF)), 16 * i)
        out = limb if out is None else out.bitwiseOR(limb)
        carry = F.shiftrightunsigned(total, 16)
    return out


def _walk(state: Column, shards: int, steps: int) -> Column:
    def step(s: Column, _: Column) -> Column:
        k = _lcg(s["k"])
        jump = ((s["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(k, 33) + 1).cast("double"))).cast("long")
        return F.when(s["j"] < shards, F.struct(s["j"].alias("b"), jump.alias("j"), k.alias("k"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (int, 0 to shards - 1) of a bigint key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), F.coalesce(key.cast("long"), F.lit(0)).cast("long").alias("k"))
    state = _walk(start, shards, min(shards, FIRST_STEPS))
    if shards > FIRST_STEPS:  # a jump raises j by one at least, so as many steps as shards are enough for every key
        state = F.transform(F.array(state), lambda s: F.when(s["j"] < shards, _walk(s, shards, shards)).otherwise(s))[0]
    return state["b"].cast("int")


def stable_key(*columns: Column) -> Column:
    """A bigint key from columns that aren't one bigint."""
    return F.xxhash64(*columns)


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """One row per row of docs: key, size, text_crc32, law, shard, slot, grown_shard.

    size: bytes of the text (null: none) plus overhead. slot: gapless from 0 in each shard, in the order of the MD5
    of key, size and checksum. Equal rows are counted before they are numbered and expanded after, and a shard is
    numbered in parts, ranges of that order, whose number grows with the rows: neither a repeated key (a null one
    with many texts, say) nor keys of a pattern nor a large shard meet in one task. A null key goes where key 0 goes.
    Null text has checksum 0, as the empty text. No rows: no rows. Other columns of docs are ignored, whatever their
    names.
    """
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(bytearray()))
    rows = docs.select(F.col(key).cast("long").alias("key"), (F.length(raw).cast("long") + overhead).alias("size"), F.crc32(raw).alias("crc"))
    rows = stored(rows.groupBy("key", "size", "crc").agg(F.count(F.lit(1)).alias("n")), "keyed")
    digits = max(0, math.ceil(math.log(max(1, rows.count() / shards / PART_ROWS), 16)))
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("")), "size", "crc"))
    rows = rows.select("*", jump_hash(F.col("key"), shards).alias("shard"), jump_hash(F.col("key"), shards + 1).alias("grown"), order.alias("order"))
    rows = rows.withColumn("part", F.substring("order", 1, digits))
    parts = rows.groupBy("shard", "part").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("shard", "part", before.alias("first"))
    own = Window.partitionBy("shard", "part").orderBy("order", "key", "size", "crc").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("last", F.sum("n").over(own)).join(parts, ["shard", "part"])
    begin, end = F.col("first") + F.col("last") - F.col("n"), F.col("first") + F.col("last") - 1
    rows = rows.select("key", "size", "crc", "shard", "grown", end.alias("end"), F.explode(F.sequence(begin, end, F.lit(COPIES).cast("long"))).alias("at"))
    slots = F.explode(F.sequence(F.col("at"), F.least(F.col("at") + (COPIES - 1), F.col("end"))))
    return rows.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", slots.alias("slot"), F.col("grown").alias("grown_shard"))
