"""A filter of bounded size that tells which rows may have a key, so that the others need no shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for every key, and the most bits that are sent; with more keys than that, more rows pass, and none is lost.
PER_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Bits in one part, as Spark's bitmap functions make them.
PART = 32768


def slots(n_keys: int) -> int:
    """A power of two for so many keys."""
    return min(max(1 << (max(n_keys, 1) * PER_KEY - 1).bit_length(), LEAST_BITS), MOST_BITS)


def slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """(part_, bits_): the slots of the keys, part by part."""
    at = slot(F.col(column), bits) + 1
    return keys.groupBy(F.bitmap_bucket_number(at).alias("part_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits_"))


def marked(rows: DataFrame, keys: DataFrame, column: str, name: str = "may") -> DataFrame:
    """rows with a flag: false only where the column's value is surely not in keys (a table that was written)."""
    bits = slots(keys.count())
    parts = bitmap(keys, column, bits)
    at = slot(F.col(column), bits)
    rows = rows.withColumn("slot_", at % PART).withColumn("part_", (F.floor(at / F.lit(PART)) + 1).cast("long"))
    # MOST_BITS bounds the broadcast side
    joined = rows.join(F.broadcast(parts), "part_", "left")
    byte = F.conv(F.hex(F.substring("bits_", F.floor(F.col("slot_") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("slot_ % 8").cast("int")
    flag = F.coalesce(F.getbit(byte, bit) == 1, F.lit(False))
    return joined.withColumn(name, flag).drop("slot_", "part_", "bits_")


def bitmap_bytes(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """The slots of keys that are hashes already, for use in workers: at most MOST_BITS bits."""
    at = F.pmod(F.col(column), F.lit(bits)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts.toLocalIterator():
        found = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        out[(r["part"] - 1) * (PART // 8) :][: len(found)] = found
    return out


def passing(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes have their slot set."""
    at = keys & (bits - 1)
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
