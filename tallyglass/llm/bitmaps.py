"""Prefilters of fixed size: which rows may have a key of another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23


def flagged(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, flag: str) -> DataFrame:
    """df with the boolean column ``flag``: false only where no row of ``wanted`` has the row's key (a long).

    ``wanted`` becomes a bitmap of BITS bits, at most 256 rows of 4 kB, whatever its
    size, so it can be broadcast; where more keys set more bits, more rows are
    flagged in vain.
    """
    bit = lambda k: F.pmod(F.xxhash64(k), F.lit(BITS)) + 1
    bits = wanted.select(bit(wanted_key).alias("bit"))
    bitmap = bits.groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits"))
    place = F.bitmap_bit_position(bit(key))
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = df.withColumn("_bucket", F.bitmap_bucket_number(bit(key))).join(F.broadcast(bitmap), "_bucket", "left")
    return met.withColumn(flag, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")
