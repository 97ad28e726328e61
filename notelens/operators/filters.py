"""A blocked Bloom filter of keys, to drop rows without a partner before they are shuffled.

A key's hash chooses one block of four 64-bit words and a bit in each word; the filter is
the table of filled blocks. Its number of blocks follows the number of keys, up to
``MAX_BLOCKS`` (32 MB of bits, made for 16 million keys), so its broadcast is bounded. With
still more keys it lets more rows pass; it never drops a row whose key is listed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelens.operators.scale import stage

MAX_BLOCKS = 1 << 20
#: Keys meant for a block of 256 bits.
PER_BLOCK = 16
LANES = 4


@dataclass(frozen=True)
class KeyFilter:
    filled: DataFrame
    blocks: int


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(2))
    one = F.lit(1).cast("bigint")
    return [F.call_function("shiftleft", one, F.shiftright(h, 6 * k).bitwiseAND(63).cast("int")) for k in range(LANES)]


def key_filter(keys: DataFrame, key: str) -> KeyFilter:
    """The filter of the column ``key`` of a written table."""
    blocks = 1
    while blocks < min(MAX_BLOCKS, keys.count() // PER_BLOCK + 1):
        blocks *= 2
    bits = keys.select(_block(F.col(key), blocks).alias("_block"), *[b.alias(f"_w{k}") for k, b in enumerate(_bits(F.col(key)))])
    filled = bits.groupBy("_block").agg(*[F.bit_or(f"_w{k}").alias(f"_w{k}") for k in range(LANES)])
    return KeyFilter(stage(filled, "key-filter"), blocks)


def may_match(rows: DataFrame, key: str, kept: KeyFilter) -> DataFrame:
    """The rows whose key the filter holds: all with a listed key, and few others."""
    probed = rows.withColumn("_block", _block(F.col(key), kept.blocks)).join(F.broadcast(kept.filled), "_block")
    held = F.lit(True)
    for k, bit in enumerate(_bits(F.col(key))):
        held = held & (F.col(f"_w{k}").bitwiseAND(bit) != 0)
    return probed.filter(held).select(*rows.columns)
