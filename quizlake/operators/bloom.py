"""A Bloom filter as a table of blocks, built and probed with built-in expressions only.

The filter has B blocks of 64 words of 64 bits. A key falls into one block and sets four bits in it. The table has one
row per block that is not empty, so probing is a join on the block number: no Python, no driver. The join is a broadcast
while the filter is small; a larger filter stays partitioned by blocks and the keys are shuffled to theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
BLOCK_BITS = 4096
PROBES = 4
#: The filter is broadcast only up to this size; beyond it, keys meet its blocks in a shuffled join.
MAX_BYTES = 64 << 20


def block_count(keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    return max(1, -(-keys * bits_per_key // BLOCK_BITS))


def fits(keys: int, bits_per_key: int = BITS_PER_KEY, max_bytes: int = MAX_BYTES) -> bool:
    """Whether the filter of so many keys may be broadcast."""
    return block_count(keys, bits_per_key) * (BLOCK_BITS // 8) <= max_bytes


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(7))
    return [F.shiftrightunsigned(h, 12 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(PROBES)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def build(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(_block, _words array<bigint>) of the non-null values of ``key``. Bits are or-ed before the shuffle."""
    bits = F.explode(F.array(*_bits(F.col(key)))).alias("_bit")
    words = (
        keys.where(F.col(key).isNotNull())
        .select(_block(F.col(key), blocks).alias("__bloom_block"), bits)
        .groupBy("__bloom_block", F.shiftright("_bit", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, _bit & 63)")).alias("_mask"))
    )
    filled = words.groupBy("__bloom_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_mask"))).alias("_m"))  # 64 entries at most
    return filled.select("__bloom_block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0))).alias("__bloom_words"))


def probe(rows: DataFrame, key: str, filter_table: DataFrame, blocks: int, flag: str, whole: bool = True) -> DataFrame:
    """``rows`` with the boolean column ``flag``: false if ``key`` is surely not in the filter. Null keys get false.

    ``whole``: the filter is small enough to be broadcast (``fits``); else it is joined by its blocks.
    """
    hit = F.lit(True)
    for bit in _bits(F.col(key)):
        hit = hit & _test(bit)
    at = rows.withColumn("__bloom_at", F.when(F.col(key).isNotNull(), _block(F.col(key), blocks)))
    out = at.join(F.broadcast(filter_table) if whole else filter_table, F.col("__bloom_at") == F.col("__bloom_block"), "left")
    return out.withColumn(flag, F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))).drop("__bloom_at", "__bloom_block", "__bloom_words")


def _test(bit: Column) -> Column:
    word = F.element_at("__bloom_words", F.shiftright(bit, 6) + 1)
    return F.call_function("shiftrightunsigned", word, bit.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1
