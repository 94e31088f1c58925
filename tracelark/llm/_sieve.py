"""A bitmap of hashes, joined by broadcast: which rows may have one of many keys, before their texts are shuffled.

The bitmap has 2 ** BITS bits, so 2 ** (BITS - 6) rows at most, whatever the number of keys. It misses nothing; with many
more keys than bits it lets everything pass, and the shuffle that follows is that of a plain join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS = 24


def _word(h: Column) -> Column:
    return F.shiftright(h.bitwiseAND(F.lit((1 << BITS) - 1)), 6).cast("int")


def _bit(h: Column) -> Column:
    return h.bitwiseAND(F.lit(63)).cast("int")


def sieve(keys: DataFrame, h: str) -> DataFrame:
    """sieve_word, sieve_mask of the 64-bit hashes in column h."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col(h)))
    return keys.groupBy(_word(F.col(h)).alias("sieve_word")).agg(F.bit_or(one).alias("sieve_mask"))


def marked(df: DataFrame, h: str, bits: DataFrame) -> DataFrame:
    """df with sieve_hit: whether its hash may be among the keys."""
    out = df.join(F.broadcast(bits), _word(F.col(h)) == F.col("sieve_word"), "left")
    hit = F.call_function("shiftright", F.coalesce("sieve_mask", F.lit(0).cast("long")), _bit(F.col(h))).bitwiseAND(F.lit(1)) == 1
    return out.withColumn("sieve_hit", hit).drop("sieve_word", "sieve_mask")
