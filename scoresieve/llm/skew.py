"""Joins whose keys may be very unequal in rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import unused

#: A key is hot if more than one in so many rows have it, so there are fewer hot keys than this.
HOT_SHARE = 5000
#: Words of 64 bits in a filter of keys, at most: 16 bytes each where it is broadcast.
FILTER_WORDS = 1 << 20


def joined(left: DataFrame, right: DataFrame, on: list[str], rows: int, size: str) -> DataFrame:
    """Inner join of left to right, which has one row for each key and, in column `size`, how many of left's rows have it.

    rows: how many rows left has. Fewer than HOT_SHARE keys have more than rows / HOT_SHARE of them: these are broadcast,
    so left's rows of such a key stay where they are. The others are joined by a shuffle, in which no key is hot.
    left is read twice, so it should be a stored table.
    """
    most = max(1, rows // HOT_SHARE)
    hot = F.broadcast(right.where(F.col(size) > most))
    cold = left.join(F.broadcast(right.where(F.col(size) > most).select(*on)), on, "left_anti").join(right.where(F.col(size) <= most), on)
    return left.join(hot, on).unionByName(cold)


def marked(left: DataFrame, right: DataFrame, on: list[str], keys: int, name: str) -> DataFrame:
    """left with a boolean column `name`: false only where right has no row of the key.

    keys: how many right has. The filter has 16 hashed bits for each of them, and no more than FILTER_WORDS words, beyond
    which more rows are marked in vain. It serves to shuffle only what may find a partner.
    """
    word, bits = unused(left, "word", "bits")
    words = 1 << min(max(0, (keys * 16 // 64).bit_length()), FILTER_WORDS.bit_length() - 1)
    h = F.xxhash64(*(F.col(c) for c in on))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    at = F.pmod(F.shiftright(h, 6), F.lit(words))
    table = right.groupBy(at.alias(word)).agg(F.bit_or(one).alias(bits))
    out = left.join(F.broadcast(table), at == table[word], "left")
    return out.withColumn(name, F.coalesce(F.col(bits).bitwiseAND(one), F.lit(0).cast("long")) != 0).drop(word, bits)
