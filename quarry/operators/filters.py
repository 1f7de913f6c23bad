"""Bloom filters as tables of 64-bit words, so that neither building nor asking one needs it whole anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import bloom_positions


def filter_words(keys: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """word, bits of a filter of m bits and k functions: at most m / 64 rows, combined before the shuffle."""
    spots = keys.select(F.explode(bloom_positions(F.col(key), m, k)).alias("p"))
    return spots.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))


def asked(rows: DataFrame, key: str, words: DataFrame, m: int, k: int) -> DataFrame:
    """rows with ``maybe``: whether all bits of the key are set. Each key is asked once; a null key is not in a filter."""
    spots = rows.select(key).distinct().select(key, F.explode(bloom_positions(F.col(key), m, k)).alias("p")).withColumn("word", F.shiftright("p", 6))
    bit = F.expr("coalesce(bits & shiftleft(1L, cast(p & 63 as int)), 0L) != 0")
    found = spots.join(words, "word", "left").groupBy(key).agg(F.bool_and(bit).alias("maybe"))
    return rows.join(found, key, "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))
