"""Authenticated encryption of values at rest, with the key in a session setting of the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "quarry.crypto.key"


def _key(spark) -> Column:
    key = spark.conf.get(KEY, "")
    if len(key.encode()) not in (16, 24, 32):
        raise ValueError(f"{KEY} must hold 16, 24 or 32 bytes")
    return F.lit(key)


def encrypt_value(spark, value: Column) -> Column:
    return F.base64(F.aes_encrypt(value.cast("string").cast("binary"), _key(spark), F.lit("GCM")))


def decrypt_value(spark, value: Column) -> Column:
    """The plain text; a value that is no ciphertext of this key passes through."""
    raw = F.try_aes_decrypt(F.try_to_binary(value, F.lit("base64")), _key(spark), F.lit("GCM")).cast("string")
    return F.coalesce(raw, value)


def encrypt_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: encrypt_value(rows.sparkSession, F.col(c)) for c in columns})


def decrypt_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: decrypt_value(rows.sparkSession, F.col(c)) for c in columns})


def intact(spark, value: Column) -> Column:
    """Whether a value is a ciphertext of this key."""
    return F.try_aes_decrypt(F.try_to_binary(value, F.lit("base64")), _key(spark), F.lit("GCM")).isNotNull()
