"""Hashes and ids. Built-in expressions, but for BLAKE2b and 64-bit mixing, which run in Arrow batches."""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = (1 << 64) - 1
# The multipliers of the 64-bit finalizer.
MULTIPLIERS = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def mix64(x: int) -> int:
    for m in MULTIPLIERS:
        x = ((x ^ (x >> 33)) * m) & MASK
    return x ^ (x >> 33)


def _rotated(x: int, by: int) -> int:
    return ((x << by) | (x >> (32 - by))) & 0xFFFFFFFF


def whiten(i: int) -> int:
    """Mixes the time bits of an id with its sequence bits."""
    high, low = (i >> 32) & 0xFFFFFFFF, i & 0xFFFFFFFF
    return mix64((high ^ _rotated(low, 17)) << 32 | (low ^ _rotated(high, 13)))


def guild_hash(i: int, seed: int = 0) -> str:
    """128 bits as 32 hex digits, whose order as texts is that of the numbers."""
    return hashlib.blake2b(struct.pack("<QQ", whiten(i & MASK), seed), digest_size=16).hexdigest()


def vnode_hash(node: str, index: int) -> str:
    return hashlib.blake2b(f"{node}:vnode:{index}".encode(), digest_size=16).hexdigest()


# Ids come as texts, as a batch of longs with a null would come as doubles, which lack digits.
@F.pandas_udf(T.StringType())
def _guild_hashes(ids: pd.Series) -> pd.Series:
    return pd.Series([None if i is None else guild_hash(int(i)) for i in ids], dtype=object)


@F.pandas_udf(T.DecimalType(20, 0))
def _whitened(ids: pd.Series) -> pd.Series:
    from decimal import Decimal

    return pd.Series([None if i is None else Decimal(whiten(int(i) & MASK)) for i in ids], dtype=object)


def _id(ids) -> Column:
    return (F.col(ids) if isinstance(ids, str) else ids).cast("string")


def guild_hash_column(ids) -> Column:
    return _guild_hashes(_id(ids))


def whiten_column(ids) -> Column:
    return _whitened(_id(ids))


def short_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def random_id(prefix: str = "", length: int = 8) -> Column:
    out = F.upper(F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, length))
    return F.concat(F.lit(f"{prefix}-"), out) if prefix else out


def row_key(columns: list[str]) -> Column:
    """MD5 over name=value of all columns by name; null differs from an empty text."""
    return F.md5(F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00"))) for c in sorted(columns)]))


def query_key(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def hash_bucket(key: Column, buckets: int = 1024) -> Column:
    """MD5 of the key as text, modulo a power of two up to 4096."""
    return (F.conv(F.right(F.md5(key.cast("string")), F.lit(3)), 16, 10).cast("int") % buckets).cast("int")


def bloom_shape(n: int, p: float = 0.01) -> tuple[int, int]:
    """Bits and hash functions of a filter of n keys with false-positive rate p."""
    import math

    m = max(64, int(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, int(m / n * math.log(2)))


def bloom_positions(key: Column, m: int, k: int) -> Column:
    """Bits of a key: the first four bytes, little endian, of MD5(key, i as u32), modulo m."""
    out = []
    for i in range(k):
        h = F.md5(F.concat(key.cast("string").cast("binary"), F.lit(i.to_bytes(4, "little"))))
        swapped = F.concat(*[F.substring(h, s, 2) for s in (7, 5, 3, 1)])
        out.append((F.conv(swapped, 16, 10).cast("long") % m).cast("long"))
    return F.array(*out)
