"""Consistent-hash placement: a weighted ring of virtual nodes, owners, replicas and how evenly ids fall.

The ring is a configuration (150 points a node); it travels with the function that looks owners up
by binary search, a batch at a time, so ids are neither joined nor shuffled, and each id is hashed once.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.hashing import guild_hash, guild_hash_column, vnode_hash

VNODES = 150


class Ring:
    """Nodes with weights, and the sorted points of their virtual nodes."""

    def __init__(self, weights: dict[str, float] | None = None, vnodes: int = VNODES):
        self.vnodes, self.weights = vnodes, {}
        self.points: list[tuple[str, str]] = []
        for node, weight in (weights or {}).items():
            self.add(node, weight)

    def count(self, node: str) -> int:
        return max(1, int(self.vnodes * self.weights[node]))

    def add(self, node: str, weight: float = 1.0) -> None:
        if node not in self.weights:
            self.weights[node] = weight
            self.points = sorted(self.points + [(vnode_hash(node, i), node) for i in range(self.count(node))])

    def remove(self, node: str) -> None:
        if self.weights.pop(node, None) is not None:
            self.points = [p for p in self.points if p[1] != node]

    def reweight(self, node: str, weight: float) -> None:
        if node in self.weights:
            self.remove(node)
            self.add(node, weight)

    def owners(self, i: int, n: int = 1) -> list[str]:
        """The first n different nodes from the id's place on, around the ring."""
        at, out = bisect_left(self.points, (guild_hash(i), "")), []
        for k in range(len(self.points)):
            node = self.points[(at + k) % len(self.points)][1]
            if node not in out:
                out.append(node)
                if len(out) == n:
                    break
        return out

    def walks(self, n: int) -> tuple[np.ndarray, list[list[str]]]:
        """The sorted places of the points, and from each the first n different nodes; the last walk is for places after all points."""
        names = [node for _, node in self.points]
        out: list[list[str]] = []
        for at in range(len(names)):
            found: list[str] = []
            for k in range(len(names)):
                node = names[(at + k) % len(names)]
                if node not in found:
                    found.append(node)
                    if len(found) == n:
                        break
            out.append(found)
        return np.array([h for h, _ in self.points], "U32"), out + out[:1]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.points, "hash string, node string")


def nodes_at(places: Column, ring: Ring, n: int = 1) -> Column:
    """The first n different nodes from each place (32 hex digits) on, around the ring: the as-of lookup."""
    points, walks = ring.walks(n)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(values: pd.Series) -> pd.Series:
        if not walks:
            return values.map(lambda _: [], na_action="ignore")
        at = np.searchsorted(points, values.fillna("").to_numpy("U32"), "left")
        return pd.Series([None if v is None else walks[k] for k, v in zip(at, values, strict=True)], dtype=object, index=values.index)

    return found(places)


def placed(ids: Column, ring: Ring, n: int = 1) -> Column:
    """The first n different nodes from each id's place on: its owner, then its replicas."""
    return nodes_at(guild_hash_column(ids), ring, n)


def owner(ids: Column, ring: Ring) -> Column:
    return F.get(placed(ids, ring), 0)


def replicas(ids: Column, ring: Ring, count: int = 2) -> Column:
    """The nodes after the owner."""
    nodes = placed(ids, ring, count + 1)
    return F.slice(nodes, 2, F.greatest(F.size(nodes) - 1, F.lit(0)))


def bucket(ids: Column, buckets: int) -> Column:
    """The bucket of an id's place among equal parts of the hash range."""
    size = ((1 << 128) - 1) // buckets

    @F.pandas_udf(T.IntegerType())
    def found(places: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else min(int(p, 16) // size, buckets - 1) for p in places], dtype="Int32")

    return found(guild_hash_column(ids))


def spread(placed: DataFrame, column: str, buckets: int) -> DataFrame:
    """How evenly rows fall into buckets 0..n-1; empty ones count."""
    counts = placed.groupBy(column).agg(F.count("*").alias("n"))
    every = placed.sparkSession.range(buckets).select(F.col("id").cast("int").alias(column)).join(counts, column, "left")
    stats = every.select(F.coalesce("n", F.lit(0)).alias("n")).agg(
        F.sum("n").alias("total_ids"), F.count("*").alias("num_buckets"), F.avg("n").alias("expected_per_bucket"),
        F.stddev_pop("n").alias("std_deviation"), F.max("n").alias("max_bucket_count"), F.min("n").alias("min_bucket_count"),
    )
    mean = F.col("expected_per_bucket")
    return stats.withColumn("deviation_percent", F.when(mean > 0, F.col("std_deviation") / mean * 100).otherwise(0.0)).withColumn(
        "max_deviation_from_expected", F.when(mean > 0, (F.col("max_bucket_count") - mean) / mean * 100).otherwise(0.0)
    )


def node_spread(placed: DataFrame, ring: Ring, column: str = "node") -> DataFrame:
    """Rows per node, their share, and how far that is from the node's share of the weights."""
    total = sum(ring.weights.values())
    weights = placed.sparkSession.createDataFrame([(n, w / total) for n, w in ring.weights.items()], f"{column} string, weight_share double")
    counts = placed.groupBy(column).agg(F.count("*").alias("n"))
    rows = placed.agg(F.count("*").alias("rows"))
    out = weights.join(counts, column, "left").fillna(0, ["n"]).join(F.broadcast(rows))
    expected = F.col("rows") * F.col("weight_share")
    return out.select(
        column, "n", F.when(F.col("rows") > 0, F.col("n") / F.col("rows") * 100).otherwise(0.0).alias("percent"), expected.alias("expected"),
        F.when(expected > 0, (F.col("n") - expected) / expected * 100).otherwise(0.0).alias("deviation_percent"),
    )
