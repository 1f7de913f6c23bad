"""Unions over sources that may hold the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import row_key


def _union(sources: list[DataFrame]) -> DataFrame:
    numbered = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def union_first(sources: list[DataFrame], key: str | None = None) -> DataFrame:
    """All rows, one per key, that of the first source. Without a key: by id, else row_id, else all columns."""
    rows = _union(sources)
    names = [c for c in rows.columns if c != "_source"]
    key = key or next((c for c in ("id", "row_id") if c in names), None)
    by = F.col(f"`{key}`") if key else row_key(names)
    picked = rows.groupBy(by.alias("_key")).agg(F.min_by(F.struct(*names), "_source").alias("_row"))
    return picked.select("_row.*")


def first_positive(sources: list[DataFrame]) -> DataFrame:
    """The rows of the first source that has any."""
    rows = _union(sources)
    first = rows.agg(F.min("_source").alias("_first"))
    return rows.join(F.broadcast(first), F.col("_source") == F.col("_first")).drop("_source", "_first")


def responses(sources: dict[str, DataFrame | None]) -> DataFrame:
    """Per source: whether it answered, and its rows."""
    spark = next(s for s in sources.values() if s is not None).sparkSession
    counted = [s.agg(F.lit(n).alias("source"), F.lit(True).alias("responded"), F.count("*").alias("rows")) for n, s in sources.items() if s is not None]
    failed = [spark.range(1).select(F.lit(n).alias("source"), F.lit(False).alias("responded"), F.lit(0).cast("long").alias("rows")) for n, s in sources.items() if s is None]
    return reduce(lambda a, b: a.unionByName(b), counted + failed)


def node_per_cluster(nodes: DataFrame) -> DataFrame:
    """One healthy node of each cluster, that of least load, then name."""
    return nodes.filter("healthy").groupBy("cluster_id").agg(F.min_by("node_id", F.struct("load", "node_id")).alias("node_id"))
