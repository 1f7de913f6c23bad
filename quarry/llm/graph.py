"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Components are halved in depth by each round; 2**ROUNDS exceeds any path.
ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges(a, b): root is the smallest node of the component.

    Alternates large-star steps (larger neighbours move to the smallest neighbour) and small-star
    steps (smaller neighbours move there too), each a join with an aggregate, until nothing changes; it
    fails if that takes more than ROUNDS rounds. What a join meets is written to the shared folder first, so that a round
    survives lost executors and a node of very many neighbours is split over tasks. Loops and repeated edges are harmless;
    an empty table gives an empty one.
    """
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, "edges")
    last = None
    for _ in range(ROUNDS):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "low")
        large = written(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        now = written(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components are not complete after {ROUNDS} rounds")
    leaves = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return written(leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
