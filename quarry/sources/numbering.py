"""Numbers without gaps for the rows of a frame, by the counts of its partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(rows: DataFrame, path: str) -> tuple[DataFrame, int]:
    """rows with _no from 0, in the order of their partitions and of the rows within, and how many they are.

    Rows are written to the path once, so that a second reading finds them as they were; the driver holds a row a partition."""
    spark, place = rows.sparkSession, F.monotonically_increasing_id()
    rows.select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_no")).write.parquet(path)
    staged = spark.read.schema(rows.schema.add("_part", "long").add("_no", "long")).parquet(path)
    offsets, total = [], 0
    for r in sorted(staged.groupBy("_part").count().collect()):
        offsets.append((r["_part"], total))
        total += r["count"]
    offset = spark.createDataFrame(offsets, "_part long, _offset long")
    return staged.join(F.broadcast(offset), "_part").withColumn("_no", F.col("_no") + F.col("_offset")).drop("_part", "_offset"), total


def chunks(rows: DataFrame, order: list[str], size: int, path: str, out: str = "chunk") -> DataFrame:
    """rows in order, cut in chunks of a size, numbered from 0: sorted by ranges, not in one task."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return numbered(ordered, path)[0].withColumn(out, F.floor(F.col("_no") / size).cast("long")).drop("_no")
