"""Running values over a key's rows in order of time, without a key's whole history in one task.

A key's time is cut in pieces of ``split`` seconds. Values run within a piece; what a piece hands on is one row, and the
rows of a key's pieces are the only ones that one task puts in order. Rows of equal time are ordered by ``tie``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quarry.functions.numbers import level_of, micros

SPLIT_SECONDS = 3600


def cut(rows: DataFrame, ts: str = "ts", split: int = SPLIT_SECONDS) -> DataFrame:
    return rows.withColumn("_at", micros(F.col(ts))).withColumn("_piece", F.floor(F.col("_at") / (split * 1_000_000)).cast("long"))


def within(keys: list[str], tie: str) -> WindowSpec:
    return Window.partitionBy(*keys, "_piece").orderBy("_at", tie)


def so_far(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_carried(rows: DataFrame, keys: list[str], of_piece: dict[str, Column], over: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Cut rows with what the pieces before hand on: of_piece aggregates a piece, over combines those of the pieces before."""
    table = rows.groupBy(*keys, "_piece").agg(*[c.alias(n) for n, c in of_piece.items()])
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    handed = table.select(*names, F.col("_piece").alias("_p"), *[c.alias(n) for n, c in over(before).items()])
    same = F.col("_piece") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(handed, same).drop("_p", *[f"_k{i}" for i in range(len(keys))])


def running_sum(rows: DataFrame, keys: list[str], value: Column, out: str, ts: str = "ts", tie: str = "event_id", split: int = SPLIT_SECONDS) -> DataFrame:
    """rows with the sum of a value of no null over a key's rows up to each."""
    pieces = cut(rows, ts, split).withColumn("_value", value)
    held = with_carried(pieces, keys, {"_sum": F.sum("_value")}, lambda w: {"_carried": F.coalesce(F.sum("_sum").over(w), F.lit(0))})
    return held.withColumn(out, F.col("_carried") + F.sum("_value").over(so_far(within(keys, tie)))).drop("_at", "_piece", "_value", "_carried")


def numbered(rows: DataFrame, keys: list[str], out: str = "number", ts: str = "ts", tie: str = "event_id", split: int = SPLIT_SECONDS) -> DataFrame:
    """rows with their number, from 1, within the key."""
    return running_sum(rows, keys, F.lit(1), out, ts, tie, split).withColumn(out, F.col(out).cast("int"))


def previous(rows: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", tie: str = "event_id", split: int = SPLIT_SECONDS) -> DataFrame:
    """rows with _previous, a struct of the columns of the key's row before; null of a first row."""
    pieces = cut(rows, ts, split)
    last = F.max_by(F.struct(*columns), F.struct("_at", tie))
    held = with_carried(pieces, keys, {"_last": last}, lambda w: {"_carried": F.last("_last", ignorenulls=True).over(w)})
    here = F.lag(F.struct(*columns)).over(within(keys, tie))
    return held.withColumn("_previous", F.coalesce(here, F.col("_carried"))).drop("_at", "_piece", "_carried")


def points(rows: DataFrame, keys: list[str], change: str, out: str = "points", **order) -> DataFrame:
    """Points given and taken back, never under zero: the running sum, less its least value so far where that is negative."""
    summed = running_sum(rows, keys, F.col(change), "_all", **order)
    pieces = cut(summed, order.get("ts", "ts"), order.get("split", SPLIT_SECONDS))
    held = with_carried(pieces, keys, {"_low": F.min("_all")}, lambda w: {"_carried": F.min("_low").over(w)})
    least = F.least(F.lit(0), F.col("_carried"), F.min("_all").over(so_far(within(keys, order.get("tie", "event_id")))))
    return held.withColumn(out, (F.col("_all") - least).cast("long")).drop("_at", "_piece", "_all", "_carried")


def away(rows: DataFrame, keys: list[str], mark: str, ts: str = "ts", **order) -> DataFrame:
    """Set away by a mark, back by the next row that is none: only the row before matters."""
    marked = rows.withColumn("_t", micros(F.col(ts))).withColumn("_mark", F.coalesce(F.col(mark), F.lit(False)))
    held = previous(marked, keys, ["_t", "_mark"], ts, **order)
    back = ~F.col("_mark") & F.coalesce(F.col("_previous._mark"), F.lit(False))
    return held.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_mark").alias("away"), back.alias("returned"), F.when(back, F.col("_t") / 1e6 - F.col("_previous._t") / 1e6).alias("away_seconds"))


def levels(rows: DataFrame, keys: list[str], gained: str, daily: int = 15, ts: str = "ts", tie: str = "event_id", split: int = SPLIT_SECONDS) -> DataFrame:
    """Experience per message, of the first ``daily`` of a key and day, and the level that it buys so far."""
    day = rows.withColumn("_day", F.floor(micros(F.col(ts)) / 86_400_000_000))
    number = F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(ts, tie))
    counted = day.withColumn("counted", number <= daily)
    summed = running_sum(counted, keys, F.when(F.col("counted"), F.col(gained)).otherwise(0).cast("long"), "total_xp", ts, tie, split)
    bought = summed.withColumn("_l", level_of(F.col("total_xp")))
    return bought.select(*[F.col(f"`{c}`") for c in rows.columns], "counted", F.col("_l.level").cast("int").alias("level"), F.col("_l.rest").alias("xp"), F.col("total_xp").cast("long").alias("total_xp"))
