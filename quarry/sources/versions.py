"""Row versions: an append-only change log that is merged on read.

Every change is a row with _row_id, _version, _deleted and _level. The last version of a row id
wins; tombstones hide the row. Merging is an aggregate, so map sides combine before the shuffle.
Flushes write sorted runs with Bloom filters on the row id; when a level has ``fanout`` runs they
are merged into one of the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Store

META = [T.StructField("_row_id", T.LongType()), T.StructField("_version", T.LongType()), T.StructField("_deleted", T.BooleanType())]
LEVELS = 7


def merged(changes: DataFrame, tombstones: bool = False) -> DataFrame:
    """The last version of every row id; deleted ones only with ``tombstones``."""
    others = [c for c in changes.columns if c != "_row_id"]
    last = changes.groupBy("_row_id").agg(F.max_by(F.struct(*others), "_version").alias("_row")).select("_row_id", "_row.*")
    return last if tombstones else last.filter("not _deleted")


class ChangeLog:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, fanout: int = 4):
        self.spark, self.store, self.fanout = spark, Store(spark, root), fanout
        self.schema = T.StructType(META + schema.fields)

    def _registry(self) -> tuple[list[tuple[int, str]], int, int]:
        """(level, name) of every run that the newest registry lists, the last version given, and the registry's number."""
        known = [n for n in self.store.names("_registry") if n.endswith(".json") and not n.startswith(".")]
        if not known:
            return [], 0, -1
        now = self.store.read(f"_registry/{known[-1]}")
        return [tuple(r) for r in now["runs"]], now["version"], int(known[-1].split(".")[0])

    def _runs(self) -> list[tuple[int, str]]:
        return self._registry()[0]

    def _register(self, runs: list[tuple[int, str]], version: int, after: int) -> None:
        """The registry that follows number ``after``; fails if another writer was first."""
        self.store.create(f"_registry/{after + 1:020d}.json", {"runs": runs, "version": version})

    def _write(self, rows: DataFrame, level: int) -> tuple[int, str]:
        name = f"runs/{uuid.uuid4().hex}"
        rows.sortWithinPartitions("_row_id", "_version").write.option("parquet.bloom.filter.enabled#_row_id", "true").parquet(self.store.at(name))
        return level, name

    def changes(self) -> DataFrame:
        runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self.store.at(n) for _, n in runs])

    def append(self, changes: DataFrame, version: int | None = None) -> None:
        """A run of level 0, from a batch of changes; version: the greatest of them, if it is known."""
        runs, last, after = self._registry()
        run = self._write(changes.select(*self.schema.names), 0)
        if version is None:
            version = self.spark.read.schema(self.schema).parquet(self.store.at(run[1])).agg(F.max("_version")).first()[0] or 0
        self._register([*runs, run], max(last, version), after)

    def _next(self) -> int:
        """The version after the last, which the registry knows."""
        return self._registry()[1] + 1

    def put(self, rows: DataFrame) -> None:
        """New versions of rows that carry their _row_id; columns they lack keep their last value, which only the changes of those ids are merged for."""
        version = self._next()
        missing = [c for c in self.schema.names if c not in rows.columns and c not in ("_version", "_deleted")]
        if missing:
            known = self.changes().join(rows.select("_row_id").distinct(), "_row_id", "left_semi")
            rows = rows.join(merged(known).select("_row_id", *missing), "_row_id", "left")
        self.append(rows.withColumn("_version", F.lit(version).cast("long")).withColumn("_deleted", F.lit(False)), version)

    def delete(self, ids: DataFrame) -> None:
        """Tombstones of row ids."""
        version = self._next()
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields[len(META) :]]
        self.append(ids.select("_row_id", F.lit(version).cast("long").alias("_version"), F.lit(True).alias("_deleted"), *empty), version)

    def scan(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """Live rows, of a range of ids; the range reaches the Parquet scan."""
        rows = self.changes()
        if low is not None:
            rows = rows.filter(F.col("_row_id") >= low)
        if high is not None:
            rows = rows.filter(F.col("_row_id") <= high)
        return merged(rows)

    def get(self, row_id: int) -> DataFrame:
        return merged(self.changes().filter(F.col("_row_id") == row_id))

    def find_all_by_column(self, column: str, value) -> DataFrame:
        """Live rows whose column equals the value, or its text."""
        return self.scan().filter((F.col(column).cast("string") == str(value)))

    def find_by_column(self, column: str, value) -> DataFrame:
        return self.find_all_by_column(column, value).orderBy("_row_id").limit(1)

    def compact(self) -> None:
        """All runs become one of live rows."""
        _, version, after = self._registry()
        self._register([self._write(self.scan().select(*self.schema.names), LEVELS - 1)], version, after)

    def compact_levels(self) -> bool:
        """Levels of ``fanout`` runs become one run of the next; tombstones go only at the last level."""
        runs, version, after = self._registry()
        for level in range(LEVELS - 1):
            mine = [r for r in runs if r[0] == level]
            if len(mine) >= self.fanout:
                rows = self.spark.read.schema(self.schema).parquet(*[self.store.at(n) for _, n in mine])
                last = not [r for r in runs if r[0] > level]
                one = self._write(merged(rows, tombstones=not last).select(*self.schema.names), level + 1)
                self._register([r for r in runs if r[0] != level] + [one], version, after)
                return True
        return False

    def clear(self) -> None:
        _, version, after = self._registry()
        self._register([], version, after)

    def stats(self) -> DataFrame:
        return self.changes().agg(
            F.count("*").alias("entries"), F.countDistinct("_row_id").alias("row_ids"), F.count_if("_deleted").alias("tombstones"),
            F.min("_row_id").alias("min_row_id"), F.max("_row_id").alias("max_row_id"),
        )


class WriteBuffer:
    """An ordered write buffer of single changes in memory, flushed to a ChangeLog as a run at a number of
    entries or bytes. Reads see the buffer before the log. Many changes at once come as a frame, which is a run of its own."""

    def __init__(self, log: ChangeLog, entries: int = 100_000, size: int = 64 << 20):
        self.log, self.entries, self.size = log, entries, size
        self.rows: dict[int, tuple] = {}
        self.bytes = 0
        self._last = log._next() - 1

    def put(self, row_id: int, values: dict | None) -> None:
        """A new version of a row; None deletes it."""
        self._last += 1
        fields = self.log.schema.names[len(META) :]
        self.rows[row_id] = (row_id, self._last, values is None, *[(values or {}).get(f) for f in fields])
        self.bytes += len(repr(values)) + 24
        if len(self.rows) >= self.entries or self.bytes >= self.size:
            self.flush()

    def put_frame(self, rows: DataFrame) -> None:
        """New versions of many rows, after those of the buffer; they do not pass through the driver."""
        self.flush()
        self.log.put(rows)
        self._last = self.log._next() - 1

    def changes(self) -> DataFrame:
        return self.log.spark.createDataFrame(sorted(self.rows.values()), self.log.schema)

    def flush(self) -> None:
        if self.rows:
            self.log.append(self.changes().coalesce(1), self._last)
            self.rows, self.bytes = {}, 0

    def scan(self) -> DataFrame:
        return merged(self.changes().unionByName(self.log.changes())) if self.rows else self.log.scan()


def compacted_changes(sources: list[DataFrame]) -> DataFrame:
    """Live rows over memory, immutable and disk tables, the first source the newest."""
    from functools import reduce

    numbered = [s.withColumn("_version", F.struct(F.lit(-i).alias("source"), F.col("_version").alias("version"))) for i, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    return merged(rows).drop("_version")
