"""Exact dedup by a log-structured merge index of digests.

The rows of every input partition fill memtables of ``MEMTABLE`` rows; each is flushed as a run of
level 0, a file of (digest, doc_id, row) sorted by digest. While a level has more than ``fanout`` runs, compaction merges
them by that many into runs of the next, keeping for each digest the smallest doc_id and the number of
rows; a major compaction merges the last ones. Digests of more than one row are hits. A Bloom filter of them, of
``FILTER_BITS`` bits at most, is asked by every text: only texts that it may hold are fetched and met with the hits, so
texts without copies are not shuffled. Hits are compared byte for byte; texts that only share a digest are regrouped by the text itself.

Defined cases: a null text counts as empty; a null doc_id comes after all others (keep_id is null
only where no row of the text has a doc_id); repeated rows are rows of their own, counted in
group_size; of each text exactly one row is kept, also where several have the smallest doc_id (in the decision table the
first in the input; ``drop_copies`` leaves one of them); an empty table gives an empty result; further columns are
ignored by ``decisions`` and carried by ``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, new_path, sized, text_of, written

#: A set of hit digests is sent to every executor up to this many rows (about 60 bytes each).
BROADCAST_ROWS = 500_000
#: Rows of a memtable, about 50 bytes each.
MEMTABLE = 1 << 20
#: Bits of a filter: 16 for each digest, up to this many (32 MB).
FILTER_BITS = 1 << 28
HASHES = 4


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def whole_text(text: Column) -> Column:
    """No digest: equal keys are equal texts."""
    return text


def once(value: Column) -> Column:
    """The value, computed once a row: it counts as not deterministic, so it is not put in the place of its name wherever that is used."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def places(digest: Column, bits: int) -> list[Column]:
    """The bits of a digest in a filter of so many."""
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits).cast("long")) for k in range(HASHES)]


def filter_of(digests: DataFrame) -> Callable[[Column], Column]:
    """A test whether a table(digest) may hold a digest, a column of its own: false is certain."""
    n = digests.count()
    bits = 1 << 10
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2
    spots = digests.select(F.explode(F.array(*places(F.col("digest"), bits))).alias("p"))
    words = spots.groupBy(F.shiftright("p", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    # one row of at most FILTER_BITS / 64 longs
    dense = digests.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    whole = written(dense.agg(F.array_sort(F.collect_list(F.struct("id", "bits"))).alias("w")).select(F.col("w.bits").alias("bits")), "filter")

    def may_hold(digest: Column) -> Column:
        out = F.lit(n > 0)
        for p in places(digest, bits):
            word = F.get(whole.scalar(), F.shiftright(p, 6).cast("int"))
            out = out & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))) != 0)
        return out

    return may_hold


class DigestIndex:
    """Levels of sorted digest runs in the shared folder. ``fanout`` runs of a level make one of the next."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 16, memtable: int = MEMTABLE):
        self.spark, self.path, self.fanout, self.memtable = spark, path or new_path(spark, "digests"), fanout, memtable
        #: By level, its folder and number of runs; and the batches that were flushed.
        self.levels: dict[int, list[tuple[str, int]]] = {}
        self._made = 0

    def _write(self, rows: DataFrame, level: int) -> DataFrame:
        """rows(run, digest, ...) as sorted runs of a level; run numbers are made dense."""
        at = f"{self.path}/level={level}/batch={self._made}"
        self._made += 1
        rows.sortWithinPartitions("run", "digest").write.option("compression", "zstd").option("maxRecordsPerFile", self.memtable).parquet(at)
        made = self.spark.read.schema(rows.schema).parquet(at)
        self.levels.setdefault(level, []).append((at, made.select("run").distinct().count()))
        return made

    def flush(self, rows: DataFrame) -> DataFrame:
        """rows(digest, doc_id): memtables become runs of level 0, and full levels are compacted. Returns digest, doc_id, row as flushed."""
        place = F.monotonically_increasing_id()
        many = F.shiftright(place, 33) * (1 << 20) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / self.memtable)
        flushed = self._write(rows.select("digest", "doc_id", place.alias("row"), many.cast("long").alias("run")), 0)
        level = 0
        while sum(n for _, n in self.levels.get(level, [])) > self.fanout:
            self.compact(level)
            level += 1
        return flushed.select("digest", "doc_id", "row")

    def _entries(self, level: int) -> DataFrame:
        """run, digest, keep (the least of (no doc_id, doc_id, row)), n of a level; runs are numbered through its batches."""
        out, first = None, 0
        for at, runs in self.levels[level]:
            rows = self.spark.read.parquet(at)
            number = rows.select("run").distinct().orderBy("run") if level == 0 else None
            if level == 0:  # numbers of runs by partition and memtable, made dense: a row a run
                dense = self.spark.createDataFrame([(r["run"], first + k) for k, r in enumerate(number.collect())], "run long, no long")
                rows = rows.join(F.broadcast(dense), "run").select(
                    F.col("no").alias("run"), "digest", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("keep"), F.lit(1).cast("long").alias("n")
                )
            else:
                rows = rows.withColumn("run", F.col("run") + first)
            out, first = rows if out is None else out.unionByName(rows), first + runs
        return out

    @staticmethod
    def _merge(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by, "digest").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))

    def compact(self, level: int) -> None:
        """The runs of a level become runs of the next, each of ``fanout`` and with one row per digest."""
        rows = self._entries(level).withColumn("run", F.floor(F.col("run") / self.fanout))
        self.levels.pop(level)
        self._write(self._merge(rows, "run").select("digest", "keep", "n", "run"), level + 1)

    def compact_all(self) -> None:
        """A major compaction: every level becomes one run above them all."""
        if sum(n for batches in self.levels.values() for _, n in batches) > 1 or 0 in self.levels:
            rows, top = self._merged().withColumn("run", F.lit(0).cast("long")), max(self.levels, default=0)
            self.levels = {}
            self._write(rows.select("digest", "keep", "n", "run"), top + 1)

    def _merged(self) -> DataFrame:
        rows = None
        for level in self.levels:
            mine = self._entries(level).select("digest", "keep", "n")
            rows = mine if rows is None else rows.unionByName(mine)
        single = len(self.levels) == 1 and 0 not in self.levels and sum(n for _, n in next(iter(self.levels.values()))) <= 1
        return rows if single else self._merge(rows)

    def entries(self) -> DataFrame:
        """digest, keep_id, keep_row, n of all that was flushed."""
        return self._merged().select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "n")

    def lookup(self, rows: DataFrame) -> DataFrame:
        """rows(digest, ...) with keep_id and n of equal digests seen so far; null where new. The filter tells most new ones."""
        entries = self.entries().select("digest", "keep_id", "n")
        may_hold = filter_of(entries)
        seen = rows.filter(may_hold(F.col("digest"))).join(entries, "digest", "left")
        new = rows.filter(~may_hold(F.col("digest")))
        return seen.unionByName(new.withColumns({"keep_id": F.lit(None).cast("long"), "n": F.lit(None).cast("long")}))


def _index(docs: DataFrame, digest) -> tuple[DataFrame, DataFrame]:
    """The flushed rows (digest, doc_id, row) and, of each hit, keep_id, keep_row and group size."""
    index = DigestIndex(docs.sparkSession)
    flushed = index.flush(docs.select(digest(normalised(text_of())).alias("digest"), F.col("doc_id").cast("long").alias("doc_id")))
    index.compact_all()
    return flushed, written(index.entries().filter("n > 1"), "hits")


def _collisions(docs: DataFrame, hits: DataFrame, digest) -> DataFrame:
    """Digests whose texts are not all the same bytes: the least differs from the greatest. Map sides
    combine, so a group of copies sends two texts a task and meets nowhere."""
    may_hold = filter_of(hits.select("digest"))
    body = docs.select(text_of().alias("text"), once(digest(normalised(text_of()))).alias("digest")).filter(may_hold(F.col("digest")))
    body = body.select("digest", normalised(F.col("text")).alias("body"))
    ends = body.join(sized(hits.select("digest"), BROADCAST_ROWS), "digest").groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    return written(ends.filter(F.col("low") != F.col("high")).select("digest"), "collided")


def decisions(docs: DataFrame, digest=sha256_digest) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    flushed, hits = _index(docs, digest)
    if digest is not whole_text and not _collisions(docs, hits, digest).isEmpty():
        return decisions(docs, whole_text)
    if digest not in (whole_text, sha256_digest):
        return decisions(docs)  # whose digests are also the result's
    met = flushed.join(sized(hits, BROADCAST_ROWS), "digest", "left")
    alone = F.col("n").isNull()
    hex_of = F.lower(F.hex("digest")) if digest is sha256_digest else F.sha2("digest", 256)
    return met.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        hex_of.alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, digest=sha256_digest) -> DataFrame:
    """docs without the rows whose normalised text a row of smaller doc_id has; columns unchanged."""
    flushed, hits = _index(docs, digest)
    if digest is not whole_text and not _collisions(docs, hits, digest).isEmpty():
        return drop_copies(docs, whole_text)
    copies = hits.select(F.col("digest").alias("__quarry_digest"), F.col("keep_id").alias("__quarry_keep"))
    may_hold, key = filter_of(hits.select("digest")), F.col("__quarry_key")
    asked = docs.withColumn("__quarry_key", once(digest(normalised(text_of())))).withColumn("__quarry_key", F.when(may_hold(key), key))
    shape = [F.col(f"`{c}`") for c in docs.columns]
    same, copy = F.col("__quarry_key") == F.col("__quarry_digest"), F.col("__quarry_digest").isNotNull()
    if copies.count() <= BROADCAST_ROWS:
        met, others = asked.join(F.broadcast(copies), same, "left"), None
    else:  # texts that the filter tells from all copies are not shuffled
        met, others = asked.filter("__quarry_key IS NOT NULL").join(copies, same, "left"), asked.filter("__quarry_key IS NULL").select(*shape)
    first = docs["doc_id"].eqNullSafe(F.col("__quarry_keep"))
    least = flushed.join(sized(hits, BROADCAST_ROWS), "digest").filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if least.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        left = met.filter(~copy | first).select(*shape)
    else:  # several rows have the smallest doc_id
        left = met.filter(~copy).select(*shape).unionByName(met.filter(copy & first).dropDuplicates(["__quarry_digest"]).select(*shape))
    return left if others is None else left.unionByName(others)
