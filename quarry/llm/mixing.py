"""Mixing sources to target weights.

The texts of a source, in an order by hash of doc_id, are one stream of words that is packed into
blocks of a fixed length. Every output shard has ``SLOTS`` slots (the last one fewer); a multinomial draw over
what each source has to give deals them to the sources. The draws go down a tree of halves: what the shards of a node take of
each source is drawn for its left half, and the right half has the rest; so every shard's counts, and the
number of each source's slots before it, come from a walk of the tree, wherever it is made, and sum to the quotas.
The slots of a source are numbered through all shards; slot i reads block P(i mod n), where P is the source's pseudorandom
permutation of its n blocks (a Feistel network that walks its cycle until it is within n) and a
block comes back only after all others of the source. Blocks are joined to slots by index.

Targets: sources by code point, null last, weigh ``weights`` in turn, and share ``share`` times all
words; no target is above ``most`` times its source, and the excess goes to the others by weight.
Sources are a table that the driver holds, about 100 bytes each; executors get 24 bytes for each.

Defined cases: a null text has no words; a null source is a source of its own, last in order; rows of a
null doc_id are spread over their source's stream by their places in the input, and so agree in reruns over the same
files; repeated rows are rows of their own; texts without words
are never taken; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, ship, sized, text_of, written

WEIGHTS = (3, 1, 2)
BLOCK = 64
#: Slots of a shard, and about how many a task makes.
SLOTS = 1 << 14
TASK_SLOTS = 1 << 18
#: Rows of a piece, about: a source's stream is summed in pieces, so that no task sorts a whole source.
PIECE_ROWS = 100_000
#: Rows of sources that go to every executor at most.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NOT_SPACE)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Target words of each source, given in order, by its size: shared by weight up to the cap."""
    total = share * sum(n for _, n in sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    capped: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(most * sizes[i][1] for i in capped)
        of = sum(weight[i] for i in free)
        over = [i for i in free if rest * weight[i] / of > most * sizes[i][1]]
        if not over:
            return [most * n if i in capped else rest * weight[i] / of for i, (_, n) in enumerate(sizes)]
        capped.update(over)


def drawn(quota: np.ndarray, slots: int, key: list[int]) -> np.ndarray:
    """A multinomial draw of slots from the quotas, which bound it: what a source cannot give is drawn again."""
    rng, out = np.random.default_rng(key), np.zeros_like(quota)
    while (short := slots - int(out.sum())) > 0:
        rest = quota - out
        out += np.minimum(rng.multinomial(short, rest / rest.sum()), rest)
    return out


def shard_counts(quota: np.ndarray, low: int, high: int, seed: int, slots: int = SLOTS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slot by source, slots by source) of the shards from low to high, exclusive."""

    def walk(a: int, b: int, first: np.ndarray, mine: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if b <= low or a >= high:
            return
        if b - a == 1:
            yield a, first, mine
            return
        middle = (a + b) // 2
        left = drawn(mine, (middle - a) * slots, [seed, a, b])
        yield from walk(a, middle, first, left)
        yield from walk(middle, b, first + left, mine - left)

    total = int(quota.sum())
    if total:
        yield from walk(0, -(-total // slots), np.zeros_like(quota), quota)


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """P(index) within 0..n-1, by element: 4 Feistel rounds over the least even number of bits, cycle walking."""
    index, n, key = (np.asarray(x, np.uint64).copy() for x in (index, n, key))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = index[todo] >> h, index[todo] & m
        with np.errstate(over="ignore"):
            for r in range(4):
                f = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(32)) & m)
        index[todo] = (left << h) | right
        todo = todo[index[todo] >= n[todo]]
    return index.astype(np.int64)


def slot_rows(ids: np.ndarray, quota: np.ndarray, blocks: np.ndarray, seed: int, slots: int = SLOTS) -> Iterator[pd.DataFrame]:
    """The slots of a run of shards, a frame for each."""
    for shard, first, n in shard_counts(quota, int(ids[0]), int(ids[-1]) + 1, seed, slots):
        source = np.repeat(np.arange(len(n)), n)
        slot = np.arange(len(source)) + np.repeat(first - (n.cumsum() - n), n)
        many = blocks[source]
        key = (seed * 1000003 + source + slot // many * 7919).view(np.uint64)
        yield pd.DataFrame({"shard": np.full(len(slot), shard, np.int64), "slot": slot, "source_no": source.astype(np.int32), "block_no": permuted(slot % many, many, key)})


def _slots(spark: SparkSession, quota: np.ndarray, blocks: np.ndarray, seed: int, slots: int) -> DataFrame:
    """shard, slot, source_no, block_no of the whole mixture."""
    shards = -(-int(quota.sum()) // slots)
    tasks = max(1, min(shards, -(-shards * slots // TASK_SLOTS)))
    shared = spark.sparkContext.broadcast((quota, blocks))

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in frames:
            if len(ids):
                yield from slot_rows(ids.id.to_numpy(), *shared.value, seed, slots)

    return spark.range(0, shards, 1, tasks).mapInPandas(made, "shard long, slot long, source_no int, block_no long")


def _sources(spark: SparkSession, pieces: DataFrame, block: int, share: float, most: float) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Per source: source_no, source, source_size, target. And the slots and the blocks of each."""
    got = pieces.groupBy("source").agg(F.sum("words").alias("size")).collect()
    sizes = [(r["source"], r["size"]) for r in sorted(got, key=lambda r: (r["source"] is None, r["source"] or ""))]
    aims = targets(sizes, share=share, most=most) if sizes else []
    blocks = np.array([-(-n // block) for _, n in sizes], np.int64)
    quota = np.minimum(np.rint(np.array([t / n * b if n else 0 for t, (_, n), b in zip(aims, sizes, blocks, strict=True)])), most * blocks)
    rows = [(i, s, n, float(t)) for i, ((s, n), t) in enumerate(zip(sizes, aims, strict=True))]
    return spark.createDataFrame(rows, "source_no int, source string, source_size long, target double"), quota.astype(np.int64), blocks


def mixture(docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 7, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(rows, slots). rows: doc_id, source, size, source_size, target, start (place in its source's
    stream), source_no, piece. slots: shard, slot, source_no, block_no."""
    spark = docs.sparkSession
    every = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size"),
        F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))).otherwise(F.xxhash64(F.col("doc_id"), F.lit(seed))).alias("at"),
    )
    every = written(every, "sized")  # texts are read once
    many = max(256, -(-every.count() // PIECE_ROWS))
    every = every.withColumn("piece", F.pmod(F.col("at"), F.lit(many)))
    pieces = written(every.groupBy("source", "piece").agg(F.sum("size").alias("words")), "pieces")
    sources, quota, blocks = _sources(spark, pieces, block, share, most)
    before = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = pieces.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    stream = Window.partitionBy("source", "piece").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    head = offset.join(sized(sources, BROADCAST_ROWS), offset["source"].eqNullSafe(sources["source"])).select(
        offset["source"].alias("_s"), F.col("piece").alias("_p"), "offset", "source_no", "source_size", "target"
    )
    rows = every.withColumn("inner", F.coalesce(F.sum("size").over(stream), F.lit(0))).join(
        head, F.col("source").eqNullSafe(F.col("_s")) & (F.col("piece") == F.col("_p"))
    )
    rows = rows.withColumn("start", F.col("offset") + F.col("inner")).drop("_s", "_p", "offset", "inner", "at")
    return rows, _slots(spark, quota, blocks, seed, slots)


def taken_words(docs: DataFrame, block: int = BLOCK, **how) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken."""
    rows, slots = mixture(docs, block=block, **how)
    rows = written(rows, "streams")
    # Catalyst takes the slots for as few as their shards; they, and what is counted from them, are no side to broadcast
    times = slots.groupBy("source_no", "block_no").agg(F.count("*").alias("times"))
    full = rows.filter("size > 0")
    parts = (
        full.select("source_no", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block_no"))
        .join(times.hint("merge"), ["source_no", "block_no"])
        .withColumn(
            "words",
            F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * block) - F.greatest("start", F.col("block_no") * block),
        )
    )
    took = parts.groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # start names a row of its source that has words
    met = full.join(took.hint("merge"), ["source_no", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    shape = ["doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return met.select(*shape).unionByName(rows.filter("size = 0").withColumn("taken", F.lit(0)).select(*shape))


def mixed(docs: DataFrame, block: int = BLOCK, **how) -> DataFrame:
    """The output itself: shard, slot, source, block_no, and the parts of documents that fill the
    block in order: parts array<(start, doc_id, first, words)>, words counted within the document."""
    rows, slots = mixture(docs, block=block, **how)
    parts = (
        rows.filter("size > 0")
        .select("source_no", "source", "doc_id", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block_no"))
        .withColumn("first", F.greatest(F.lit(0), F.col("block_no") * block - F.col("start")))
        .withColumn("words", F.least(F.col("size"), (F.col("block_no") + 1) * block - F.col("start")) - F.col("first"))
        .groupBy("source_no", "block_no")
        .agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("start", "doc_id", "first", "words"))).alias("parts"))
    )
    return slots.hint("merge").join(parts, ["source_no", "block_no"]).select("shard", "slot", "source", "block_no", "parts")


ship(__name__)
