"""MinHash near-dedup with weighted signatures by darts.

A text is a weighted set: its word five-grams with their counts (a text of fewer words is one
gram). Darts fall on the plane of every gram, with weight along one axis and a rank (time) along the other, one dart
per unit of area, from a hash of the gram: cell c of a gram covers weights c to c + 1, and its darts
come at exponential gaps of rank. A dart hits the text if its weight is below the gram's. Each dart also has one of
``COORDS`` coordinates, and each coordinate keeps its earliest dart, so two texts agree in one with the
probability of their weighted Jaccard similarity. Only ranks up to about COORDS * (ln COORDS + 2)
darts a text are thrown, and twice as far where a coordinate is still empty, so long texts cost little more than
reading them.

``BANDS`` bands of ``ROWS`` coordinates are joined. In each bucket all texts are compared with its
hub, the text that shares most buckets with others, whole texts and exact similarity. Texts that
the hub does not resemble are paired with those of the bucket that are not yet in their class,
unless the triangle inequality of the distance 1 - similarity rules that out, or sketches of
``SKETCH`` further coordinates, one bit each, put the pair more than four standard deviations under the
threshold; that condition is part of the join, as is that the bucket is the first that the pair
shares, so a hot bucket makes few rows. A bucket with more than ``CELL`` such comparisons is laid out as a grid: its texts are dealt
to rows and to columns by hash, and each cell of about that many is a key of its own. Classes are the
connected components of pairs of similarity ``threshold`` or more. At similarity 0.8 a pair shares a
bucket with probability 0.9999.

Words are runs of letters and digits in lower case. Texts of equal word sequences are one node
of the graph, so copies are never paired among themselves.

Defined cases: a null text counts as empty; texts without words are copies of each other; a null
doc_id is never the smallest where another is present; repeated rows are in the same class; an
empty table gives an empty result; other columns are ignored by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, ship, small_batches, sized, text_of, written
from .exact import filter_of, once
from .graph import components

WORDS = re.compile(r"\w+")
SHINGLE = 5
BANDS, ROWS = 30, 6
COORDS = BANDS * ROWS
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Words whose hashes a worker remembers.
REMEMBERED = 100_000
#: Coordinates of the sketches, and the margin of the similarity that they estimate.
SKETCH, MARGIN = 4096, 0.04
#: Comparisons of sketches that one key of the last join makes, about.
CELL = 1_000_000
#: Rows of node ids (under 100 bytes each) that go to every executor at most.
BROADCAST_ROWS = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
        return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of words, remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        for w in set(words).difference(known):
            known[w] = int.from_bytes(blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > REMEMBERED:
            known.clear()
        return out


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of SHINGLE words; of fewer words, of all of them; none of none."""
    n = len(hashes)
    width = min(SHINGLE, n)
    if not width:
        return hashes
    with np.errstate(over="ignore"):
        acc = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            acc = mix(acc * np.uint64(GOLDEN) + hashes[k : n - width + 1 + k])
    return acc


def weighted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and their counts as weights."""
    return np.unique(grams, return_counts=True)


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], coords: int = COORDS) -> np.ndarray:
    """(texts, coords) signatures of non-empty weighted sets (elements, weights)."""
    out = np.full(len(texts) * coords, np.iinfo(np.uint64).max, np.uint64)
    todo, reach = np.arange(len(texts)), 1.0
    aim = coords * (np.log(coords) + 2)
    total = np.array([w.sum() for _, w in texts], float)
    while len(todo):
        cells = [np.ceil(texts[i][1]).astype(np.int64) for i in todo]
        per = np.array([c.sum() for c in cells])
        text = np.repeat(todo, per)
        count = np.concatenate(cells)
        element = np.repeat(np.concatenate([texts[i][0] for i in todo]), count)
        weight = np.repeat(np.concatenate([texts[i][1] for i in todo]).astype(float), count)
        cell = np.arange(len(count.repeat(count))) - np.repeat(count.cumsum() - count, count)
        with np.errstate(over="ignore"):
            seed = mix(element + mix(cell.astype(np.uint64) * np.uint64(GOLDEN) + np.uint64(1)))
        room = weight - cell  # of a last cell only this part is the text's
        limit = (aim * reach / total)[text]
        rank, k = np.zeros(len(seed)), 0
        while len(seed):
            k += 1
            with np.errstate(over="ignore"):
                h = mix(seed + np.uint64(k) * np.uint64(GOLDEN))
                g = mix(h ^ np.uint64(MIX1))
            rank = rank - np.log(((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53)
            on = rank <= limit
            seed, text, rank, limit, room, h, g = (x[on] for x in (seed, text, rank, limit, room, h, g))
            inside = (g >> np.uint64(32)).astype(float) / 2.0**32 < room
            at = text[inside] * coords + (g[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64) % coords
            # the rank as its float bits, which sort like it, and below them bits of the dart
            dart = (rank[inside].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (h[inside] & np.uint64(0xFFFFFFFF))
            np.minimum.at(out, at, dart)
        empty = (out.reshape(-1, coords)[todo] == np.iinfo(np.uint64).max).any(1)
        todo, reach = todo[empty], reach * 2
    return out.reshape(-1, coords)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the rows of each band, as signed 64-bit numbers."""
    cut = signature[:, : BANDS * ROWS].reshape(len(signature), BANDS, ROWS)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), cut.shape[:2])
        for r in range(ROWS):
            acc = mix(acc * np.uint64(GOLDEN) + cut[:, :, r])
    return acc.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of weighted sets with sorted elements; 1 of two empty ones."""
    total = a[1].sum() + b[1].sum()
    if not total:
        return 1.0
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][x], b[1][y]).sum()
    return float(common / (total - common))


SIGNED = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def hasher() -> Hasher:
    return kept("words", Hasher)


@F.pandas_udf(SIGNED)
def signed(texts: pd.Series) -> pd.DataFrame:
    """The 16-byte digest of a text's words, and its band keys (none without words)."""
    nodes, bands, hashes_of = [], [], hasher()
    values = texts.tolist()
    at = 0
    while at < len(values):
        group, size = [], 0
        while at < len(values) and size < 1_000_000:
            words = WORDS.findall(values[at].lower())
            nodes.append(blake2b("\x00".join(words).encode("utf-8", "replace"), digest_size=16).digest())
            group.append(weighted(shingles(hashes_of(words))))
            size += len(values[at])
            at += 1
        full = [k for k, (e, _) in enumerate(group) if len(e)]
        keys = band_keys(signatures([group[k] for k in full])) if full else []
        found: list = [np.zeros(0, np.int64)] * len(group)
        for k, row in zip(full, keys, strict=True):
            found[k] = row
        bands += found
    return pd.DataFrame({"node": nodes, "bands": pd.Series(bands, dtype=object)})


@F.pandas_udf(T.DoubleType())
def exact_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    last: dict[str, tuple] = {}
    hashes_of = hasher()

    def of(text: str):
        got = last.get(text)
        if got is None:
            if len(last) > 8:
                last.pop(next(iter(last)))
            got = last[text] = weighted(shingles(hashes_of(WORDS.findall(text.lower()))))
        return got

    return pd.Series([similarity(of(x), of(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def sketched(texts: pd.Series) -> pd.Series:
    """One bit of each of SKETCH coordinates, in longs. Equal bits of two texts: (1 + similarity) / 2 of all."""
    values, out, hashes_of = texts.tolist(), [], hasher()
    for at in range(0, len(values), 50):
        sets = [weighted(shingles(hashes_of(WORDS.findall(t.lower())))) for t in values[at : at + 50]]
        bits = (mix(signatures(sets, SKETCH)) & np.uint64(1)).astype(np.uint8)
        out += list(np.packbits(bits, axis=1).view(np.int64))
    return pd.Series(out, dtype=object)


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(node, other) with the exact similarity of their whole texts."""
    left = pairs.join(texts.withColumnRenamed("text", "a"), "node")
    both = left.join(texts.select(F.col("node").alias("other"), F.col("text").alias("b")), "other")
    return both.select("node", "other", exact_similarity("a", "b").alias("similarity"))


def _maybe(rows: DataFrame, digest: Column, digests: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows that a Bloom filter of the digests may hold, and the others; all and none where the digests can be sent to every
    executor. So texts that are not wanted are not shuffled."""
    if digests.count() <= BROADCAST_ROWS:
        return rows, None
    may_hold, marked = filter_of(digests), rows.withColumn("__quarry_digest", once(digest))
    here = may_hold(F.col("__quarry_digest"))
    return marked.filter(here).drop("__quarry_digest"), marked.filter(~here).drop("__quarry_digest")


def links(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(rows, pairs): rows(doc_id, th, node) of every row of docs, pairs(node, other, similarity) that link nodes."""
    small_batches(docs.sparkSession)
    read = written(
        docs.select("doc_id", F.md5(text_of()).alias("th"), signed(text_of()).alias("s")).select("doc_id", "th", "s.node", "s.bands"),
        "signed",
    )
    rows = read.select("doc_id", "th", "node")
    nodes = read.groupBy("node").agg(F.min("th").alias("th"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = written(banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    members = written(banded.join(sized(shared, 2 * BROADCAST_ROWS), "bucket"), "members")
    busy = written(members.groupBy("node").agg(F.sum("n").alias("busy")), "busy")
    known_nodes = written(nodes.join(sized(busy, BROADCAST_ROWS), "node"), "known_nodes")
    wanted = known_nodes.select("node", F.col("th").alias("_th"))
    texts = docs.select(text_of().alias("text")).withColumn("_t", F.md5("text"))
    texts = _maybe(texts, F.col("_t"), wanted.select(F.col("_th").alias("digest")))[0]
    texts = texts.join(sized(wanted, BROADCAST_ROWS), F.col("_t") == F.col("_th"))
    texts = written(texts.select("node", "text").dropDuplicates(["node"]), "texts")
    # The hub of each bucket, and all of the bucket against it.
    placed = members.select("bucket", "node").join(busy.select("node", "busy"), "node")
    placed = written(placed, "busy_members")
    hubs = written(placed.groupBy("bucket").agg(F.max(F.struct("busy", "node")).alias("hub")).select("bucket", F.col("hub.node").alias("hub")), "hubs")
    placed = written(placed.join(hubs, "bucket").select("bucket", "node", "hub"), "placed")
    stars = written(_similar(placed.filter("node != hub").select("node", F.col("hub").alias("other")).distinct(), texts), "stars")
    linked = stars.filter(F.col("similarity") >= threshold)
    if stars.filter(F.col("similarity") < threshold).isEmpty():
        return rows, linked
    # What a hub does not resemble, against the rest of the bucket outside its class.
    root = components(linked.select(F.col("node").alias("a"), F.col("other").alias("b")))
    near = stars.select("node", F.col("other").alias("hub"), "similarity")
    known = placed.join(near, ["node", "hub"], "left").join(root, "node", "left").select(
        "bucket", "node", F.when(F.col("node") == F.col("hub"), 1.0).otherwise(F.col("similarity")).alias("near"), F.coalesce("root", "node").alias("root")
    )
    known = written(known, "known")
    # Buckets with texts that are apart from their hub, beside others than the hub.
    open_buckets = known.filter("near < 1").groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("near") < threshold).alias("odd"), F.min("root").alias("low"), F.max("root").alias("high"))
    grid = F.ceil(F.sqrt(F.col("odd").cast("double") * F.col("n") / CELL)).cast("int").alias("grid")
    open_buckets = written(open_buckets.filter("n > 1 and odd > 0 and low != high").select("bucket", grid), "open_buckets")
    left_over = written(known.filter("near < 1").join(open_buckets, "bucket"), "left_over")
    sketches = left_over.select("node").distinct().join(texts, "node").select("node", sketched("text").alias("sketch"))
    sketches = sketches.join(known_nodes.select("node", "bands"), "node")
    left_over = left_over.join(written(sketches, "sketches"), "node")
    dealt, every = F.pmod(F.xxhash64("node"), F.col("grid")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("grid") - 1))
    left_over = left_over.withColumn("dealt", dealt).withColumn("other", every)
    o = left_over.filter(F.col("near") < threshold).withColumnsRenamed({"dealt": "row", "other": "column"}).alias("o")
    m = left_over.withColumnsRenamed({"dealt": "column", "other": "row"}).alias("m")
    differing = F.aggregate(F.zip_with("o.sketch", "m.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    common = F.zip_with("o.bands", "m.bands", lambda x, y: F.when(x == y, x))
    rest = o.join(
        m,
        (F.col("o.bucket") == F.col("m.bucket")) & (F.col("o.row") == F.col("m.row")) & (F.col("o.column") == F.col("m.column"))
        & (F.col("o.root") != F.col("m.root"))
        & ((F.col("m.near") >= threshold) | (F.col("o.node") < F.col("m.node")))
        & (F.abs(F.col("o.near") - F.col("m.near")) <= 1 - threshold + 1e-9)
        & (F.get(F.filter(common, lambda x: x.isNotNull()), F.lit(0)) == F.col("o.bucket"))
        & (differing <= int(SKETCH * (1 - threshold + MARGIN) / 2)),
    )
    rest = written(rest.select(F.col("o.node").alias("node"), F.col("m.node").alias("other")).distinct(), "rest")
    if rest.isEmpty():
        return rows, linked
    more = _similar(rest, texts).filter(F.col("similarity") >= threshold)
    return rows, linked.unionByName(written(more, "more"))


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest doc_id of its class), group_size, links
    (texts of other words that its text resembles, among the pairs that were compared), kept; th is the MD5 of the text."""
    rows, pairs = links(docs, threshold)
    ends = pairs.select("node", "other").unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other")))
    degree = written(ends.distinct().groupBy("node").agg(F.count("*").alias("links")), "degree")
    root = components(pairs.select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = rows.join(sized(root, BROADCAST_ROWS), "node", "left").join(sized(degree, BROADCAST_ROWS), "node", "left").select(
        "doc_id", "th", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")
    )
    placed = written(placed, "classes")
    # Classes of one row need no join; written tables on both sides let AQE split a hot class.
    group = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"), F.count("*").alias("group_size"))
    group = written(group.filter("group_size > 1"), "groups")
    own = F.col("group_size").isNull()
    return placed.join(sized(group, BROADCAST_ROWS), "root", "left").select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        "links",
        (own | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))).alias("kept"),
        "th",
    )


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of docs for each class, that of the smallest doc_id; columns unchanged."""
    key = [F.col("doc_id").alias("__quarry_id"), F.col("th").alias("__quarry_th"), "kept"]
    every = written(classes(docs, threshold).groupBy(*key).agg(F.count("*").alias("__quarry_n")), "decisions")
    gone = written(every.filter("not kept").drop("kept", "__quarry_n"), "gone")
    some, others = _maybe(docs, F.md5(text_of()), gone.select(F.col("__quarry_th").alias("digest")))
    same = some["doc_id"].eqNullSafe(F.col("__quarry_id")) & (F.md5(text_of()) == F.col("__quarry_th"))
    left = some.join(sized(gone, BROADCAST_ROWS), same, "left_anti")
    left = left if others is None else left.unionByName(others)
    if every.filter("kept and __quarry_n > 1").isEmpty():
        return left
    # Repeated rows: one of each stays.
    marked = left.withColumn("__quarry_th", F.md5(text_of()))
    return marked.dropDuplicates(["doc_id", "__quarry_th"]).drop("__quarry_th")


ship(__name__)
