import re
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.llm import exact

from .helpers import ODD, documents


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for i, t in rows:
        ids = groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep and not groups.get(("kept", t and re.sub(r"[\x20\x09-\x0D]+", " ", t) or ""))))
        if out[-1][3]:  # of equal rows of the smallest doc_id one is kept
            groups["kept", t and re.sub(r"[\x20\x09-\x0D]+", " ", t) or ""] = [True]
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()], key=repr)


def test_odd_rows(spark):
    assert got(exact.decisions(documents(spark, ODD))) == brute(ODD)


def test_digest_collisions_are_found_by_bytes(spark):
    """A digest of one hex digit: many texts share it without being equal."""
    rows = [(i, f"text {i % 40}") for i in range(200)]
    poor = lambda text: F.substring(F.sha2(text, 256), 1, 1)
    assert got(exact.decisions(documents(spark, rows), poor)) == brute(rows)
    assert sorted(r.doc_id for r in exact.drop_copies(documents(spark, rows), poor).collect()) == list(range(40))


def test_drop_copies_keeps_columns_and_one_row(spark):
    docs = documents(spark, ODD).withColumn("digest", F.lit("clash")).withColumn("keep_id", F.lit(0))
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == [1, 3, 4, 6, 7]  # null counts as empty and stays before the empty text of row 2


def test_empty_table(spark):
    docs = documents(spark, [])
    assert exact.decisions(docs).count() == 0 and exact.drop_copies(docs).count() == 0


def test_index_levels_and_lookup(spark):
    """Memtables of two rows in 5 batches: compaction merges runs by two, level after level."""
    index = exact.DigestIndex(spark, fanout=2, memtable=2)
    batches = [[(i, f"t{i % 7}") for i in range(k, k + 10)] for k in range(0, 50, 10)]
    for b in batches:
        index.flush(spark.createDataFrame(b, "doc_id long, text string").repartition(2).select(F.sha2("text", 256).alias("digest"), "doc_id"))
    assert max(index.levels) >= 2 and 0 not in index.levels
    want = {
        r.digest: (r.k, r.n)
        for r in spark.createDataFrame([x for b in batches for x in b], "doc_id long, text string").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("k"), F.count("*").alias("n")).collect()
    }
    assert {r.digest: (r.keep_id, r.n) for r in index.entries().collect()} == want
    index.compact_all()
    assert [n for batches in index.levels.values() for _, n in batches] == [1]
    assert {r.digest: (r.keep_id, r.n) for r in index.entries().collect()} == want
    probe = spark.createDataFrame([("t3",), ("new",)], "text string").select(F.sha2("text", 256).alias("digest"), "text")
    assert {r.text: r.keep_id for r in index.lookup(probe).collect()} == {"t3": 3, "new": None}


def test_runs_are_sorted_files(spark):
    index = exact.DigestIndex(spark, fanout=100, memtable=50)
    index.flush(documents(spark, [(i, f"text {i}") for i in range(400)]).repartition(2).select(F.sha2("text", 256).alias("digest"), "doc_id"))
    ((at, runs),) = index.levels[0]
    rows = spark.read.parquet(at).select("digest", "run", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("k")).orderBy("file", "k").collect()
    assert runs == len({r.run for r in rows}) == len({r.file for r in rows}) >= 8
    assert [(r.file, r.digest) for r in rows] == sorted((r.file, r.digest) for r in rows)


def test_filter_knows_what_it_holds(spark):
    held = documents(spark, [(i, f"text {i}") for i in range(2000)]).select(F.sha2("text", 256).alias("digest"))
    other = documents(spark, [(i, f"other {i}") for i in range(2000)]).select(F.sha2("text", 256).alias("digest"))
    may_hold = exact.filter_of(held)
    assert held.filter(~may_hold(F.col("digest"))).count() == 0 and other.filter(may_hold(F.col("digest"))).count() < 20
    none = exact.filter_of(held.limit(0))
    assert held.filter(none(F.col("digest"))).count() == 0


def test_one_row_of_ties_is_kept(spark):
    rows = [(3, "a b")] * 5 + [(3, "a  b"), (4, "a\tb"), (None, "c"), (None, "c")]
    out = exact.decisions(documents(spark, rows)).filter("kept").collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in out), key=repr) == [(3, 3, 7), (None, None, 2)]
    assert exact.drop_copies(documents(spark, rows)).count() == 2


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_ROWS", 0)
    rows = [(i, f"text {i % 30}") for i in range(90)] + [(500 + i, f"alone {i}") for i in range(50)] + [(7, "twice"), (7, "twice"), (None, "twice")]
    docs = documents(spark, rows)
    assert got(exact.decisions(docs)) == brute(rows)
    assert sorted(r.doc_id for r in exact.drop_copies(docs).collect()) == sorted([*range(30), *range(500, 550), 7])
