"""Tables, transactions, versions, encryption and the API."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.hashing import random_id
from quarry.plans.query import query
from quarry.sources import api, crypto
from quarry.sources import database
from quarry.sources.database import Database, TableError, forget, recover, undo_pending
from quarry.sources.numbering import chunks
from quarry.sources.schema import Column
from quarry.sources.store import Conflict, Store
from quarry.sources.versions import ChangeLog, WriteBuffer

COLUMNS = [
    Column("id", "INT64", primary_key=True, auto_increment=True), Column("name", "STRING", nullable=False), Column("xp", "INT32", default=5),
    Column("data", "JSON"), Column("at", "TIMESTAMP"),
]


@pytest.fixture
def db(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}")
    db.create_table("users", COLUMNS)
    return db


def names(db, where=None):
    return sorted(r.name for r in db.select("users", where).collect())


def test_rules_of_inserted_rows(db):
    assert db.insert("users", {"name": "a", "unknown": 1}) == 0
    assert db.insert_many("users", [{"name": "b", "id": 10, "xp": None}, {"name": "c", "data": {"k": [1]}, "at": 1700000000123}]) == [1, 2]
    rows = {r.name: r for r in db.table("users").collect()}
    assert (rows["a"].id, rows["a"].xp) == (1, 5)
    assert (rows["b"].id, rows["b"].xp) == (10, None)  # an explicit null beats the default
    assert rows["c"].id == 11 and rows["c"].data == '{"k": [1]}' and rows["c"].at.microsecond == 123000
    with pytest.raises(ValueError):
        db.insert("users", {"id": 3})
    assert db.insert_many("users", []) == []


def test_update_delete_find(db):
    db.insert_many("users", [{"name": n, "xp": i} for i, n in enumerate("abcdef")])
    assert db.update("users", {"xp": 100, "nope": 1}, query().where_lt("xp", 2)) == 2
    assert db.update("users", {"xp": 1}, {"name": "zzz"}) == 0
    assert db.find_one("users", {"xp": 100})["name"] == "a"
    assert db.find_by_id("users", "name", "f")["xp"] == 5 and db.find_by_id("users", "name", "q") is None
    assert db.delete("users", {"xp": 100}) == 2 and names(db) == list("cdef")
    assert db.count("users") == 4 and db.count("users", query().where_gt("xp", 3)) == 2
    assert db.exists("users", {"name": "c"}) and not db.exists("users", {"name": "a"})
    assert db.delete("users") == 4 and db.count("users") == 0 and names(db) == []
    assert db.insert("users", {"name": "new"}) == 6  # row ids are not used twice
    assert db.table("users").first().id == 7


def test_only_touched_files_are_rewritten(db):
    db.insert("users", {"name": "a"})
    db.insert("users", {"name": "b"})
    before = set(db._manifest("users")["files"])
    db.update("users", {"xp": 1}, {"name": "b"})
    assert len(before & set(db._manifest("users")["files"])) == 1


def test_upsert(db, spark):
    db.insert_many("users", [{"name": "a"}, {"name": "b"}])
    rows = spark.createDataFrame([(2, "B"), (9, "n")], "id long, name string")
    db.upsert("users", rows, "id")
    assert {(r.id, r.name, r.xp) for r in db.table("users").collect()} == {(1, "a", 5), (2, "B", 5), (9, "n", 5)}
    assert db.count("users") == 3


def test_transactions(db):
    with db.begin() as t:
        t.insert("users", {"name": "a"})
        assert t.select("users").count() == 1 and db.count("users") == 0
    assert db.count("users") == 1
    with pytest.raises(RuntimeError), db.begin() as t:
        t.delete("users")
        raise RuntimeError
    assert db.count("users") == 1
    with pytest.raises(TableError):
        t.commit()
    late = db.begin()
    late.update("users", {"xp": 1})
    db.insert("users", {"name": "b"})
    with pytest.raises(Conflict):
        late.commit()
    assert names(db) == ["a", "b"]
    assert {r.state for r in recover(db).collect()} == {"committed", "aborted"}
    assert forget(db, 9e12) > 0 and recover(db).count() == 0


@pytest.fixture
def two(db):
    db.create_table("logs", [Column("id", "INT64", primary_key=True), Column("what", "STRING")])
    db.insert("users", {"name": "first"})
    return db


def both(db):
    return names(db), sorted(r.what for r in db.table("logs").collect())


def started(db):
    t = db.begin()
    t.insert("logs", {"id": 1, "what": "new"})
    t.insert("users", {"name": "new"})
    return t


def states(db):
    return [r.state for r in recover(db).collect()]


def test_second_table_conflicts(two):
    """Another writer commits between the first and the second table: nothing is visible in either."""
    t, commit = started(two), two._commit

    def meanwhile(name, *how):
        if name == "users":
            commit("users", Database(two.spark, two.store.root)._inserted("users", two._manifest("users"), [{"name": "other"}])[0], "insert")
        return commit(name, *how)

    two._commit = meanwhile
    with pytest.raises(Conflict):
        t.commit()
    del two._commit
    assert both(two) == (["first", "other"], []) and states(two) == ["aborted"] and t.state == "aborted"
    two.insert("logs", {"id": 2, "what": "later"})  # past the manifest that was given up
    assert both(two) == (["first", "other"], ["later"])


@pytest.mark.parametrize("dies_at", ["users", "outcome"])
def test_death_between_tables(two, monkeypatch, dies_at):
    """The process dies after one table's manifest, or after both and before the outcome."""
    t, commit = started(two), two._commit
    if dies_at == "users":
        two._commit = lambda name, *how: commit(name, *how) if name != "users" else (_ for _ in ()).throw(KeyboardInterrupt)
    else:
        two._decide = lambda *_: (_ for _ in ()).throw(KeyboardInterrupt)
    with pytest.raises(KeyboardInterrupt):
        t.commit()
    after = Database(two.spark, two.store.root)
    assert both(after) == (["first"], []) and states(after) == ["pending"]
    with pytest.raises(Conflict):
        after.insert("logs", {"id": 3, "what": "too early"})
    monkeypatch.setattr(database, "LEASE", 0.0)
    after.insert("logs", {"id": 3, "what": "later"})  # gives the dead transaction up
    assert both(after) == (["first"], ["later"]) and states(after) == ["aborted"]
    assert not after._decide(t.id, "COMMIT")  # should it come back, it learns so
    assert after.vacuum() > 0 and both(after) == (["first"], ["later"])


def test_pending_transactions_are_undone(two):
    t = started(two)
    files = set(t.staged["logs"]["files"] + t.staged["users"]["files"]) - set(two._manifest("users")["files"])
    assert states(two) == ["pending"] and undo_pending(two) == 0
    assert undo_pending(two, older=0.0) == 1 and states(two) == ["aborted"]
    assert not any(two.store.exists(f"{n}/{f}") for n in ("logs", "users") for f in files)
    with pytest.raises(Conflict):
        t.commit()
    assert both(two) == (["first"], []) and t.state == "aborted"


def test_commit_survives_the_log(two):
    with two.begin() as t:
        t.insert("logs", {"id": 1, "what": "new"})
        t.update("users", {"name": "changed"})
    assert both(two) == (["changed"], ["new"]) and states(two) == ["committed"]
    assert forget(two, 9e12) > 0 and recover(two).count() == 0 and both(two) == (["changed"], ["new"])
    two.vacuum()
    two.insert("logs", {"id": 2, "what": "more"})
    assert both(two) == (["changed"], ["more", "new"])
    two.vacuum()
    assert both(two) == (["changed"], ["more", "new"]) and not [n for n in two.store.names("_txn") if t.id in n] == []


def test_records_of_a_wrong_checksum_are_passed_over(two):
    started(two)
    name = next(n for n in two.store.names("_wal") if not n.startswith("."))
    r = two.store.read(f"_wal/{name}")
    two.store.delete(f"_wal/{name}")
    two.store.create(f"_wal/{name}", r | {"crc": r["crc"] ^ 1})
    assert [tuple(r)[1:] for r in recover(two).collect()] == [("pending", 1)]


def test_files_are_made_once_and_whole(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.create("a/x.json", {"k": 1})
    for name in (store._name, store._rename):
        store._name = name
        with pytest.raises(Conflict):
            store.create("a/x.json", {"k": 2})
        store.create(f"a/{name.__name__}.json", {"k": 3})
        assert store.read(f"a/{name.__name__}.json") == {"k": 3}
    assert store.read("a/x.json") == {"k": 1} and [n for n in store.names("a") if not n.endswith(".crc")] == ["_name.json", "_rename.json", "x.json"]


def test_frames_are_numbered_without_gaps(db, spark):
    rows = spark.range(100).repartition(7).selectExpr("concat('n', id) AS name")
    assert db.insert_frame("users", rows) == 100 and db.insert("users", {"name": "z"}) == 100
    assert db.insert_frame("users", rows.limit(0)) == 0 and db.insert_frame("users", rows.limit(3)) == 3
    got = db.scan("users").select("_row_id", "id").collect()
    assert sorted(r._row_id for r in got) == list(range(104)) and sorted(r.id for r in got) == list(range(1, 105))
    assert db.store.names("users/_stage") == []


def test_chunks_over_many_partitions(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 AS k").repartition(9)
    got = sorted((r.k, r.chunk) for r in chunks(rows, ["k"], 30, f"file://{tmp_path}/c").collect())
    assert got == [(k, k // 30) for k in range(1000)]


def test_random_ids_differ(spark):
    ids = [r.i for r in spark.range(2000).select(random_id("T").alias("i")).collect()]
    assert len(set(ids)) == 2000


def test_catalog(db, tmp_path, spark):
    assert db.list_tables() == ["users"] and not db.create_table("users", COLUMNS)
    with pytest.raises(TableError):
        db.create_table("users", COLUMNS, if_not_exists=False)
    with pytest.raises(TableError):
        db.table("missing")
    db.insert("users", {"name": "a"})
    assert db.table_info("users")["row_count"] == 1 and db.stats().first().bytes > 0
    db.backup(f"file://{tmp_path}/backup")
    db.insert("users", {"name": "b"})
    assert db.vacuum() >= 0 and names(db) == ["a", "b"]
    with pytest.raises(TableError):
        db.drop_table("missing", if_exists=False)
    other = Database(spark, f"file://{tmp_path}/other")
    other.restore(f"file://{tmp_path}/backup")
    assert names(other) == ["a"] and other.insert("users", {"name": "z"}) == 1
    db.create_index("users", "name")
    assert db.has_index("users", "name") and names(db) == ["a", "b"]
    db.drop_index("users", "name")
    assert not db.has_index("users", "name")
    assert db.drop_table("users") and db.list_tables() == []


def test_select_honours_the_whole_query(db):
    db.insert_many("users", [{"name": n, "xp": i % 2} for i, n in enumerate("abcd")])
    q = query().where_eq("xp", 1).order_by_desc("name").limit(1).select("name")
    assert [r.name for r in db.select("users", q).collect()] == ["d"]
    assert {(r.xp, r.n) for r in db.select("users", query().group_by("xp").count(alias="n")).collect()} == {(0, 2), (1, 2)}


def test_change_log(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}", T.StructType([T.StructField("v", T.StringType())]), fanout=2)
    frame = lambda rows: spark.createDataFrame(rows, "_row_id long, v string")
    assert log.scan().count() == 0
    log.put(frame([(1, "a"), (2, "b"), (3, "c")]))
    log.delete(frame([(1, None), (3, None)]))
    log.put(frame([(1, "again")]))
    live = {(1, "again"), (2, "b")}
    see = lambda: {(r._row_id, r.v) for r in log.scan().collect()}
    assert see() == live
    while log.compact_levels():
        assert see() == live  # tombstones outlive the merge of one level
    log.compact()
    assert see() == live and log.stats().first().entries == 2
    log.delete(frame([(1, None), (2, None)]))
    log.compact()
    assert see() == set() and log.stats().first().entries == 0
    log.clear()
    assert log.get(1).count() == 0


def test_encryption(spark):
    spark.conf.set(crypto.KEY, "short")
    with pytest.raises(ValueError):
        crypto.encrypt_value(spark, F.lit("x"))
    spark.conf.set(crypto.KEY, "0123456789abcdef")
    rows = spark.createDataFrame([("plain ä",), (None,)], "v string")
    sealed = crypto.encrypt_rows(rows, ["v"])
    assert [r.v for r in crypto.decrypt_rows(sealed, ["v"]).collect()] == ["plain ä", None]
    assert [r.v for r in crypto.decrypt_rows(rows, ["v"]).collect()] == ["plain ä", None]  # no ciphertext passes through
    assert sealed.select(crypto.intact(spark, F.col("v"))).first()[0] and not rows.select(crypto.intact(spark, F.col("v"))).first()[0]


def test_api(db):
    ask = lambda action, **data: api.dispatch(db, action, data, "r1")
    assert ask("ping")["result"]["pong"] and ask("ping")["request_id"] == "r1"
    assert ask("insert", table="users", row={"name": "a"})["result"]["row_id"] == 0
    assert ask("insert_many", table="users", rows=[{"name": "b"}, {"name": "c", "at": 0}])["result"]["row_ids"] == [1, 2]
    assert ask("update", table="users", data={"xp": 7}, conditions={"name": "b"})["result"]["count"] == 1
    assert [r["name"] for r in ask("select", table="users", columns=["name"], order_by=[("name", "DESC")], limit=2)["result"]["rows"]] == ["c", "b"]
    assert ask("find_one", table="users", conditions={"name": "c"})["result"]["row"]["at"].startswith("1970")
    assert ask("find_by_id", table="users", column="id", value=99)["result"]["row"] is None
    assert ask("count", table="users")["result"]["count"] == 3 and ask("exists", table="users", conditions={"xp": 7})["result"]["exists"]
    assert ask("delete", table="users", conditions={})["result"]["count"] == 3
    assert ask("list_tables")["result"]["tables"] == ["users"] and ask("table_info", table="users")["success"] and ask("stats")["success"]
    assert ask("cluster_stats")["success"] and ask("vacuum")["success"]
    assert not ask("nonsense")["success"] and not ask("count", table="none")["success"]


def test_write_buffer(spark, tmp_path):
    """Flushes at its number of entries; reads see the buffer before the log."""
    log = ChangeLog(spark, f"file://{tmp_path}", T.StructType([T.StructField("v", T.StringType())]))
    buffer = WriteBuffer(log, entries=3)
    for i, v in ((1, "a"), (2, "b"), (1, "c"), (3, "d"), (2, None), (1, "e")):
        buffer.put(i, None if v is None else {"v": v})
    assert len(buffer.rows) == 2 and log.stats().first().entries == 3
    assert {(r._row_id, r.v) for r in buffer.scan().collect()} == {(1, "e"), (3, "d")}
    buffer.flush()
    assert not buffer.rows and {(r._row_id, r.v) for r in log.scan().collect()} == {(1, "e"), (3, "d")}
    buffer.put(3, {"v": "x"})
    buffer.put_frame(spark.createDataFrame([(3, "y"), (4, "z")], "_row_id long, v string"))
    buffer.put(4, {"v": "last"})
    assert {(r._row_id, r.v) for r in buffer.scan().collect()} == {(1, "e"), (3, "y"), (4, "last")}


def test_versions_come_from_the_registry(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}", T.StructType([T.StructField("v", T.StringType()), T.StructField("w", T.StringType())]))
    log.put(spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "_row_id long, v string, w string"))
    log.put(spark.createDataFrame([(1, "x")], "_row_id long, v string"))
    assert log._registry()[1] == 2 and {tuple(r)[0:1] + (r.v, r.w) for r in log.scan().collect()} == {(1, "x", "b"), (2, "c", "d")}
    log.compact()
    log.clear()
    assert log._next() == 3  # versions are not used twice
    late = ChangeLog(spark, f"file://{tmp_path}", T.StructType([T.StructField("v", T.StringType()), T.StructField("w", T.StringType())]))
    before = late._registry()
    log.delete(spark.createDataFrame([(1,)], "_row_id long"))
    with pytest.raises(Conflict):
        late._register(*before)
