"""Queries of tables: DML, transactions, versions, encryption, API, domain rules, streams."""

from __future__ import annotations

import contextlib
import json
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import documents as D
from quarry.functions import numbers
from quarry.operators import detect, domain, folds, joins, metrics
from quarry.sources import api, crypto
from quarry.sources.database import Database, forget, recover
from quarry.sources.numbering import chunks
from quarry.sources.schema import Column
from quarry.sources.service import Service
from quarry.sources.store import Conflict, scratch
from quarry.sources.versions import ChangeLog, WriteBuffer, compacted_changes
from quarry.streaming import stateful

from . import recurrence_sql
from .q_events import events, trailing_actions
from .query import query
from .registry import load, register


CUSTOMER = [
    Column("c_custkey", "INT64", nullable=False, primary_key=True), Column("c_name", "STRING"), Column("c_nationkey", "INT32", indexed=True),
    Column("c_acctbal", "FLOAT64", default=0.0), Column("c_mktsegment", "STRING", default="NONE"),
]
ALL = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def customers(spark: SparkSession, sf_dir: str, partition_key: str | None = None) -> Database:
    db = Database(spark, scratch(spark, "db"))
    db.create_table("customer", CUSTOMER, partition_key=partition_key)
    db.insert_frame("customer", load(spark, sf_dir, "customer"))
    return db


@register("dml_insert", f"SELECT {ALL} FROM customer UNION ALL SELECT -1, 'New', 3, 0.0, 'NONE'")
def dml_insert(spark, sf_dir):
    """A row with defaults, and a key that the table lacks."""
    db = customers(spark, sf_dir)
    db.insert("customer", {"c_custkey": -1, "c_name": "New", "c_nationkey": 3, "unknown": 9})
    return db.table("customer")


@register("dml_update", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 5 THEN 1.5 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 5 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update(spark, sf_dir):
    db = customers(spark, sf_dir)
    db.update("customer", {"c_acctbal": 1.5, "c_mktsegment": "VIP", "unknown": 1}, {"c_nationkey": 5})
    return db.table("customer")


@register("dml_delete", f"SELECT {ALL} FROM customer WHERE c_nationkey >= 10")
def dml_delete(spark, sf_dir):
    db = customers(spark, sf_dir)
    db.delete("customer", query().where_lt("c_nationkey", 10))
    return db.table("customer")


@register("dml_truncate", f"SELECT {ALL} FROM customer WHERE false")
def dml_truncate(spark, sf_dir):
    db = customers(spark, sf_dir)
    db.delete("customer")
    return db.table("customer")


@register(
    "dml_upsert",
    "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'changed' ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer "
    "UNION ALL SELECT -c_custkey - 1, 'added', 1, 0.0, 'NONE' FROM customer WHERE c_custkey % 20 = 0",
)
def dml_upsert(spark, sf_dir):
    base = load(spark, sf_dir, "customer")
    changed = base.filter("c_custkey % 10 = 0").withColumn("c_name", F.lit("changed"))
    added = base.filter("c_custkey % 20 = 0").select((-F.col("c_custkey") - 1).alias("c_custkey"), F.lit("added").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(0.0).alias("c_acctbal"), F.lit("NONE").alias("c_mktsegment"))
    db = customers(spark, sf_dir)
    db.upsert("customer", changed.unionByName(added), "c_custkey")
    return db.table("customer")


@register("dml_soft_delete", "SELECT c_custkey FROM customer WHERE c_nationkey <> 4")
def dml_soft_delete(spark, sf_dir):
    db = customers(spark, sf_dir)
    db.update("customer", {"c_mktsegment": "inactive"}, {"c_nationkey": 4})
    return db.select("customer", query().select("c_custkey").where_ne("c_mktsegment", "inactive"))


@register("txn_commit", "SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN 'T' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_nationkey <> 2")
def txn_commit(spark, sf_dir):
    db = customers(spark, sf_dir)
    with db.begin() as t:
        t.update("customer", {"c_mktsegment": "T"}, {"c_nationkey": 1})
        t.delete("customer", {"c_nationkey": 2})
    return db.table("customer").select("c_custkey", "c_mktsegment")


@register("txn_rollback", f"SELECT {ALL} FROM customer")
def txn_rollback(spark, sf_dir):
    db = customers(spark, sf_dir)
    t = db.begin()
    t.delete("customer")
    t.rollback()
    return db.table("customer")


@register("txn_recover", "SELECT * FROM (VALUES ('aborted', 1::BIGINT), ('committed', 2), ('pending', 1)) v(state, operations)")
def txn_recover(spark, sf_dir):
    db = customers(spark, sf_dir)
    with db.begin() as t:
        t.insert("customer", {"c_custkey": -5})
        t.insert("customer", {"c_custkey": -6})
    t = db.begin()
    t.insert("customer", {"c_custkey": -7})
    t.rollback()
    db.begin().insert("customer", {"c_custkey": -8})
    return recover(db).select("state", "operations")


@register("txn_two_tables", "SELECT 'customer' AS name, c_custkey AS id, CASE WHEN c_nationkey = 1 THEN 'T' ELSE c_mktsegment END AS what FROM customer UNION ALL SELECT 'audit', count(*), 'changed' FROM customer WHERE c_nationkey = 1")
def txn_two_tables(spark, sf_dir):
    """Of three transactions over two tables one commits, one loses its second table to another writer, one dies before its outcome."""
    db = customers(spark, sf_dir)
    db.create_table("audit", [Column("id", "INT64"), Column("what", "STRING")])
    with db.begin() as t:
        n = t.update("customer", {"c_mktsegment": "T"}, {"c_nationkey": 1})
        t.insert("audit", {"id": n, "what": "changed"})
    late = db.begin()
    late.insert("audit", {"id": -1, "what": "late"})
    late.delete("customer", {"c_nationkey": 3})
    db.update("customer", {"c_acctbal": 0.0}, {"c_nationkey": 4})
    with contextlib.suppress(Conflict):
        late.commit()
    dead = db.begin()
    dead.insert("audit", {"id": -2, "what": "dead"})
    dead.delete("customer")
    for name in ("audit", "customer"):
        db._commit(name, dead.staged[name], "transaction", dead.id)
    rows = db.table("customer").select(F.lit("customer").alias("name"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("what"))
    return rows.unionByName(db.table("audit").select(F.lit("audit").alias("name"), "id", "what"))


@register("dml_insert_many", f"SELECT {ALL} FROM customer UNION ALL SELECT * FROM (VALUES (-1, 'one', 3, 0.0, 'NONE'), (-2, 'two', 4, 0.0, 'X')) v")
def dml_insert_many(spark, sf_dir):
    """Rows of one batch, in one commit."""
    db = customers(spark, sf_dir)
    ids = db.insert_many("customer", [{"c_custkey": -1, "c_name": "one", "c_nationkey": 3}, {"c_custkey": -2, "c_name": "two", "c_nationkey": 4, "c_mktsegment": "X"}])
    return db.table("customer") if len(set(ids)) == 2 and db.table_info("customer")["version"] == 2 else db.table("customer").limit(0)


@register("src_drop_table", "SELECT 'customer' AS name, true AS gone, 1::BIGINT AS left_over")
def drop_table(spark, sf_dir):
    """A dropped table is in no list; another one stays; dropping it again is no error unless it must exist."""
    db = customers(spark, sf_dir)
    db.create_table("other", CUSTOMER)
    first, again = db.drop_table("customer"), db.drop_table("customer")
    return spark.createDataFrame([("customer", first and not again and not db.table_exists("customer"), len(db.list_tables()))], "name string, gone boolean, left_over long")


@register("agg_table_count", "SELECT count(*) AS everything, count(*) FILTER (c_nationkey < 5) AS some FROM customer WHERE c_nationkey <> 7")
def table_count(spark, sf_dir):
    """All rows as the manifest knows them, after a delete; with conditions, counted."""
    db = customers(spark, sf_dir)
    db.delete("customer", {"c_nationkey": 7})
    return spark.createDataFrame([(db.count("customer"), db.count("customer", query().where_lt("c_nationkey", 5)))], "everything long, some long")


@register("txn_forget", "SELECT 0::BIGINT AS remembered, count(*) AS rows FROM customer WHERE c_nationkey <> 2")
def txn_forget(spark, sf_dir):
    """Old records of the log go; what was committed stays visible."""
    db = customers(spark, sf_dir)
    with db.begin() as t:
        t.delete("customer", {"c_nationkey": 2})
    forget(db, float("inf"))
    return db.table("customer").agg(F.lit(recover(db).count()).cast("long").alias("remembered"), F.count("*").alias("rows"))


@register("src_time_travel", f"SELECT {ALL} FROM customer")
def time_travel(spark, sf_dir):
    """The version before a delete is still there."""
    db = customers(spark, sf_dir)
    db.delete("customer", query().where_gt("c_custkey", 10))
    return db.table("customer", version=1)


@register("src_backup_restore", f"SELECT {ALL} FROM customer")
def backup_restore(spark, sf_dir):
    db, to = customers(spark, sf_dir), scratch(spark, "backup")
    db.backup(to)
    db.delete("customer")
    db.restore(to)
    return db.table("customer")


@register("src_vacuum", f"SELECT {ALL} FROM customer WHERE c_custkey > 20")
def vacuum(spark, sf_dir):
    db = customers(spark, sf_dir)
    db.delete("customer", query().where_le("c_custkey", 20))
    db.vacuum()
    return db.table("customer")


@register("src_stats", "SELECT 'customer' AS name, 5 AS columns, count(*) AS row_count, 'c_custkey,c_nationkey' AS indexes FROM customer")
def stats(spark, sf_dir):
    return customers(spark, sf_dir).stats().select("name", "columns", "row_count", "indexes")


@register("src_partition_select", f"SELECT {ALL} FROM customer WHERE c_nationkey = 7")
def partition_select(spark, sf_dir):
    return customers(spark, sf_dir, "c_nationkey").select("customer", partition_value=7)


@register("idx_point", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 6 ORDER BY c_custkey LIMIT 1")
def index_point(spark, sf_dir):
    db = customers(spark, sf_dir)
    db.create_index("customer", "c_nationkey")
    return db.select("customer", query().select("c_custkey", "c_name").where_eq("c_nationkey", 6).order_by("c_custkey").limit(1))


@register("idx_range", "SELECT c_custkey FROM customer WHERE c_nationkey BETWEEN 3 AND 6")
def index_range(spark, sf_dir):
    db = customers(spark, sf_dir)
    db.create_index("customer", "c_nationkey")
    return db.select("customer", query().select("c_custkey").where_between("c_nationkey", 3, 6))


@register("idx_entries", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def index_entries(spark, sf_dir):
    return customers(spark, sf_dir).index_entries("customer", "c_nationkey").select("c_nationkey", F.size("row_ids").cast("long").alias("n"))


@register("api_select", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey DESC LIMIT 5")
def api_select(spark, sf_dir):
    db = customers(spark, sf_dir)
    reply = api.dispatch(db, "select", {"table": "customer", "conditions": {"c_nationkey": 3}, "columns": ["c_custkey", "c_name"], "order_by": [("c_custkey", "DESC")], "limit": 5})
    return spark.createDataFrame([(r["c_custkey"], r["c_name"]) for r in reply["result"]["rows"]], "c_custkey long, c_name string")


# Versions.
def _log(spark: SparkSession, sf_dir: str) -> ChangeLog:
    base = load(spark, sf_dir, "events").select(F.col("event_id").alias("_row_id"), "event_type", F.col("event_id").alias("n"))
    log = ChangeLog(spark, scratch(spark, "log"), base.drop("_row_id").schema)
    log.put(base)
    log.put(base.filter("_row_id % 3 = 0").select("_row_id", F.lit("changed").alias("event_type")))
    log.delete(base.filter("_row_id % 5 = 0"))
    log.put(base.filter("_row_id % 10 = 0").withColumn("event_type", F.lit("again")))
    return log


LIVE = "SELECT event_id AS _row_id, CASE WHEN event_id % 10 = 0 THEN 'again' WHEN event_id % 3 = 0 THEN 'changed' ELSE event_type END AS event_type, event_id AS n FROM events WHERE event_id % 5 <> 0 OR event_id % 10 = 0"


@register("mor_latest", LIVE)
def mor_latest(spark, sf_dir):
    return _log(spark, sf_dir).scan().select("_row_id", "event_type", "n")


@register("mor_range", LIVE.replace("WHERE", "WHERE event_id BETWEEN 100 AND 300 AND (") + ")")
def mor_range(spark, sf_dir):
    return _log(spark, sf_dir).scan(100, 300).select("_row_id", "event_type", "n")


@register("mor_get", LIVE.replace("WHERE", "WHERE event_id = 42 AND (") + ")")
def mor_get(spark, sf_dir):
    return _log(spark, sf_dir).get(42).select("_row_id", "event_type", "n")


@register("mor_find", f"SELECT * FROM ({LIVE}) WHERE n = 77 LIMIT 1")
def mor_find(spark, sf_dir):
    return _log(spark, sf_dir).find_by_column("n", "77").select("_row_id", "event_type", "n")


@register("mor_compact", LIVE)
def mor_compact(spark, sf_dir):
    log = _log(spark, sf_dir)
    log.compact()
    return log.scan().select("_row_id", "event_type", "n")


@register("mor_levels", LIVE)
def mor_levels(spark, sf_dir):
    log = _log(spark, sf_dir)
    while log.compact_levels():
        pass
    return log.scan().select("_row_id", "event_type", "n")


@register("mor_stats", "SELECT count(*) + count(*) FILTER (event_id % 3 = 0) + count(*) FILTER (event_id % 5 = 0) + count(*) FILTER (event_id % 10 = 0) AS entries, count(*) AS row_ids, count(*) FILTER (event_id % 5 = 0) AS tombstones, min(event_id) AS min_row_id, max(event_id) AS max_row_id FROM events")
def mor_stats(spark, sf_dir):
    return _log(spark, sf_dir).stats()


@register("mor_sources", "SELECT event_id AS _row_id, CASE WHEN event_id % 2 = 0 THEN 'memory' ELSE event_type END AS event_type FROM events")
def mor_sources(spark, sf_dir):
    """A newer source hides an older one's rows whatever their versions."""
    disk = load(spark, sf_dir, "events").select(F.col("event_id").alias("_row_id"), F.lit(9).cast("long").alias("_version"), F.lit(False).alias("_deleted"), "event_type")
    memory = disk.filter("_row_id % 2 = 0").withColumns({"event_type": F.lit("memory"), "_version": F.lit(1).cast("long")})
    return compacted_changes([memory, disk]).drop("_deleted")


@register("src_encrypt", "SELECT n_nationkey, n_name, true AS intact, true AS hidden FROM nation")
def encrypt(spark, sf_dir):
    spark.conf.set(crypto.KEY, "0123456789abcdef")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sealed = crypto.encrypt_rows(nation, ["n_name"]).withColumn("seal", F.col("n_name"))
    opened = crypto.decrypt_rows(sealed, ["n_name"])
    return opened.select("n_nationkey", "n_name", crypto.intact(spark, F.col("seal")).alias("intact"), (F.col("seal") != F.col("n_name")).alias("hidden"))


@register("src_json_backup", "SELECT n_nationkey, n_name FROM nation")
def json_backup(spark, sf_dir):
    path = scratch(spark, "json")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nation.write.json(path)
    return spark.read.schema(nation.schema).json(path)


@register("src_checksum", "SELECT n_nationkey, sha256(n_nationkey || '|' || n_name || '|' || n_regionkey) AS checksum FROM nation")
def checksum(spark, sf_dir):
    """A checksum per row of all columns."""
    return load(spark, sf_dir, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey"), 256).alias("checksum"))


@register("src_scan_range", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def scan_range(spark, sf_dir):
    """A range of keys, pruned by the statistics of row groups."""
    return query().select("o_orderkey").where_between("o_orderkey", 100, 200).execute(load(spark, sf_dir, "orders"))


@register("mor_buffer", LIVE.replace("'again'", "'buffer'"))
def mor_buffer(spark, sf_dir):
    """Buffered changes come before those of the log."""
    log = _log(spark, sf_dir)
    buffer = WriteBuffer(log, entries=400)
    buffer.put_frame(load(spark, sf_dir, "events").filter("event_id % 10 = 0").select(F.col("event_id").alias("_row_id"), F.lit("buffer").alias("event_type"), F.col("event_id").alias("n")))
    buffer.put(10, {"event_type": "last", "n": 10})
    buffer.put(10, {"event_type": "buffer", "n": 10})
    return buffer.scan().select("_row_id", "event_type", "n")


@register("map_merge", """SELECT event_id, '{"a":{"x":1,"y":3},"k":{"z":1},"props":{"k":' || json_extract_string(props, '$.k') || '}}' AS merged FROM events""")
def map_merge(spark, sf_dir):
    """Objects merged recursively."""
    base = F.concat(F.lit('{"a": {"x": 1, "y": 2}, "k": 0, "props": '), F.col("props"), F.lit("}"))
    return load(spark, sf_dir, "events").select("event_id", D.merged(base, F.lit('{"a": {"y": 3}, "k": {"z": 1}}')).alias("merged"))


@register("map_flat_override", "SELECT event_id, CASE WHEN event_type = 'a' THEN 1 ELSE 5 END::BIGINT AS b FROM events")
def map_flat(spark, sf_dir):
    base, override = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(5))
    return load(spark, sf_dir, "events").select("event_id", D.flat_override(base, override)["b"].cast("long").alias("b"))


@register("jsn_defaults", "SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k, true AS enabled, 5::BIGINT AS threshold FROM events")
def json_defaults(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", D.with_defaults(F.col("props"), {"k": 0, "enabled": True, "threshold": 5}).alias("s"))
    return rows.select("event_id", "s.*")


@register("jsn_round_trip", "SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def json_round_trip(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.from_json("props", "k long").alias("s"))).alias("j"))
    return rows.select("event_id", F.from_json("j", "s struct<k:long>")["s"]["k"].alias("k"))


@register("srt_chunks", "SELECT n_nationkey, ((row_number() OVER (ORDER BY n_nationkey) - 1) // 7)::BIGINT AS chunk FROM nation")
def chunks_of(spark, sf_dir):
    """Chunks of seven of an ordered table."""
    return chunks(load(spark, sf_dir, "nation"), ["n_nationkey"], 7, scratch(spark, "chunks")).select("n_nationkey", "chunk")


@register(
    "hsh_crc32",
    "SELECT n_nationkey, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(n_name[k])::BIGINT for k in range(1, length(n_name) + 1)]), "
    "lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [k::BIGINT for k in range(0, 8)]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))::BIGINT AS crc FROM nation",
)
def crc(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", F.crc32(F.col("n_name").cast("binary")).alias("crc"))


@register("dom_service", "SELECT user_id, sum(15 + event_id % 11)::BIGINT AS total_xp FROM events WHERE user_id % 7 = 2 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def service_board(spark, sf_dir):
    """Levels saved in one commit, then the guild's board."""
    service = Service(Database(spark, scratch(spark, "service")))
    rows = events(spark, sf_dir).groupBy("guild_id", "user_id").agg(F.sum(15 + F.col("event_id") % 11).alias("total_xp"))
    service.save_all("user_levels", rows.withColumn("id", F.concat_ws("_", "guild_id", "user_id")))
    return service.leaderboard(2).select("user_id", "total_xp")


@register(
    "dom_configs",
    "SELECT n_nationkey AS guild_id, CASE WHEN n_regionkey = 2 THEN 2 ELSE 1 END::BIGINT AS rules, CASE WHEN n_regionkey = 2 THEN 'p' || n_name ELSE 'default' END AS first_pattern, n_regionkey <> 3 AS logs FROM nation WHERE n_nationkey < 8",
)
def configs(spark, sf_dir):
    """Filter and log documents of guilds saved, changed for a region, and read back."""
    service, now = Service(Database(spark, scratch(spark, "service"))), datetime(2024, 1, 1)
    default = {"rules": [{"id": "d", "pattern": "default"}]}
    first = load(spark, sf_dir, "nation").filter("n_nationkey < 8")
    changed = F.col("n_regionkey") == 2
    data = F.when(changed, F.concat(F.lit('{"rules": [{"id": "a", "pattern": "p'), "n_name", F.lit('"}, {"id": "b", "pattern": "x"}]}'))).otherwise(F.lit(json.dumps(default)))
    service.save_all("filter_configs", first.select(F.col("n_nationkey").cast("long").alias("guild_id"), F.lit(now).alias("updated_at"), data.alias("data")))
    service.save_log_config(0, {"enabled": False}, now)
    logs = first.select(F.col("n_nationkey").cast("long").alias("guild_id"), (F.col("n_regionkey") != 3).alias("enabled"), F.lit(now).alias("updated_at"))
    service.save_all("log_configs", logs)
    rules = F.from_json("data", "rules array<struct<id:string,pattern:string>>")["rules"]
    kept = service.db.table("filter_configs").select("guild_id", F.size(rules).cast("long").alias("rules"), F.get(rules, 0)["pattern"].alias("first_pattern"))
    return kept.join(service.db.table("log_configs").select("guild_id", F.col("enabled").alias("logs")), "guild_id").withColumn("guild_id", F.col("guild_id").cast("int"))


@register("dom_guilds", "SELECT n_nationkey::BIGINT AS guild_id, CASE WHEN n_nationkey = 3 THEN 2 ELSE 0 END AS case_counter, CASE WHEN n_nationkey = 3 THEN 1 ELSE 0 END AS ticket_counter, '[]' AS filter_rules FROM nation")
def guilds(spark, sf_dir):
    """Guilds saved at once with their defaults; one asked for, whose counters go on."""
    service, now = Service(Database(spark, scratch(spark, "service"))), datetime(2024, 1, 1)
    rows = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("guild_id"), F.lit(now).alias("created_at"))
    service.save_all("guilds", rows)
    numbers_of = [service.next_number(3, c, now) for c in ("case_counter", "ticket_counter", "case_counter")]
    found = service.db.table("guilds").select("guild_id", "case_counter", "ticket_counter", "filter_rules")
    return found if numbers_of == [1, 1, 2] else found.limit(0)


@register("dom_users", "SELECT c_nationkey || '_' || c_custkey AS id, c_custkey AS user_id, c_nationkey::BIGINT AS guild_id, CASE WHEN c_custkey = 9 THEN '{\"xp\": 5}' ELSE '{}' END AS data FROM customer")
def users(spark, sf_dir):
    """Users saved at once; one got by guild and id, changed and saved."""
    service, now = Service(Database(spark, scratch(spark, "service"))), datetime(2024, 1, 1)
    rows = load(spark, sf_dir, "customer").select(F.concat_ws("_", "c_nationkey", "c_custkey").alias("id"), F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("guild_id"))
    service.save_all("users", rows)
    nine = service.db.find_one("users", {"user_id": 9})
    known = service.user(9, nine["guild_id"], now)
    service.save("users", {"id": known["id"], "data": {"xp": 5}, "updated_at": now})
    return service.db.table("users").select("id", "user_id", "guild_id", "data")


@register("dom_hosts", "SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey = 5 THEN 'online' ELSE 'pending' END AS last_status FROM supplier WHERE s_nationkey % 3 = 1 AND s_suppkey <> 4")
def hosts(spark, sf_dir):
    """Host checks of a guild: one has a new status, one is removed."""
    service, now = Service(Database(spark, scratch(spark, "service"))), datetime(2024, 1, 1)
    rows = load(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_nationkey") % 3).cast("long").alias("guild_id"), F.col("s_name").alias("name"), F.lit("pending").alias("last_status"), F.lit(True).alias("is_active")
    )
    service.save_all("host_checks", rows)
    service.set_host("s5", "online", now)
    service.remove_host("s4")
    return service.hosts(1).select("id", "last_status")


@register("dom_metrics", "SELECT event_id % 3 AS shard_id, event_type AS metric_type, event_id::DOUBLE AS value FROM events WHERE event_id % 3 = 1 AND event_type = 'click' ORDER BY ts DESC LIMIT 20")
def service_metrics(spark, sf_dir):
    """The newest metrics of a shard and kind."""
    service = Service(Database(spark, scratch(spark, "service")))
    rows = load(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), (F.col("event_id") % 3).cast("int").alias("shard_id"), F.col("event_type").alias("metric_type"), F.col("event_id").cast("double").alias("value"), F.col("ts").cast("timestamp").alias("timestamp")
    )
    service.save_all("metrics", rows)
    return service.metrics(1, "click", 20).select(F.col("shard_id").cast("long").alias("shard_id"), "metric_type", "value")


@register("dom_nicknames", "SELECT 7::BIGINT AS user_id, 'nick of 7' AS nickname")
def nicknames(spark, sf_dir):
    """Secret users saved, renamed and deleted; one found by nickname."""
    service, now = Service(Database(spark, scratch(spark, "service"))), datetime(2024, 1, 1)
    users = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("old").alias("nickname"), F.lit(now).alias("created_at"))
    service.save_all("secret_users", users)
    service.save_all("secret_users", users.withColumn("nickname", F.concat(F.lit("nick of "), F.col("user_id").cast("string"))))
    service.delete_secret_user(8)
    found = service.secret_user_by_nickname("nick of 7")
    gone = service.secret_user(8)
    return spark.createDataFrame([(found["user_id"], found["nickname"])] if gone is None else [], "user_id long, nickname string")


@register("join_case_users", "SELECT o_orderkey AS case_id, c_name AS user FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey % 3 = o_custkey % 3")
def case_users(spark, sf_dir):
    cases = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 3).alias("guild_id"), F.col("o_custkey").alias("target_id"))
    users = load(spark, sf_dir, "customer").select((F.col("c_nationkey") % 3).alias("guild_id"), F.col("c_custkey").alias("user_id"), F.col("c_name").alias("data"))
    return joins.cases_with_users(cases, users).select("case_id", "user")


@register(
    "join_ticket_creators",
    "SELECT o_orderkey AS ticket_id, c_name AS creator FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey % 3 = o_custkey % 3 WHERE o_orderstatus IN ('O', 'P')",
)
def ticket_creators(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ticket_id"), (F.col("o_custkey") % 3).alias("guild_id"), F.col("o_custkey").alias("creator_id"), F.col("o_orderstatus").alias("status"))
    users = load(spark, sf_dir, "customer").select((F.col("c_nationkey") % 3).alias("guild_id"), F.col("c_custkey").alias("user_id"), F.col("c_name").alias("data"))
    return joins.tickets_with_creators(rows, users, ["O", "P"]).select("ticket_id", "creator")


@register(
    "met_members",
    "SELECT c_nationkey AS guild_id, count(*) AS members, count(*) FILTER (c_custkey % 4 <> 0) AS humans, count(*) FILTER (c_custkey % 4 = 0) AS bots, count(*) FILTER (c_mktsegment <> 'BUILDING') AS online FROM customer GROUP BY 1",
)
def members(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("guild_id"), (F.col("c_custkey") % 4 == 0).alias("is_bot"), F.when(F.col("c_mktsegment") == "BUILDING", "offline").otherwise("idle").alias("status"))
    return metrics.member_totals(rows)


@register("met_bot", "SELECT count(*) AS guilds, sum(s_suppkey)::BIGINT AS members, sum(s_nationkey)::BIGINT AS channels FROM supplier")
def bot(spark, sf_dir):
    return metrics.bot_totals(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("member_count"), F.col("s_nationkey").alias("channel_count")))


@register("dat_dead", "SELECT event_id, epoch_us(TIMESTAMP '2024-01-15') - epoch_us(ts) > 15000000 AS dead FROM events")
def dead_nodes(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", numbers.dead(F.col("ts"), F.lit("2024-01-15").cast("timestamp")).alias("dead"))


@register(
    "jsn_models",
    "SELECT event_id, 'open' AS status, (json_extract_string(props, '$.k'))::INTEGER AS priority, event_id AS guild_id, 0 AS n_tags, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 10 END AS joins, 0.7 AS caps, 'No reason provided' AS reason, event_type AS action, "
    "true AS same FROM events",
)
def models(spark, sf_dir):
    """Documents of three models from their JSON, with defaults, and back."""
    rows = load(spark, sf_dir, "events")
    ticket = D.decoded(F.format_string('{"guild_id": %d, "priority": %s, "unknown": 1}', "event_id", F.get_json_object("props", "$.k")), "ticket")
    guild = D.decoded(F.when(F.col("event_id") % 2 == 0, '{"settings": {"anti_raid": {"join_threshold": 3}}}'), "guild")
    case = D.decoded(F.to_json(F.struct(F.col("event_type").alias("action"))), "case")
    rows = rows.select("event_id", ticket.alias("t"), guild.alias("g"), case.alias("c"))
    same = F.lit(True)
    for column, model in (("t", "ticket"), ("g", "guild"), ("c", "case")):
        same = same & (F.to_json(D.decoded(D.encoded(F.col(column)), model)) == F.to_json(column))
    return rows.select(
        "event_id", "t.status", "t.priority", "t.guild_id", F.size("t.tags").alias("n_tags"), F.col("g.settings.anti_raid.join_threshold").alias("joins"),
        F.col("g.settings.automod.caps_threshold").cast("decimal(2,1)").alias("caps"), "c.reason", "c.action", same.alias("same"),
    )


# Domain rules.
@register(
    "dom_permissions",
    "SELECT event_id, CASE WHEN user_id IN (1) THEN 'BOT_OWNER' WHEN user_id = guild_id THEN 'SERVER_OWNER' WHEN event_id % 11 = 0 OR event_id % 9 IN (4) THEN 'ADMIN' WHEN event_id % 9 IN (5, 6) OR event_id % 13 = 0 THEN 'MODERATOR' "
    "WHEN user_id IN (2, 3) THEN 'TRUSTED' ELSE 'EVERYONE' END AS level FROM (SELECT *, user_id % 7 AS guild_id FROM events)",
)
def permissions(spark, sf_dir):
    level = domain.permission_level(F.col("user_id"), F.col("guild_id"), F.array(F.col("event_id") % 9), [1], [4], [5, 6], [2, 3], F.col("event_id") % 11 == 0, [F.col("event_id") % 13 == 0])
    return events(spark, sf_dir).select("event_id", level.alias("level"))


@register("dom_can_moderate", "SELECT event_id, CASE WHEN user_id = guild_id THEN false WHEN guild_id = 3 THEN false WHEN user_id = 3 THEN true WHEN user_id IN (1) THEN true ELSE event_id % 9 > guild_id END AS can FROM (SELECT *, user_id % 7 AS guild_id FROM events)")
def moderate(spark, sf_dir):
    can = domain.can_moderate(F.col("user_id"), F.col("guild_id"), F.lit(3), F.col("event_id") % 9, F.col("guild_id"), [1])
    return events(spark, sf_dir).select("event_id", can.alias("can"))


@register("dom_assign_role", "SELECT event_id, CASE WHEN user_id = 3 THEN true WHEN event_id % 2 = 0 THEN false ELSE event_id % 9 > 4 END AS can FROM events")
def assign(spark, sf_dir):
    can = domain.can_assign_role(F.col("user_id"), F.lit(3), F.col("event_id") % 2 != 0, F.col("event_id") % 9, F.lit(4))
    return load(spark, sf_dir, "events").select("event_id", can.alias("can"))


@register("dom_log_route", "SELECT event_id, event_type IN ('click', 'error') AND user_id % 7 NOT IN (2) AND user_id NOT IN (5) AS logs, CASE event_type WHEN 'click' THEN 10 WHEN 'error' THEN 20 END::BIGINT AS channel FROM events")
def route(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "message_edit").when(F.col("event_type") == "error", "bot_error").otherwise("unknown")
    rows = events(spark, sf_dir).withColumn("kind", kind)
    logs = domain.should_log(F.col("kind"), F.col("guild_id"), F.col("user_id"), F.array(), ["message_edit", "bot_error"], [2], [5])
    return rows.select("event_id", logs.alias("logs"), domain.log_channel(F.col("kind"), {"message_log_channel": 10, "bot_log_channel": 20}).alias("channel"))


@register("dom_cases", "SELECT o_orderkey AS case_id FROM orders WHERE o_custkey % 3 = 1 AND o_custkey % 11 = 4 ORDER BY o_orderkey DESC")
def cases(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 3).alias("guild_id"), (F.col("o_custkey") % 11).alias("target_id"))
    return domain.user_cases(1, 4).select("case_id").execute(rows)


@register("dom_open_tickets", "SELECT o_orderkey AS ticket_id FROM orders WHERE o_custkey % 3 = 1 AND o_custkey % 11 = 4 AND o_orderstatus IN ('O', 'P')")
def tickets(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "on_hold").otherwise("closed")
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ticket_id"), (F.col("o_custkey") % 3).alias("guild_id"), (F.col("o_custkey") % 11).alias("creator_id"), status.alias("status"))
    return domain.open_tickets(1, 4).select("ticket_id").execute(rows)


@register("dom_level_board", "SELECT user_id, sum(event_id)::BIGINT AS total_xp FROM events WHERE user_id % 7 = 2 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def board(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("guild_id", "user_id").agg(F.sum("event_id").alias("total_xp"))
    return domain.level_board(2).select("user_id", "total_xp").execute(rows)


@register("dom_active_cases", "SELECT event_id FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0 AND (event_id % 5 = 0 OR ts > TIMESTAMP '2024-01-10')")
def active_cases(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.expr("event_id % 2 = 0").alias("is_active"), F.expr("event_id % 3 = 0").alias("revoked"), F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp")).alias("expires_at"))
    return domain.active_cases(rows, F.lit("2024-01-10").cast("timestamp")).select("event_id")


@register(
    "dom_warnings",
    "SELECT user_id, count(*) AS total, count(*) FILTER (event_id % 4 <> 0 AND ts > TIMESTAMP '2024-01-10') AS active, coalesce(sum(event_id % 3) FILTER (event_id % 4 <> 0 AND ts > TIMESTAMP '2024-01-10'), 0)::BIGINT AS points FROM events GROUP BY 1",
)
def warnings(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", F.expr("event_id % 4 = 0").alias("pardoned"), F.col("ts").cast("timestamp").alias("expires_at"), F.expr("event_id % 3").alias("points"))
    return domain.active_warnings(rows, F.lit("2024-01-10").cast("timestamp"))


@register(
    "dom_ticket_states",
    "WITH e AS (SELECT user_id AS ticket_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'respond' WHEN 'click' THEN 'claim' WHEN 'error' THEN 'close' ELSE 'reopen' END AS event, event_id AS actor, ts AS t, event_id AS no FROM events) "
    "SELECT ticket_id, max_by(CASE event WHEN 'create' THEN 'open' WHEN 'claim' THEN 'claimed' WHEN 'close' THEN 'closed' ELSE 'open' END, row(t, no)) FILTER (event <> 'respond') AS status, "
    "floor(epoch(min(t) FILTER (event = 'respond')))::BIGINT - floor(epoch(min(t) FILTER (event = 'create')))::BIGINT AS response_seconds FROM e GROUP BY 1 HAVING count(*) FILTER (event <> 'respond') > 0",
)
def ticket_states(spark, sf_dir):
    kinds = {"signup": "create", "view": "respond", "click": "claim", "error": "close"}
    kind = F.lit("reopen")
    for k, v in kinds.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("ticket_id"), kind.alias("event"), F.col("event_id").alias("actor"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("no"))
    return domain.ticket_states(rows).select("ticket_id", "status", "response_seconds")


@register("dom_purge", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click' AND user_id % 2 = 0 ORDER BY event_id DESC LIMIT 21)")
def purge(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("channel", F.col("event_type"))
    return domain.purge(rows, "click", "event_id", 20, F.col("user_id") % 2 == 0).select("event_id")


# Streams, replayed over the table at hand.
def _replayed(spark: SparkSession, sf_dir: str, keys: list[str], make, values: list[str] = (), where: str = "true") -> DataFrame:
    rows = stateful.replay(stateful.replay_session(spark, f"{sf_dir}/events.parquet"), f"{sf_dir}/events.parquet")
    rows = rows.withColumns({"guild_id": F.col("user_id") % 7, "bad": F.col("event_type") == "error", "gained": 15 + F.col("event_id") % 11})
    return stateful.stateful(rows.filter(where), keys, make, values)


STREAM_COLUMNS = {
    "stm_spam": (["guild_id"], partial(stateful.Trailing, 600), []),
    "stm_token_bucket": (["guild_id"], partial(folds.TokenBucket, 3, 3600.0), []),
    "stm_sliding_log": (["guild_id"], partial(folds.SlidingLog, 4, 7200.0), []),
    "stm_lockdown": (["guild_id"], partial(folds.Lockdown, 5, 7200.0, 14400.0), []),
    "stm_transitions": (["user_id"], partial(stateful.Transition, ("view",)), ["event_type"]),
    "stm_strikes": (["user_id", "event_type"], partial(stateful.Strikes, 3), []),
    "stm_adaptive": (["user_id"], partial(folds.AdaptiveCooldown, 10.0), ["bad"]),
    "stm_afk": (["user_id"], folds.Away, ["bad"]),
    "stm_global": (["guild_id"], partial(folds.GlobalCooldown, 1800.0), []),
    "stm_levels": (["guild_id", "user_id"], partial(folds.Levels, 15), ["gained"]),
}
_SPAM = "count(*) OVER (PARTITION BY user_id % 7 ORDER BY epoch_us(ts) RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW)"
STREAM_SQL = {
    "stm_spam": f"SELECT event_id, {_SPAM} AS recent FROM events",
    "stm_token_bucket": recurrence_sql.token_bucket("guild_id", 3, 3600.0),
    "stm_sliding_log": recurrence_sql.sliding_log("guild_id", 4, 7200.0),
    "stm_lockdown": recurrence_sql.lockdown("guild_id", 5, 7200.0, 14400.0),
    "stm_transitions": recurrence_sql.transitions("user_id", "view"),
    "stm_adaptive": recurrence_sql.adaptive("user_id", 10.0),
    "stm_afk": recurrence_sql.away("user_id"),
    "stm_global": recurrence_sql.global_cooldown("guild_id", 1800.0),
    "stm_levels": recurrence_sql.levels("guild_id, user_id", 15),
    "stm_strikes": "SELECT event_id, n AS strike, n >= 3 AS escalates FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)",
}
for _name, (_keys, _make, _values) in STREAM_COLUMNS.items():

    def _stream(spark, sf_dir, name=_name, keys=_keys, make=_make, values=_values):
        out = folds.names((make.func if isinstance(make, partial) else make).fields)
        made = _replayed(spark, sf_dir, keys, make, values).select("event_id", *out)
        return stateful.drained(spark, made, scratch(spark, name))

    register(_name, STREAM_SQL.get(_name))(_stream)


@register("stm_nuke", f"SELECT event_id, recent FROM ({trailing_actions()}) WHERE recent >= CASE event_type WHEN 'click' THEN 2 ELSE 1 END")
def stream_nuke(spark, sf_dir):
    """Mass actions by users who are not trusted: counts by kind, guild and user, which go when they are as old as the window."""
    made = _replayed(spark, sf_dir, ["event_type", "guild_id", "user_id"], partial(stateful.Trailing, 40000), where="event_type IN ('click', 'error') AND user_id NOT IN (1, 2)")
    rows = stateful.drained(spark, made, scratch(spark, "nuke"))
    return detect.over_limits(rows, {"click": 2, "error": 1}).select("event_id", "recent")


@register("stm_windows", "SELECT epoch_us(time_bucket(INTERVAL '5 minutes', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    session = stateful.replay_session(spark, f"{sf_dir}/events.parquet")
    made = stateful.window_counts(stateful.replay(session, f"{sf_dir}/events.parquet"), "5 minutes", ["event_type"])
    rows = stateful.drained(spark, made, scratch(spark, "windows"), "complete")
    return rows.select(F.unix_micros("window.start").alias("start"), "event_type", "n")


@register("stm_heartbeats", "SELECT user_id AS _row_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def heartbeats(spark, sf_dir):
    """The newest status per key, upserted by micro-batch."""
    base = load(spark, sf_dir, "events")
    log = ChangeLog(spark, scratch(spark, "beats"), base.select("event_type").schema)
    session = stateful.replay_session(spark, f"{sf_dir}/events.parquet")
    rows = stateful.replay(session, f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))

    def batch(newest: DataFrame, _: int) -> None:
        log.put(newest.withColumnRenamed("user_id", "_row_id"))

    rows.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", scratch(spark, "beats")).trigger(availableNow=True).start().awaitTermination()
    return log.scan().select("_row_id", "event_type")
