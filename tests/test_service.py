"""The platform's tables and typed access; documents."""

import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.functions import documents, numbers
from quarry.sources.database import Database
from quarry.sources.service import TABLES, Service

NOW = datetime(2024, 1, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    return Service(Database(spark, f"file://{tmp_path_factory.mktemp('service')}"))


def test_tables(service):
    assert service.db.list_tables() == sorted(TABLES)
    assert service.db.has_index("users", "guild_id") and service.db.table_info("guilds")["indexes"] == ["guild_id"]


def test_guilds_and_numbers(service):
    first = service.guild(5, NOW)
    assert first["settings"] == "{}" and first["filter_rules"] == "[]" and first["created_at"] == NOW
    assert service.guild(5, NOW + timedelta(days=1))["created_at"] == NOW
    assert [service.next_number(5, "case_counter", NOW) for _ in range(3)] == [1, 2, 3]
    assert service.user(1, 5, NOW)["id"] == "5_1" and service.db.count("users") == 1


def test_cases_and_tickets(service):
    for n in (1, 2, 3):
        service.save_case({"guild_id": 5, "case_id": n, "target_id": 9, "action": "warn", "data": {"n": n}})
    service.save_case({"guild_id": 5, "case_id": 2, "revoked": True})
    assert [r.case_id for r in service.user_cases(5, 9).collect()] == [3, 2, 1]
    assert service.case(5, 2)["revoked"] and not service.case(5, 1)["revoked"] and service.case(6, 1) is None
    service.save("tickets", {"ticket_id": "t1", "guild_id": 5, "channel_id": 77, "creator_id": 9})
    assert service.ticket_of_channel(77)["status"] == "open" and service.open_tickets(5, 9).count() == 1
    service.set_ticket("t1", "claim", 3, NOW)
    assert service.ticket_of_channel(77)["claimed_by"] == 3
    service.set_ticket("t1", "close", 3, NOW, "done")
    assert service.open_tickets(5, 9).count() == 0 and service.ticket_of_channel(77)["close_reason"] == "done"
    service.set_ticket("t1", "reopen", 3, NOW)
    assert service.open_tickets(5, 9).first().closed_at is None


def test_levels_chats_hosts_metrics(service):
    service.save_level(1, 5, NOW, xp=3, level=1, total_xp=300, daily_messages=1, last_xp_date="2024-01-02")
    service.save_level(2, 5, NOW, xp=3, level=1, total_xp=500)
    service.save_level(1, 5, NOW, total_xp=600)
    assert [r.user_id for r in service.leaderboard(5).collect()] == [1, 2] and service.level(1, 5)["xp"] == 3
    i = service.create_chat(1, 2, NOW)
    assert service.chat(2, 1)["id"] == i == service.chat(1, 2)["id"] and service.chat(1, 3) is None
    h = service.add_host(5, "http://x", "x", NOW)
    service.set_host(h, "online", NOW)
    assert service.hosts(5).first().last_status == "online"
    service.remove_host(h)
    assert service.hosts().count() == 0
    for k in range(4):
        service.save_metric(0, "cpu" if k % 2 else "memory", float(k), NOW + timedelta(seconds=k))
    assert [r.value for r in service.metrics(0, limit=2).collect()] == [3.0, 2.0]
    assert [r.value for r in service.metrics(kind="memory").collect()] == [2.0, 0.0]


def test_documents(spark):
    rows = spark.createDataFrame([('{"a":{"x":1,"y":2},"k":0}', '{"a":{"y":3},"k":{"z":1},"n":1}'), (None, '{"q":1}')], "a string, b string")
    assert [r[0] for r in rows.select(documents.merged("a", "b")).collect()] == ['{"a":{"x":1,"y":3},"k":{"z":1},"n":1}', '{"q":1}']
    s = rows.select(documents.with_defaults(F.col("b"), {"n": 7, "other": "d"}).alias("s")).select("s.*").collect()
    assert [(r.n, r.other) for r in s] == [(1, "d"), (7, "d")]
    text = '{"count": 1}'
    assert spark.range(1).select(documents.parsed(F.lit(f"[{text}]"), "escalation").alias("e")).first().e[0]["count"] == 1


def test_crc_and_times(spark):
    r = spark.range(1).select(F.crc32(F.lit("abc").cast("binary")).alias("c"), numbers.snowflake_time(F.lit(175928847299117063)).cast("string").alias("t")).first()
    assert r.c == zlib.crc32(b"abc") and r.t.startswith("2016-04-30")


def test_configurations_and_nicknames(service):
    assert service.filter_config(1) is None and service.get_or_create_filter_config(1, NOW) == {"guild_id": 1, "rules": []}
    service.save_filter_config(1, {"rules": [{"id": "a", "pattern": "x"}, {"id": "b", "pattern": "y", "enabled": False}]}, NOW)
    assert [r.pattern for r in service.filters(1).collect()] == ["x"] and len(service.filter_config(1)["rules"]) == 2
    assert service.get_or_create_log_config(1, NOW) == {"guild_id": 1}
    service.save_log_config(1, {"enabled": False, "enabled_types": ["message_edit"], "ignored_users": [5]}, NOW)
    assert service.log_config(1)["enabled_types"] == ["message_edit"] and service.db.find_one("log_configs", {"guild_id": 1})["enabled"] is False
    service.save_secret_user(7, "owl", NOW)
    service.save_secret_user(7, "fox", NOW)
    assert service.secret_user(7)["nickname"] == "fox" and service.secret_user_by_nickname("owl") is None
    assert service.delete_secret_user(7) == 1 and service.secret_user_by_nickname("fox") is None
