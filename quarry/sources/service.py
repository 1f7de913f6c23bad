"""The platform's tables, and typed access to them. Every time is an argument."""

from __future__ import annotations

import json
import uuid
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

from quarry.operators.domain import OPEN_TICKETS
from quarry.plans.query import Query, query

from .database import Database
from .schema import Column

# Tables as "name type" with * for the key, + for an index, = for a default.
TABLES = {
    "guilds": "guild_id* INT64, settings JSON={}, created_at TIMESTAMP, updated_at TIMESTAMP, case_counter INT32=0, ticket_counter INT32=0, filter_rules JSON=[], custom_commands JSON={}",
    "users": "id* STRING, user_id+ INT64, guild_id+ INT64, data JSON={}, created_at TIMESTAMP, updated_at TIMESTAMP",
    "tickets": "ticket_id* STRING, guild_id+ INT64, channel_id+ INT64, creator_id+ INT64, category_id STRING, status STRING=open, priority INT32=2, subject STRING, description STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP, closed_at TIMESTAMP, claimed_by INT64, closed_by INT64, close_reason STRING, data JSON={}",
    "moderation_cases": "id* STRING, case_id+ INT32, guild_id+ INT64, target_id+ INT64, moderator_id+ INT64, action+ STRING, reason STRING, created_at TIMESTAMP, expires_at TIMESTAMP, "
    "duration_seconds INT64, is_active BOOL=true, revoked BOOL=false, data JSON={}",
    "filters": "id* STRING, guild_id+ INT64, filter_type+ STRING, pattern STRING, action STRING, enabled BOOL=true, created_at TIMESTAMP, data JSON={}",
    "log_configs": "guild_id* INT64, enabled BOOL=true, channels JSON={}, events JSON={}, ignored JSON={}, updated_at TIMESTAMP, data JSON={}",
    "filter_configs": "guild_id* INT64, updated_at TIMESTAMP, data JSON={}",
    "user_levels": "id* STRING, user_id+ INT64, guild_id+ INT64, xp INT32=0, level INT32=0, total_xp INT64=0, daily_messages INT32=0, last_xp_date STRING, last_message_time TIMESTAMP, updated_at TIMESTAMP",
    "secret_users": "user_id* INT64, nickname+ STRING, created_at TIMESTAMP, is_active BOOL=true",
    "secret_chats": "id* STRING, sender_id+ INT64, receiver_id+ INT64, created_at TIMESTAMP, expires_at TIMESTAMP",
    "host_checks": "id* STRING, guild_id+ INT64, url STRING, name STRING, check_type STRING, check_interval INT32=60, last_status STRING, last_check TIMESTAMP, notify_channel_id INT64, created_at TIMESTAMP, is_active BOOL=true",
    "node_status": "shard_id* INT32, status STRING, latency FLOAT64, guild_count INT32=0, member_count INT64=0, uptime_seconds INT64=0, memory_mb FLOAT64, cpu_percent FLOAT64, last_heartbeat TIMESTAMP, started_at TIMESTAMP, version STRING",
    "metrics": "id* STRING, shard_id+ INT32, metric_type+ STRING, value FLOAT64, timestamp+ TIMESTAMP, data JSON",
}


def columns(spec: str) -> list[Column]:
    out = []
    for part in spec.split(", "):
        name, kind = part.split(" ")
        kind, _, default = kind.partition("=")
        value: Any = default or None
        if default and kind in ("INT32", "INT64"):
            value = int(default)
        elif default and kind == "BOOL":
            value = default == "true"
        out.append(Column(name.rstrip("*+"), kind, default=value, primary_key="*" in name, indexed=name[-1] in "*+"))
    return out


class Service:
    """Get and save of the platform's records. ``save`` updates the row of a key or inserts it."""

    def __init__(self, db: Database):
        self.db = db
        for name, spec in TABLES.items():
            db.create_table(name, columns(spec))

    def save(self, table: str, row: dict[str, Any]) -> None:
        key = next(c.name for c in columns(TABLES[table]) if c.primary_key)
        if not self.db.update(table, row, {key: row[key]}):
            self.db.insert(table, row)

    def save_all(self, table: str, rows: DataFrame) -> None:
        """Many records in one commit."""
        self.db.upsert(table, rows, next(c.name for c in columns(TABLES[table]) if c.primary_key))

    def get_or_create(self, table: str, key: str, value: Any, now: datetime, **defaults: Any) -> dict:
        row = self.db.find_by_id(table, key, value)
        if row is None:
            names = {c.name for c in columns(TABLES[table])}
            self.db.insert(table, {key: value, **{k: now for k in ("created_at", "updated_at") if k in names}, **defaults})
            row = self.db.find_by_id(table, key, value)
        return row

    # Guilds, users, levels.
    def guild(self, guild_id: int, now: datetime) -> dict:
        return self.get_or_create("guilds", "guild_id", guild_id, now)

    def next_number(self, guild_id: int, counter: str, now: datetime) -> int:
        """The guild's next case or ticket number."""
        number = (self.guild(guild_id, now)[counter] or 0) + 1
        self.db.update("guilds", {counter: number, "updated_at": now}, {"guild_id": guild_id})
        return number

    def user(self, user_id: int, guild_id: int, now: datetime) -> dict:
        return self.get_or_create("users", "id", f"{guild_id}_{user_id}", now, user_id=user_id, guild_id=guild_id)

    def level(self, user_id: int, guild_id: int) -> dict | None:
        return self.db.find_by_id("user_levels", "id", f"{guild_id}_{user_id}")

    def save_level(self, user_id: int, guild_id: int, now: datetime, **values: Any) -> None:
        self.save("user_levels", {"id": f"{guild_id}_{user_id}", "user_id": user_id, "guild_id": guild_id, "last_message_time": now, "updated_at": now, **values})

    def leaderboard(self, guild_id: int, limit: int = 10) -> DataFrame:
        return self.db.select("user_levels", query().where_eq("guild_id", guild_id).order_by_desc("total_xp").order_by("user_id").limit(limit))

    # Cases, tickets.
    def case(self, guild_id: int, case_id: int) -> dict | None:
        return self.db.find_one("moderation_cases", {"guild_id": guild_id, "case_id": case_id})

    def user_cases(self, guild_id: int, user_id: int) -> DataFrame:
        return self.db.select("moderation_cases", query().where_eq("guild_id", guild_id).where_eq("target_id", user_id).order_by_desc("case_id"))

    def save_case(self, case: dict[str, Any]) -> None:
        self.save("moderation_cases", {"id": f"{case['guild_id']}_{case['case_id']}", **case})

    def ticket_of_channel(self, channel_id: int) -> dict | None:
        return self.db.find_one("tickets", {"channel_id": channel_id})

    def open_tickets(self, guild_id: int, user_id: int) -> DataFrame:
        return self.db.select("tickets", query().where_eq("guild_id", guild_id).where_eq("creator_id", user_id).where_in("status", OPEN_TICKETS))

    def set_ticket(self, ticket_id: str, event: str, actor: int, now: datetime, reason: str | None = None) -> int:
        """A step of a ticket's life: claim, unclaim, close, reopen."""
        change: dict[str, Any] = {
            "claim": {"status": "claimed", "claimed_by": actor},
            "unclaim": {"status": "open", "claimed_by": None},
            "hold": {"status": "on_hold"},
            "close": {"status": "closed", "closed_by": actor, "closed_at": now, "close_reason": reason},
            "reopen": {"status": "open", "closed_by": None, "closed_at": None, "close_reason": None},
        }[event]
        return self.db.update("tickets", {**change, "updated_at": now}, {"ticket_id": ticket_id})

    # Configurations of filters and logs: a document a guild.
    def _document(self, table: str, guild_id: int) -> dict | None:
        row = self.db.find_by_id(table, "guild_id", guild_id)
        return row and json.loads(row["data"] or "{}")

    def _save_document(self, table: str, guild_id: int, document: dict, row: dict[str, Any]) -> None:
        row = {"guild_id": guild_id, "data": {**document, "guild_id": guild_id}, **row}
        if not self.db.update(table, row, {"guild_id": guild_id}):
            self.db.insert(table, row)

    def filter_config(self, guild_id: int) -> dict | None:
        return self._document("filter_configs", guild_id)

    def save_filter_config(self, guild_id: int, config: dict, now: datetime) -> None:
        """The guild's filter document, and a row of ``filters`` for each of its rules."""
        self._save_document("filter_configs", guild_id, config, {"updated_at": now})
        self.db.delete("filters", {"guild_id": guild_id})
        rules = config.get("rules", [])
        self.db.insert_many("filters", [
            {"id": r["id"], "guild_id": guild_id, "filter_type": r.get("filter_type", "contains"), "pattern": r["pattern"], "action": r.get("action", "delete"), "enabled": r.get("enabled", True), "created_at": now, "data": r}
            for r in rules
        ])

    def get_or_create_filter_config(self, guild_id: int, now: datetime) -> dict:
        if self.filter_config(guild_id) is None:
            self.save_filter_config(guild_id, {"rules": []}, now)
        return self.filter_config(guild_id)

    def filters(self, guild_id: int) -> DataFrame:
        """The rules that are enabled."""
        return self.db.select("filters", query().where_eq("guild_id", guild_id).where_eq("enabled", True).order_by("id"))

    def log_config(self, guild_id: int) -> dict | None:
        return self._document("log_configs", guild_id)

    def save_log_config(self, guild_id: int, config: dict, now: datetime) -> None:
        self._save_document("log_configs", guild_id, config, {
            "enabled": config.get("enabled", True), "channels": config.get("channels", {}), "events": config.get("enabled_types", []), "updated_at": now,
            "ignored": {k: v for k, v in config.items() if k.startswith("ignored_")},
        })

    def get_or_create_log_config(self, guild_id: int, now: datetime) -> dict:
        if self.log_config(guild_id) is None:
            self.save_log_config(guild_id, {}, now)
        return self.log_config(guild_id)

    # Nicknames and chats.
    def secret_user(self, user_id: int) -> dict | None:
        return self.db.find_by_id("secret_users", "user_id", user_id)

    def secret_user_by_nickname(self, nickname: str) -> dict | None:
        return self.db.find_one("secret_users", {"nickname": nickname})

    def save_secret_user(self, user_id: int, nickname: str, now: datetime) -> None:
        self.save("secret_users", {"user_id": user_id, "nickname": nickname, "created_at": now, "is_active": True})

    def delete_secret_user(self, user_id: int) -> int:
        return self.db.delete("secret_users", {"user_id": user_id})

    def chat(self, a: int, b: int) -> dict | None:
        """In either direction."""
        return self.db.find_one("secret_chats", {"sender_id": a, "receiver_id": b}) or self.db.find_one("secret_chats", {"sender_id": b, "receiver_id": a})

    def create_chat(self, sender: int, receiver: int, now: datetime) -> str:
        i = str(uuid.uuid4())
        self.db.insert("secret_chats", {"id": i, "sender_id": sender, "receiver_id": receiver, "created_at": now})
        return i

    # Hosts, nodes, metrics.
    def add_host(self, guild_id: int, url: str, name: str, now: datetime, check_type: str = "http", check_interval: int = 60, notify_channel_id: int | None = None) -> str:
        i = str(uuid.uuid4())
        self.db.insert(
            "host_checks",
            {"id": i, "guild_id": guild_id, "url": url, "name": name, "check_type": check_type, "check_interval": check_interval, "last_status": "pending", "last_check": now, "notify_channel_id": notify_channel_id, "created_at": now},
        )
        return i

    def hosts(self, guild_id: int | None = None) -> DataFrame:
        where: Query = query().where_eq("is_active", True)
        return self.db.select("host_checks", where if guild_id is None else where.where_eq("guild_id", guild_id))

    def set_host(self, host_id: str, status: str, now: datetime) -> int:
        return self.db.update("host_checks", {"last_status": status, "last_check": now}, {"id": host_id})

    def remove_host(self, host_id: str) -> int:
        return self.db.update("host_checks", {"is_active": False}, {"id": host_id})

    def save_metric(self, shard_id: int, kind: str, value: float, now: datetime, data: dict | None = None) -> None:
        self.db.insert("metrics", {"id": str(uuid.uuid4()), "shard_id": shard_id, "metric_type": kind, "value": value, "timestamp": now, "data": data or {}})

    def metrics(self, shard_id: int | None = None, kind: str | None = None, limit: int = 100) -> DataFrame:
        where = query().order_by_desc("timestamp").limit(limit)
        where = where if shard_id is None else where.where_eq("shard_id", shard_id)
        return self.db.select("metrics", where if kind is None else where.where_eq("metric_type", kind))
