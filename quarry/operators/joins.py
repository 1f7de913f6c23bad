"""Lookups of the application as joins. No hints: Catalyst and AQE broadcast a side only by its measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default punishments by number of warnings.
ESCALATION = [(3, "mute", 3600), (5, "mute", 86400), (7, "kick", None), (10, "ban", None)]


def with_config(events: DataFrame, config: DataFrame, key: str) -> DataFrame:
    return events.join(config, key, "left")


def without_exempt(events: DataFrame, exempt: DataFrame, key: str) -> DataFrame:
    return events.join(exempt.select(key).distinct(), key, "left_anti")


def without_exempt_roles(events: DataFrame, roles: str, exempt: list) -> DataFrame:
    return events.filter(~F.coalesce(F.arrays_overlap(F.col(roles), F.array(*map(F.lit, exempt))), F.lit(False)))


def afk_mentions(messages: DataFrame, mentioned: Column, away: DataFrame, user: str = "user_id") -> DataFrame:
    """A row per message and mentioned user who is away."""
    spread = messages.withColumn("mentioned", F.explode(F.array_distinct(mentioned)))
    return spread.join(away.withColumnRenamed(user, "mentioned"), "mentioned")


def chats_between(chats: DataFrame, pairs: DataFrame, a: str = "sender_id", b: str = "receiver_id") -> DataFrame:
    """Chats of unordered pairs: both directions meet under one key."""
    low, high = F.least(a, b).alias("low"), F.greatest(a, b).alias("high")
    return chats.select("*", low, high).join(pairs.select(low, high).distinct(), ["low", "high"])


def punishment(count: Column, table: list[tuple] = ESCALATION) -> Column:
    """The highest threshold that the count has reached: (threshold, action, duration), or null."""
    out = F.lit(None)
    for n, action, seconds in sorted(table):
        row = F.struct(F.lit(n).alias("threshold"), F.lit(action).alias("action"), F.lit(seconds).cast("long").alias("duration"))
        out = F.when(count >= n, row).otherwise(out)
    return out


def may_use(user: Column, channel: Column, roles: Column, black: dict[str, list] = {}, white: dict[str, list] = {}) -> Column:  # noqa: B006
    """Whether lists of users, channels and roles let a command through; a missing white list lets all."""
    ok = F.lit(True)
    for kind, values in black.items():
        listed = F.arrays_overlap(roles, F.array(*map(F.lit, values))) if kind == "role" else (user if kind == "user" else channel).isin(values)
        ok = ok & ~F.coalesce(listed, F.lit(False))
    for kind, values in white.items():
        listed = F.arrays_overlap(roles, F.array(*map(F.lit, values))) if kind == "role" else (user if kind == "user" else channel).isin(values)
        ok = ok & F.coalesce(listed, F.lit(False))
    return ok


def cases_with_users(cases: DataFrame, users: DataFrame) -> DataFrame:
    """Cases with the record of their target in the same guild, null where there is none; newest cases have the greatest case_id."""
    known = users.select(F.col("guild_id").alias("_g"), F.col("user_id").alias("_u"), F.col("data").alias("user"))
    return cases.join(known, (F.col("guild_id") == F.col("_g")) & (F.col("target_id") == F.col("_u")), "left").drop("_g", "_u")


def tickets_with_creators(tickets: DataFrame, users: DataFrame, open_states: list[str]) -> DataFrame:
    """Open tickets with the record of their creator in the same guild, null where there is none."""
    known = users.select(F.col("guild_id").alias("_g"), F.col("user_id").alias("_u"), F.col("data").alias("creator"))
    found = tickets.filter(F.col("status").isin(open_states))
    return found.join(known, (F.col("guild_id") == F.col("_g")) & (F.col("creator_id") == F.col("_u")), "left").drop("_g", "_u")


def with_names(board: DataFrame, members: DataFrame, user: str, name: str) -> DataFrame:
    """Entries with the member's name, User#id where there is none."""
    joined = board.join(members.select(user, name), user, "left")
    return joined.withColumn(name, F.coalesce(name, F.concat(F.lit("User#"), F.col(user).cast("string"))))
