"""Community rules as Columns and plans: permissions, log routing, tickets, cases, boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.numbers import epoch
from quarry.operators.detect import latest
from quarry.plans.query import Query, query

# Permission levels, open ticket states, tables of the service.
LEVELS = {"EVERYONE": 0, "TRUSTED": 1, "MODERATOR": 2, "ADMIN": 3, "SERVER_OWNER": 4, "BOT_OWNER": 5}
OPEN_TICKETS = ["open", "claimed", "on_hold"]
MOD_PERMISSIONS = ("manage_messages", "kick_members", "ban_members", "manage_roles", "manage_channels")


def permission_level(user: Column, owner: Column, roles: Column, bot_owners: list[int], admin_roles: list[int], mod_roles: list[int], trusted: list[int], administrator: Column, permissions: list[Column]) -> Column:
    """The first that holds: bot owner, server owner, admin, moderator, trusted, everyone."""

    def any_role(wanted: list[int]) -> Column:
        return F.coalesce(F.arrays_overlap(roles, F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else F.lit(False)

    any_permission = F.lit(False)
    for p in permissions:
        any_permission = any_permission | F.coalesce(p, F.lit(False))
    return (
        F.when(user.isin(bot_owners), "BOT_OWNER")
        .when(user == owner, "SERVER_OWNER")
        .when(F.coalesce(administrator, F.lit(False)) | any_role(admin_roles), "ADMIN")
        .when(any_role(mod_roles) | any_permission, "MODERATOR")
        .when(user.isin(trusted), "TRUSTED")
        .otherwise("EVERYONE")
    )


def at_least(level: Column, required: str) -> Column:
    return X.lookup(LEVELS, level, 0) >= LEVELS[required]


def can_moderate(moderator: Column, target: Column, owner: Column, moderator_rank: Column, target_rank: Column, bot_owners: list[int]) -> Column:
    return (
        F.when(moderator == target, False)
        .when(target == owner, False)
        .when(moderator == owner, True)
        .when(moderator.isin(bot_owners), True)
        .otherwise(moderator_rank > target_rank)
    )


def can_assign_role(member: Column, owner: Column, manages: Column, member_rank: Column, role_rank: Column) -> Column:
    return F.when(member == owner, True).when(~manages, False).otherwise(member_rank > role_rank)


# The channel setting of each category.
CHANNEL_OF = {
    "message": "message_log_channel", "member": "member_log_channel", "moderation": "moderation_log_channel", "role": "server_log_channel", "channel": "server_log_channel",
    "guild": "server_log_channel", "voice": "voice_log_channel", "automod": "automod_log_channel", "ticket": "ticket_log_channel", "bot": "bot_log_channel",
}


def log_channel(kind: Column, settings: dict[str, int]) -> Column:
    """The channel that a log type goes to, or null."""
    out = F.lit(None).cast("long")
    for category, setting in CHANNEL_OF.items():
        if setting in settings:
            out = F.when(X.log_category(kind) == category, F.lit(settings[setting]).cast("long")).otherwise(out)
    return out


def should_log(kind: Column, channel: Column, user: Column, roles: Column, enabled_types: list[str], ignored_channels: list = (), ignored_users: list = (), ignored_roles: list = (), enabled: bool = True) -> Column:
    ok = F.lit(enabled) & kind.isin(enabled_types)
    ok = ok & ~F.coalesce(channel.isin(list(ignored_channels)), F.lit(False)) & ~F.coalesce(user.isin(list(ignored_users)), F.lit(False))
    if ignored_roles:
        ok = ok & ~F.coalesce(F.arrays_overlap(roles, F.array(*map(F.lit, ignored_roles))), F.lit(False))
    return ok


def user_cases(guild: int, user: int) -> Query:
    return query("moderation_cases").where_eq("guild_id", guild).where_eq("target_id", user).order_by_desc("case_id")


def open_tickets(guild: int, creator: int) -> Query:
    return query("tickets").where_eq("guild_id", guild).where_eq("creator_id", creator).where_in("status", OPEN_TICKETS)


def level_board(guild: int, n: int = 10) -> Query:
    return query("user_levels").where_eq("guild_id", guild).order_by_desc("total_xp").order_by("user_id").limit(n)


def active_cases(cases: DataFrame, now: Column) -> DataFrame:
    """Cases neither revoked nor expired."""
    return cases.filter(F.col("is_active") & ~F.col("revoked") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def active_warnings(warnings: DataFrame, now: Column) -> DataFrame:
    """Count and points of warnings per user that are neither pardoned nor expired."""
    live = ~F.col("pardoned") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return warnings.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(live).alias("active"), F.coalesce(F.sum(F.when(live, F.col("points"))), F.lit(0)).alias("points"))


#: Ticket state after an event.
TICKET_STATE = {"create": "open", "claim": "claimed", "unclaim": "open", "hold": "on_hold", "close": "closed", "reopen": "open", "delete": "deleted"}


def ticket_states(events: DataFrame) -> DataFrame:
    """Per ticket: its state after the last event, who claims it, and seconds to the first response and to closing.

    events: ticket_id, event, actor, at, no (order)."""
    order = F.struct("at", "no")
    kind = F.col("event")
    last = events.filter(kind.isin(list(TICKET_STATE)))
    state = last.groupBy("ticket_id").agg(
        F.max_by(X.lookup(TICKET_STATE, kind, "open"), order).alias("status"),
        F.max_by(F.when(kind == "claim", F.col("actor")), F.when(kind.isin("claim", "unclaim", "reopen"), order)).alias("claimed_by"),
    )
    times = events.groupBy("ticket_id").agg(
        F.min(F.when(kind == "create", F.col("at"))).alias("created"), F.min(F.when(kind == "respond", F.col("at"))).alias("first"), F.max(F.when(kind == "close", F.col("at"))).alias("closed")
    )
    return state.join(times, "ticket_id").select(
        "ticket_id", "status", "claimed_by", (epoch(F.col("first")) - epoch(F.col("created"))).alias("response_seconds"), (epoch(F.col("closed")) - epoch(F.col("created"))).alias("resolution_seconds")
    )


def purge(messages: DataFrame, channel: str, order: str, n: int, author: Column | None = None) -> DataFrame:
    """messages without the newest n + 1 of a channel (of an author's, if given)."""
    found = messages.filter(F.col("channel") == channel)
    found = found if author is None else found.filter(author)
    newest = found.orderBy(F.col(order).desc()).limit(n + 1).select(order)
    return messages.join(newest, order, "left_anti")


def latest_status(heartbeats: DataFrame, node: str = "shard_id") -> DataFrame:
    return latest(heartbeats, [node], F.col("last_heartbeat"))
