"""Detectors over event tables: trailing windows, ranks, transitions, verdicts, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.numbers import micros
from quarry.operators import pieces

#: Seconds of a key's events that one task looks at, at least: a hot key spreads over many tasks.
SPLIT_SECONDS = 3600


def trailing_count(events: DataFrame, keys: list[str], seconds: int, ts: str = "ts", out: str = "recent", split: int = SPLIT_SECONDS) -> DataFrame:
    """events with the number of events of the same keys in (ts - seconds, ts].

    A key's time is cut in pieces; the last ``seconds`` of a piece are copied to the next as
    context, so no key's whole history meets in one task. Events of equal time count each other."""
    width, span = max(split, seconds) * 1_000_000, seconds * 1_000_000
    at = micros(F.col(ts))
    piece = F.floor(at / width).cast("long")
    copies = F.when((piece + 1) * width - at < span, F.array(piece, piece + 1)).otherwise(F.array(piece))
    spread = events.withColumn("_at", at).withColumn("_own", piece).withColumn("_piece", F.explode(copies))
    frame = Window.partitionBy(*keys, "_piece").orderBy("_at").rangeBetween(-(span - 1), 0)
    counted = spread.withColumn(out, F.count("*").over(frame))
    return counted.filter("_piece = _own").drop("_at", "_own", "_piece")


def alerts(events: DataFrame, keys: list[str], seconds: int, threshold: int, ts: str = "ts") -> DataFrame:
    """Events at which the trailing count reaches the threshold."""
    return trailing_count(events, keys, seconds, ts).filter(F.col("recent") >= threshold)


# Default thresholds of mass actions within 60 seconds, by kind.
NUKE_THRESHOLDS = {"ban": 3, "kick": 5, "channel_create": 5, "channel_delete": 3, "role_create": 5, "role_delete": 3, "webhook": 5}


def mass_actions(events: DataFrame, thresholds: dict[str, int], trusted: list[int] = (), seconds: int = 60, actor: str = "user_id") -> DataFrame:
    """Actions by users who are not trusted that reach the threshold of their kind."""
    watched = events.filter(F.col("event_type").isin(list(thresholds)) & ~F.col(actor).isin(list(trusted)))
    return over_limits(trailing_count(watched, ["event_type", "guild_id", actor], seconds), thresholds)


def over_limits(counted: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """Counted actions that reach the threshold of their kind."""
    return counted.filter(F.col("recent") >= X.lookup(thresholds, F.col("event_type"), 1 << 30))


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of the greatest order per key, by an aggregate that combines before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row"))
    return picked.select(*keys, "_row.*")


def changes(rows: DataFrame, keys: list[str], status: str, ignored: tuple[str, ...] = ("pending",), **order) -> DataFrame:
    """Rows whose status differs from the one before, statuses in ``ignored`` passed over."""
    seen = pieces.previous(rows.filter(~F.col(status).isin(list(ignored))), keys, [status], **order)
    seen = seen.withColumn("previous", F.col(f"_previous.{status}")).drop("_previous")
    return seen.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(status)))


def first_of_day(rows: DataFrame, keys: list[str], limit: int = 15, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The first ``limit`` rows of each key and day."""
    day = F.col(ts).cast("date")
    number = F.row_number().over(Window.partitionBy(*keys, "day").orderBy(ts, tie))
    return rows.withColumn("day", day).withColumn("_n", number).filter(F.col("_n") <= limit).drop("_n")


def leaderboard(totals: DataFrame, guild: str, score: str, user: str, top: int = 100) -> DataFrame:
    """The first ``top`` of each guild with rank and page of ten."""
    rank = F.row_number().over(Window.partitionBy(guild).orderBy(F.col(score).desc(), user))
    ranked = totals.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.withColumn("page", F.floor((F.col("rank") - 1) / 10).cast("int") + 1)


def own_rank(totals: DataFrame, guild: str, score: str, user: str, who: dict[int, int], top: int = 100) -> DataFrame:
    """The rank of a user in each guild (who: user by guild), or null where the user is not among the first ``top``. One row
    a guild is compared with the guild's totals: nothing is sorted."""
    asked = totals.sparkSession.createDataFrame(list(who.items()), f"{guild} long, _who long")
    met = totals.join(F.broadcast(asked), guild)
    mine = met.filter(F.col(user) == F.col("_who")).select(F.col(guild).alias("_g"), F.col(score).alias("_mine"))
    ahead = met.join(F.broadcast(mine), F.col(guild) == F.col("_g")).groupBy(guild, "_who").agg(
        F.count_if((F.col(score) > F.col("_mine")) | ((F.col(score) == F.col("_mine")) & (F.col(user) < F.col("_who")))).alias("ahead")
    )
    ranked = asked.join(ahead, [guild, "_who"], "left")
    return ranked.select(guild, F.col("_who").alias(user), F.when(F.col("ahead") < top, F.col("ahead") + 1).cast("int").alias("rank"))


def verdict(text: str, recent: Column, allowed: list[str] = (), spam: int = 5, emojis: int = 10, mentions: int = 5, newlines: int = 10) -> Column:
    """The first violation in order: spam, caps, invite, link, emoji, mention, newline; null if none."""
    links = X.urls(text)
    denied = F.size(links) > 0
    if allowed:
        denied = denied & ~X.allowed_link(links, F.array(*map(F.lit, allowed)))
    return (
        F.when(recent >= spam, "spam")
        .when(X.caps(text), "excessive caps")
        .when(F.col(text).rlike(X.INVITE), "invite link")
        .when(denied, "unauthorized link")
        .when(X.count_emojis(text) > emojis, "emoji spam")
        .when(X.mass_mentions(text, mentions), "mass mentions")
        .when(X.newline_count(text) > newlines, "newline spam")
    )


def apply_rules(messages: DataFrame, rules: list[dict], text: str = "text") -> DataFrame:
    """messages with ``rule``, the id of the first rule in order that matches, or null.

    rules: id, pattern, kind and, optionally, case_sensitive, bypass, enabled, exempt (a column of
    the messages and values that the rule passes over). They are compiled into one projection: a
    rule set is a configuration, so there is no join and no copy of the messages."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        if not rule.get("enabled", True):
            continue
        found = X.rule_matches(text, rule["pattern"], rule["kind"], rule.get("case_sensitive", False), tuple(rule.get("bypass", ())))
        for column, values in rule.get("exempt", {}).items():
            found = found & ~F.coalesce(F.col(column).isin(list(values)), F.lit(False))
        out = F.when(found, F.lit(rule["id"])).otherwise(out)
    return messages.withColumn("rule", out)


def strikes(matches: DataFrame, user: str, rule: str, limit: int, **order) -> DataFrame:
    """matches with the strike number per user and rule, and whether it escalates."""
    return pieces.numbered(matches, [user, rule], "strike", **order).withColumn("escalates", F.col("strike") >= limit)
