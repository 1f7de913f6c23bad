"""Recurrences as recursive SQL over a key's events in order: the oracle of the batch and stream operators."""

from __future__ import annotations


def recurrence(keys: str, state: dict[str, str], step: dict[str, str], out: list[str], local: dict[str, str] | None = None, values: str = "") -> str:
    """state: initial values by name. step: each name's next value, of r (before) and e (the event).
    local: values that steps share, which may use r, e and earlier ones."""
    local = local or {}
    source = f"(SELECT r.n, {', '.join(f'r.{s}' for s in state)}, e.n AS en, e.k, e.event_id, e.t{', e.' + ', e.'.join(values.split(' ')) if values else ''} FROM r JOIN e ON e.k = r.k AND e.n = r.n + 1)"
    for name, expression in local.items():
        source = f"(SELECT *, {expression} AS {name} FROM {source})"
    fields = ", ".join(f"{expression} AS {name}" for name, expression in step.items())
    first = ", ".join(f"{v} AS {n}" for n, v in state.items())
    start = f"SELECT 0::BIGINT AS n, k, NULL::BIGINT AS event_id, {first} FROM (SELECT DISTINCT k FROM e)"
    return (
        f"WITH RECURSIVE e AS (SELECT event_id, hash({keys}) AS k, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY {keys} ORDER BY epoch_us(ts), event_id) AS n, "
        "event_type = 'error' AS bad, event_id % 5 - 2 AS change, 15 + event_id % 11 AS gained, event_type FROM (SELECT *, user_id % 7 AS guild_id FROM events)), "
        f"r AS ({start} UNION ALL SELECT en AS n, k, event_id, {', '.join(state)} FROM (SELECT en, k, event_id, {fields} FROM {source})) "
        f"SELECT event_id, {', '.join(out)} FROM r WHERE n > 0"
    )


def token_bucket(keys: str, rate: int, per: float) -> str:
    return recurrence(
        keys, {"tokens": f"{rate}::DOUBLE", "last": "NULL::DOUBLE", "allowed": "false", "retry_after": "0::DOUBLE"},
        {"tokens": "CASE WHEN have >= 1 THEN have - 1 ELSE have END", "last": "t", "allowed": "have >= 1", "retry_after": f"CASE WHEN have >= 1 THEN 0::DOUBLE ELSE (1 - have) * {per}::DOUBLE / {rate} END"},
        ["allowed", "tokens", "retry_after"], {"have": f"CASE WHEN last IS NULL THEN tokens ELSE least({rate}::DOUBLE, tokens + (t - last) * {rate} / {per}::DOUBLE) END"},
    )


def sliding_log(keys: str, limit: int, window: float) -> str:
    return recurrence(
        keys, {"log": "[]::DOUBLE[]", "allowed": "false", "retry_after": "0::DOUBLE"},
        {"log": f"CASE WHEN len(live) < {limit} THEN list_append(live, t) ELSE live END", "allowed": f"len(live) < {limit}", "retry_after": f"CASE WHEN len(live) < {limit} THEN 0::DOUBLE ELSE greatest(0::DOUBLE, {window}::DOUBLE - (t - live[1])) END"},
        ["allowed", "retry_after"], {"live": f"list_filter(log, lambda x: t - x < {window}::DOUBLE)"},
    )


def lockdown(keys: str, threshold: int, interval: float, duration: float) -> str:
    return recurrence(
        keys, {"joins": "[]::DOUBLE[]", "until": "NULL::DOUBLE", "suppressed": "false", "recent": "0::INTEGER", "triggers": "false"},
        {
            "joins": "CASE WHEN shut THEN joins ELSE live END", "until": f"CASE WHEN shut THEN until WHEN len(live) >= {threshold} THEN t + {duration}::DOUBLE END", "suppressed": "shut",
            "recent": "CASE WHEN shut THEN 0 ELSE len(live) END::INTEGER", "triggers": f"NOT shut AND len(live) >= {threshold}",
        },
        ["suppressed", "recent", "triggers"], {"shut": "until IS NOT NULL AND t < until", "live": f"list_append(list_filter(joins, lambda x: x > t - {interval}::DOUBLE), t)"},
    )


def adaptive(keys: str, base: float) -> str:
    b = f"{base}::DOUBLE"
    return recurrence(
        keys, {"per": b, "violations": "0::INTEGER", "last": "NULL::DOUBLE"},
        {
            "per": "next_per",
            "violations": f"CASE WHEN bad THEN CASE WHEN last IS NOT NULL AND t - last > 3600 THEN 0 ELSE violations END + 1 WHEN next_per <= {b} THEN greatest(0, violations - 1) ELSE violations END::INTEGER",
            "last": "CASE WHEN bad THEN t ELSE last END",
        },
        ["per", "violations"], {"next_per": f"CASE WHEN bad THEN least(300::DOUBLE, per * 1.5::DOUBLE) ELSE greatest({b}, per * 0.8::DOUBLE) END"}, "bad",
    )


def global_cooldown(keys: str, seconds: float) -> str:
    return recurrence(
        keys, {"until": "NULL::DOUBLE", "allowed": "false", "remaining": "0::DOUBLE"},
        {"until": f"CASE WHEN free THEN t + {seconds}::DOUBLE ELSE until END", "allowed": "free", "remaining": "CASE WHEN free THEN 0::DOUBLE ELSE until - t END"},
        ["allowed", "remaining"], {"free": "until IS NULL OR t >= until"},
    )


def points(keys: str) -> str:
    return recurrence(keys, {"points": "0::BIGINT"}, {"points": "greatest(0, points + change)"}, ["points"], values="change")


def away(keys: str) -> str:
    return recurrence(
        keys, {"since": "NULL::DOUBLE", "away": "false", "returned": "false", "away_seconds": "NULL::DOUBLE"},
        {"since": "CASE WHEN bad THEN t END", "away": "bad", "returned": "NOT bad AND since IS NOT NULL", "away_seconds": "CASE WHEN NOT bad THEN t - since END"},
        ["away", "returned", "away_seconds"], values="bad",
    )


def levels(keys: str, daily: int) -> str:
    cost = "(5 * (level + 1) * (level + 1) + 50 * (level + 1) + 100)"
    return recurrence(
        keys, {"day": "-1::BIGINT", "used": "0::BIGINT", "level": "0::INTEGER", "xp": "0::BIGINT", "total_xp": "0::BIGINT", "counted": "false"},
        {
            "day": "today", "used": "before + CASE WHEN ok THEN 1 ELSE 0 END", "level": f"(level + CASE WHEN ok AND xp + gained >= {cost} THEN 1 ELSE 0 END)::INTEGER",
            "xp": f"CASE WHEN NOT ok THEN xp WHEN xp + gained >= {cost} THEN xp + gained - {cost} ELSE xp + gained END", "total_xp": "total_xp + CASE WHEN ok THEN gained ELSE 0 END", "counted": "ok",
        },
        ["counted", "level", "xp", "total_xp"], {"today": "floor(t / 86400)::BIGINT", "before": "CASE WHEN today = day THEN used ELSE 0 END", "ok": f"before < {daily}"}, "gained",
    )


def transitions(keys: str, ignored: str) -> str:
    return recurrence(
        keys, {"last": "NULL::VARCHAR", "previous": "NULL::VARCHAR", "changed": "false"},
        {"last": f"CASE WHEN event_type = '{ignored}' THEN last ELSE event_type END", "previous": "last", "changed": f"event_type <> '{ignored}' AND last IS NOT NULL AND last <> event_type"},
        ["previous", "changed"], values="event_type",
    )
