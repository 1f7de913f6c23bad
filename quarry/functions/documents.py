"""JSON documents: schemas of the platform's nested records, defaults, recursive overrides."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Shapes of the nested documents.
STATS = "struct<total_messages:long,total_commands:long,voice_time_seconds:long,warnings:int,mutes:int,kicks:int,bans:int,first_seen:timestamp,last_seen:timestamp>"
SCHEMAS = {
    "escalation": "array<struct<count:int,points:int,action:string,duration:long>>",
    "filter_rule": "struct<rule_id:string,pattern:string,filter_type:string,action:string,enabled:boolean,case_sensitive:boolean,check_bypass:boolean,bypass_types:array<string>,exempt_users:array<long>,exempt_channels:array<long>,exempt_roles:array<long>,strikes:int>",
    "strikes": "map<string,map<string,struct<count:int,timestamps:array<string>>>>",
    "log_config": "struct<guild_id:long,enabled:boolean,enabled_types:array<string>,ignored_channels:array<long>,ignored_users:array<long>,ignored_roles:array<long>>",
    "ticket_note": "array<struct<author_id:long,content:string,created_at:string>>",
    "user_data": f"struct<user_id:long,guild_id:long,level:int,xp:long,afk:boolean,afk_reason:string,stats:{STATS}>",
}


# The documents of the platform as "name type=default"; a type in brackets is a list, braces are a text of JSON.
_SETTINGS = {
    "anti_raid": "enabled boolean=false, join_threshold int=10, join_interval int=10, action string=lockdown, lockdown_duration int=300, new_account_threshold int=7, alert_channel long, "
    "auto_ban_new_accounts boolean=false, auto_kick_no_avatar boolean=false, whitelist_roles [long]",
    "anti_nuke": "enabled boolean=false, max_bans_per_minute int=5, max_kicks_per_minute int=5, max_channel_deletes_per_minute int=3, max_channel_creates_per_minute int=5, max_role_deletes_per_minute int=3, "
    "max_role_creates_per_minute int=5, max_webhook_creates_per_minute int=3, action string=strip_roles, alert_channel long, protected_roles [long], trusted_users [long], log_all_actions boolean=true",
    "automod": "enabled boolean=false, anti_spam boolean=true, spam_threshold int=5, spam_interval int=5, anti_caps boolean=true, caps_threshold double=0.7, caps_min_length int=10, anti_invite boolean=true, "
    "allowed_invite_guilds [long], anti_link boolean=false, allowed_domains [string], anti_emoji_spam boolean=true, emoji_threshold int=10, anti_mention_spam boolean=true, mention_threshold int=5, "
    "anti_newline_spam boolean=true, newline_threshold int=10, warn_on_violation boolean=true, mute_on_repeated boolean=true, mute_threshold int=3, mute_duration int=300, ignored_channels [long]",
}
MODELS = {
    "guild": "guild_id long, settings {settings}, created_at string, updated_at string, case_counter int=0, ticket_counter int=0",
    "settings": "prefix string=!, language string=en, timezone string=UTC, anti_raid {anti_raid}, anti_nuke {anti_nuke}, automod {automod}, moderator_roles [long], admin_roles [long], mute_role long, "
    "disabled_commands [string], disabled_channels [long]",
    **_SETTINGS,
    "user_stats": "messages_sent int=0, commands_used int=0, warnings_received int=0, mutes_received int=0, kicks_received int=0, bans_received int=0, tickets_created int=0, tickets_closed int=0, "
    "invites_created int=0, invites_used int=0, voice_time_seconds long=0, last_message_at string, last_command_at string, last_voice_join_at string",
    "user": "user_id long, guild_id long, joined_at string, first_seen string, last_seen string, stats {user_stats}, is_muted boolean=false, mute_expires_at string, mute_role_id long, is_banned boolean=false, "
    "ban_expires_at string, active_warnings int=0, total_warnings int=0, warning_points int=0, level int=0, xp long=0, reputation int=0, afk boolean=false, afk_message string, afk_since string, timezone string",
    "ticket": "ticket_id string, guild_id long, channel_id long, creator_id long, category_id string=general, status string=open, priority int=2, subject string=, description string=, created_at string, "
    "updated_at string, closed_at string, claimed_by long, claimed_at string, closed_by long, close_reason string, added_users [long], tags [string], message_count int=0, staff_message_count int=0, "
    "first_response_at string, first_response_by long, rating int, feedback string, transcript_url string",
    "case": "case_id int, guild_id long, target_id long, moderator_id long, action string, reason string=No reason provided, created_at string, expires_at string, duration_seconds long, message_id long, "
    "channel_id long, reference_case_id int, is_active boolean=true, revoked boolean=false, revoked_by long, revoked_at string, revoke_reason string, dm_sent boolean=false, dm_failed boolean=false, auto_mod boolean=false",
    "filter": "id string, guild_id long, pattern string, filter_type string=contains, action string=delete, secondary_action string, enabled boolean=true, case_sensitive boolean=false, check_bypass boolean=true, "
    "bypass_types [string], exempt_roles [long], exempt_channels [long], exempt_users [long], punishment_duration int, strikes_before_action int=1, strike_expiry_hours int=24, custom_message string, "
    "dm_user boolean=false, log_matches boolean=true, created_at string, created_by long, match_count int=0, last_match_at string",
    "log": "id string, guild_id long, log_type string, timestamp string, actor_id long, target_id long, channel_id long, message_id long, description string=, logged_to_channel boolean=false, log_message_id long",
}


def _fields(model: str) -> list[tuple[str, str, str | None]]:
    """(name, type, default) of a document; none of its types holds a comma or a space."""
    out = []
    for part in MODELS[model].split(", "):
        name, _, kind = part.partition(" ")
        kind, _, default = kind.partition("=")
        out.append((name, kind, default if "=" in part else None))
    return out


def schema_of(model: str) -> str:
    """The document's schema in DDL."""

    def spell(kind: str) -> str:
        return f"array<{kind[1:-1]}>" if kind[0] == "[" else schema_of(kind[1:-1]) if kind[0] == "{" else kind

    return "struct<" + ",".join(f"`{n}`:{spell(k)}" for n, k, _ in _fields(model)) + ">"


def _completed(found: Column, model: str) -> Column:
    out = []
    for name, kind, default in _fields(model):
        value = found[name]
        if kind[0] == "{":
            value = _completed(value, kind[1:-1])
        elif kind[0] == "[":
            value = F.coalesce(value, F.array().cast(f"array<{kind[1:-1]}>"))
        elif default is not None:
            value = F.coalesce(value, F.lit(default).cast(kind))
        out.append(value.alias(name))
    return F.struct(*out)


def decoded(text: Column, model: str) -> Column:
    """A document's struct from its JSON: unknown keys are dropped, missing ones have their defaults; null and broken texts are empty documents."""
    parsed_once = F.array(F.from_json(F.coalesce(text, F.lit("{}")), schema_of(model)))
    return F.get(F.transform(parsed_once, lambda found: _completed(found, model)), 0)


def encoded(document: Column) -> Column:
    """A document's JSON, with its nulls."""
    return F.to_json(document, {"ignoreNullFields": "false"})


def merge(base: dict, override: dict) -> dict:
    """override over base; where both hold objects they are merged."""
    out = dict(base)
    for k, v in override.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


@F.pandas_udf(T.StringType())
def merged(base: pd.Series, override: pd.Series) -> pd.Series:
    """JSON objects merged recursively; null counts as an empty object. Keys are sorted."""
    return pd.Series([json.dumps(merge(json.loads(a or "{}"), json.loads(b or "{}")), sort_keys=True, separators=(",", ":")) for a, b in zip(base, override, strict=True)], dtype=object)


def flat_override(base: Column, override: Column) -> Column:
    """Maps without nesting: the override's entries win."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(override, k))
    return F.map_concat(kept, override)


def parsed(text: Column, name: str) -> Column:
    return F.from_json(text, SCHEMAS[name])


def with_defaults(settings: Column, defaults: dict[str, object]) -> Column:
    """A struct of the known keys, each the document's value or the default; unknown keys are dropped."""
    kind = {bool: "boolean", int: "long", float: "double", str: "string"}
    schema = ", ".join(f"`{k}` {kind[type(v)]}" for k, v in defaults.items())
    found = F.from_json(settings, schema)
    return F.struct(*[F.coalesce(found[k], F.lit(v)).alias(k) for k, v in defaults.items()])
