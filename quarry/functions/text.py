"""Text functions: Column -> Column, all in built-in expressions but NFKC."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The platform's formats of ids, mentions, invites and emojis, and of URLs, colours and addresses.
ID = r"\d{17,20}"
MENTION = r"<@!?(\d{17,20})>"
ROLE_MENTION = r"<@&(\d{17,20})>"
CHANNEL_MENTION = r"<#(\d{17,20})>"
CUSTOM_EMOJI = r"<a?:(\w+):(\d{17,20})>"
EMOJI_RUN = r"[\x{10000}-\x{10FFFF}\x{2600}-\x{2B55}\x{200D}\x{23CF}\x{23E9}\x{231A}\x{FE0F}\x{3030}]+"
INVITE = r"(?i)(?:https?://)?(?:www\.)?(?:discord\.(?:gg|io|me|li)|discordapp\.com/invite|discord\.com/invite)/([a-zA-Z0-9\-]+)"
URL = (
    r"(?i)https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"(?::\d+)?(?:/?|[/?]\S+)"
)
HEX_COLOR = r"^#?([A-Fa-f0-9]{6}|[A-Fa-f0-9]{3})$"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
IMAGE_ENDS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp")
MARKDOWN = r"[*_`~|>#\-+=\[\]()!]"
# Tokens of obfuscated spelling with the letters that they stand for, in the order in which they are replaced
# (the longest first, as shorter ones are parts of them), and Greek letters with the Latin ones that they look like.
LEET = [
    (r"|\/|", "m"), ("|_|", "u"), ("|\\|", "n"), ("/\\", "a"), ("\\/", "v"),
    ("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("6", "g"), ("7", "t"), ("8", "b"), ("9", "g"),
    ("@", "a"), ("$", "s"), ("!", "i"), ("+", "t"), ("|", "l"), ("(", "c"), (")", "d"),
]
LOOK_ALIKE = ("αβεηικμνορστυχψ", "abenikmnorstuxy")


def _text(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncate(text, length: int, suffix: str = "...") -> Column:
    text = _text(text)
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.substring(text, 1, length - len(suffix)), F.lit(suffix)))


def sanitize(text, newlines: bool = True) -> Column:
    """Mentions that would notify are broken by a zero-width space."""
    gap = "​"
    out = F.replace(F.replace(_text(text), F.lit("@everyone"), F.lit(f"@{gap}everyone")), F.lit("@here"), F.lit(f"@{gap}here"))
    if not newlines:
        out = F.replace(out, F.lit("\n"), F.lit(" "))
    out = F.regexp_replace(out, r"<@!?(\d+)>", f"<@{gap}$1>")
    return F.regexp_replace(out, r"<@&(\d+)>", f"<@&{gap}$1>")


def escape_markdown(text) -> Column:
    return F.regexp_replace(_text(text), MARKDOWN, r"\\$0")


def extract_ids(text) -> Column:
    """Runs of 17 to 20 digits, as decimals, since 20 digits may not fit a long."""
    return F.transform(F.regexp_extract_all(_text(text), F.lit(ID), F.lit(0)), lambda x: x.cast("decimal(20,0)"))


def human_join(items: Column, word: str = "and") -> Column:
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return (
        F.when(n == 0, "")
        .when(n == 1, F.get(items, 0))
        .when(n == 2, F.concat(F.get(items, 0), F.lit(f" {word} "), F.get(items, 1)))
        .otherwise(F.concat(head, F.lit(f", {word} "), F.get(items, n - 1)))
    )


def ordinal(n: Column) -> Column:
    ending = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)


def pluralize(word: Column, n: Column, plural: str | None = None) -> Column:
    return F.when(n == 1, word).otherwise(F.lit(plural) if plural else F.concat(word, F.lit("s")))


def is_url(text) -> Column:
    """http or https with a host."""
    return F.coalesce(_text(text).rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def is_image_url(text) -> Column:
    path = F.lower(F.regexp_extract(_text(text), r"^(?i:https?)://[^/?#]+([^?#;]*)", 1))
    found = F.lit(False)
    for end in IMAGE_ENDS:
        found = found | path.endswith(end)
    return is_url(text) & found


def extract_all(text, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(group))


def invites(text) -> Column:
    return extract_all(text, INVITE, 1)


def urls(text) -> Column:
    return extract_all(text, URL)


def mentions(text) -> Column:
    return F.transform(extract_all(text, MENTION, 1), lambda x: x.cast("decimal(20,0)"))


def role_mentions(text) -> Column:
    return F.transform(extract_all(text, ROLE_MENTION, 1), lambda x: x.cast("decimal(20,0)"))


def channel_mentions(text) -> Column:
    return F.transform(extract_all(text, CHANNEL_MENTION, 1), lambda x: x.cast("decimal(20,0)"))


def leading_mention(text, pattern: str = MENTION) -> Column:
    """The id of a mention that the text begins with, or null."""
    found = F.regexp_extract(_text(text), "^" + pattern, 1)
    return F.when(found != "", found.cast("decimal(20,0)"))


def custom_emojis(text) -> Column:
    names, ids = extract_all(text, "(?U)" + CUSTOM_EMOJI, 1), extract_all(text, "(?U)" + CUSTOM_EMOJI, 2)
    return F.zip_with(names, ids, lambda n, i: F.struct(n.alias("name"), i.cast("decimal(20,0)").alias("id")))


def count_emojis(text) -> Column:
    """Custom emojis, and runs of Unicode emojis, each counted once."""
    text = _text(text)
    return F.regexp_count(text, F.lit("(?U)" + CUSTOM_EMOJI)) + F.regexp_count(text, F.lit(EMOJI_RUN))


def is_emoji(text) -> Column:
    return _text(text).rlike(f"^(?:(?U:{CUSTOM_EMOJI})|{EMOJI_RUN})")


def hex_color(text) -> Column:
    """3 or 6 hex digits as a number, or null."""
    digits = F.regexp_extract(_text(text), HEX_COLOR, 1)
    full = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    return F.when(digits != "", F.conv(full, 16, 10).cast("long"))


def is_snowflake(text) -> Column:
    return _text(text).rlike(r"^\d{17,20}$") & ~_text(text).rlike("^0+$")


def is_email(text) -> Column:
    return _text(text).rlike(EMAIL)


def mass_mentions(text, threshold: int = 5) -> Column:
    text = _text(text)
    return text.contains("@everyone") | text.contains("@here") | (F.regexp_count(text, F.lit(MENTION)) >= threshold)


def caps(text, threshold: float = 0.7, least: int = 10) -> Column:
    """More than ``threshold`` of at least ``least`` letters are upper case."""
    letters = F.length(F.regexp_replace(_text(text), r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(_text(text), r"[^\p{Lu}]", ""))
    return (letters >= least) & (upper / F.greatest(letters, F.lit(1)) > threshold)


def emoji_spam(text, threshold: int = 10) -> Column:
    return count_emojis(text) > threshold


def newline_count(text) -> Column:
    return F.length(_text(text)) - F.length(F.replace(_text(text), F.lit("\n"), F.lit("")))


def words(text) -> Column:
    return F.filter(F.split(_text(text), r"(?U)\s+"), lambda w: w != "")


def repetitive(text) -> Column:
    """More than 5 words of which fewer than a fifth are different."""
    w = words(text)
    return (F.size(w) > 5) & (F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)) < 0.2)


def repeating(text) -> Column:
    return _text(text).rlike(r"(.{3,})\1{5,}")


def spam_reason(text) -> Column:
    """The first reason in order, or null. The costly back reference is tried only on texts up to 2000 characters."""
    text = _text(text)
    return (
        F.when(F.length(text) > 2000, "Message too long")
        .when(caps(text), "Excessive caps")
        .when(emoji_spam(text), "Too many emojis")
        .when(mass_mentions(text), "Mass mentions")
        .when(repeating(text), "Repeating pattern")
        .when(repetitive(text), "Repetitive words")
    )


def sanitize_username(name) -> Column:
    out = F.regexp_replace(_text(name), r"(?U)[^\w\s-]", "")
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    return F.when(out == "", "User").otherwise(F.substring(out, 1, 32))


def is_command_name(name) -> Column:
    return _text(name).rlike("^[a-z][a-z0-9_-]{0,31}$")


def prefix_error(prefix) -> Column:
    """What is wrong with a command prefix, or null."""
    prefix = _text(prefix)
    return (
        F.when(prefix.isNull() | (prefix == ""), "Prefix cannot be empty")
        .when(F.length(prefix) > 5, "Prefix must be 5 characters or less")
        .when(prefix.rlike(r"^(?U)\s+$"), "Prefix cannot be only whitespace")
        .when(prefix.contains("@"), "Prefix cannot contain @")
    )


def reason(text, length: int = 512) -> Column:
    trimmed = F.regexp_replace(F.coalesce(_text(text), F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(trimmed == "", "No reason provided").otherwise(truncate(trimmed, length))


def user_id(text) -> Column:
    """The id of a leading mention, or of a text that is an id; else null."""
    trimmed = F.trim(_text(text))
    return F.coalesce(leading_mention(text), F.when(trimmed.rlike(r"^[1-9]\d{16,19}$"), trimmed.cast("decimal(20,0)")))


def fill_template(template, values: dict[str, Column]) -> Column:
    """{name} replaced by values, in order."""
    out = _text(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def allowed_link(found: Column, domains: Column) -> Column:
    """Any domain is part of any URL."""
    return F.exists(found, lambda u: F.exists(domains, lambda d: F.contains(u, d)))


def strip_marks(text) -> Column:
    return F.regexp_replace(_text(text), r"\p{Mn}", "")


def join_spaced(text) -> Column:
    """White space to one space, then single gaps between word characters closed, left to right."""
    out = F.regexp_replace(_text(text), r"(?U)\s+", " ")
    return F.regexp_replace(out, r"(?U)(\w)\s+(\w)", "$1$2")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def is_ascii(text) -> Column:
    return _text(text).rlike(r"^\p{ASCII}*$")


def look_alikes(text) -> Column:
    """NFKC, then Greek look-alikes; ASCII texts stay as they are. Within one projection Python gets a null for
    an ASCII text, as a batch function is called for every row; ``with_normalised`` keeps such rows away from it."""
    text = _text(text)
    return F.when(is_ascii(text), text).otherwise(F.translate(_nfkc(F.when(~is_ascii(text), text)), *LOOK_ALIKE))


def decode_leet(text) -> Column:
    out = _text(text)
    for token, letter in LEET:
        out = F.replace(out, F.lit(token), F.lit(letter))
    return out


def normalised(text, kinds: tuple[str, ...] = ("zalgo", "spacing", "unicode", "leet")) -> Column:
    steps = {"zalgo": strip_marks, "spacing": join_spaced, "unicode": look_alikes, "leet": decode_leet}
    out = _text(text)
    for kind, step in steps.items():
        if kind in kinds:
            out = step(out)
    return out


def with_normalised(rows: DataFrame, text: str, out: str = "normalised") -> DataFrame:
    """rows with the text normalised by all kinds; only rows beyond ASCII visit Python, the others are read apart. Rows of no text stay null."""
    plain = F.coalesce(is_ascii(text), F.lit(True))
    steps = ("zalgo", "spacing", "leet")
    return rows.filter(plain).withColumn(out, normalised(text, steps)).unionByName(rows.filter(~plain).withColumn(out, normalised(text)))


def rule_pattern(pattern: str, kind: str, case_sensitive: bool = False) -> str:
    """A rule's regular expression: regex, exact (whole text), wildcard (* and ?), contains, fuzzy (as contains)."""
    kind = kind.lower()
    if kind == "regex":
        body = pattern
    elif kind == "exact":
        body = f"^{re.escape(pattern)}$"
    elif kind == "wildcard":
        body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    else:
        body = re.escape(pattern)
    return body if case_sensitive else f"(?iu){body}"


def rule_matches(text, pattern: str, kind: str, case_sensitive: bool = False, bypass: tuple[str, ...] = ()) -> Column:
    """The rule's pattern is in the text or, with bypass kinds, in the normalised text."""
    found = _text(text).rlike(rule_pattern(pattern, kind, case_sensitive))
    return found | normalised(text, bypass).rlike(rule_pattern(pattern, kind, case_sensitive)) if bypass else found


# Severities and categories of the platform's actions and log types.
SEVERITY = {"log": 1, "delete": 2, "warn": 3, "mute": 4, "kick": 5, "ban": 6}
PRIORITY = {"low": 1, "medium": 2, "high": 3, "urgent": 4}
LOG_CATEGORIES = {
    "message": "message_delete message_edit message_bulk_delete",
    "member": "member_join member_leave member_update member_ban member_unban",
    "role": "role_create role_delete role_update",
    "channel": "channel_create channel_delete channel_update",
    "guild": "guild_update",
    "voice": "voice_join voice_leave voice_move voice_mute voice_deafen",
    "moderation": "mod_warn mod_mute mod_unmute mod_kick mod_ban mod_unban mod_timeout",
    "automod": "automod_action filter_match antiraid_trigger antinuke_trigger",
    "ticket": "ticket_create ticket_close ticket_claim",
    "bot": "bot_error bot_command",
}


def lookup(values: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def severity(action: Column) -> Column:
    return lookup(SEVERITY, action, 0)


def log_category(kind: Column) -> Column:
    return lookup({t: c for c, types in LOG_CATEGORIES.items() for t in types.split()}, kind, "other")
