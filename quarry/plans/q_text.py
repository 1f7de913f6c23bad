"""Queries of the text, number, time and hash functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import hashing as H
from quarry.functions import numbers as N
from quarry.functions import text as X
from quarry.operators import filters

from .registry import load, register

SAMPLES = [
    "", "a", "HELLO WORLD THIS IS LOUD", "Hello World", "visit https://example.com/path?q=1 now", "http://localhost:8080/x",
    "join discord.gg/abc-123 and DISCORD.COM/invite/XYZ", "<@12345678901234567> hi <@!123456789012345678>", "<@&12345678901234567890> <#12345678901234567>",
    "@everyone look", "@here", "<@11111111111111111><@11111111111111112><@11111111111111113><@11111111111111114><@11111111111111115>",
    "emoji 😀😀 and ☀ and <:smile:123456789012345678>", "😀 😀 😀 😀 😀 😀 😀 😀 😀 😀 😀", "#ff00aa", "abc", "#12345", "user.name+tag@example.co.uk", "bad@address", "line1\nline2\n\nline4",
    "spam spam spam spam spam spam spam", "*bold* _under_ `code` [x](y)!", "id 12345678901234567 and 99999999999999999999 and 123", "nàme café", "1337 h4x0r $!+", "a b c d", "https://img.example.org/pic.PNG?x=1",
    "   ", "per_cent%", "12345678901234567", "00000000000000000",
]


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The samples and all documents, whose ids come after.
SAMPLE_SQL = "(SELECT id::BIGINT AS id, t FROM (VALUES " + ", ".join(f"({i}, {_literal(t)})" for i, t in enumerate(SAMPLES)) + ") AS v(id, t) UNION ALL SELECT doc_id + 100, text FROM documents) AS s"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("id"), F.col("text").alias("t"))
    return spark.createDataFrame(list(enumerate(SAMPLES)), "id long, t string").unionByName(documents)


def _sample(name: str, column, sql: str) -> None:
    register(name, f"SELECT id, {sql} AS v FROM {SAMPLE_SQL}")(lambda spark, sf_dir: samples(spark, sf_dir).select("id", column().alias("v")))


RE_INVITE = "(?i)(?:https?://)?(?:www\\.)?(?:discord\\.(?:gg|io|me|li)|discordapp\\.com/invite|discord\\.com/invite)/([a-zA-Z0-9\\-]+)"
RE_URL = X.URL
RE_EMOJI = X.EMOJI_RUN
COUNT_EMOJI = f"len(regexp_extract_all(t, '{X.CUSTOM_EMOJI}')) + len(regexp_extract_all(t, '{RE_EMOJI}'))"
LETTERS = r"length(regexp_replace(t, '[^\p{L}]', '', 'g'))"
UPPERS = r"length(regexp_replace(t, '[^\p{Lu}]', '', 'g'))"
CAPS = f"({LETTERS} >= 10 AND {UPPERS}::DOUBLE / greatest({LETTERS}, 1) > 0.7)"
MASS = f"(contains(t, '@everyone') OR contains(t, '@here') OR len(regexp_extract_all(t, '{X.MENTION}')) >= 5)"
WORDS = r"list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')"
REPETITIVE = f"(len({WORDS}) > 5 AND len(list_distinct({WORDS}))::DOUBLE / greatest(len({WORDS}), 1) < 0.2)"

for _name, _column, _sql in [
    ("txt_truncate", lambda: X.truncate("t", 12), "CASE WHEN length(t) <= 12 THEN t ELSE substring(t, 1, 9) || '...' END"),
    ("txt_sanitize", lambda: X.sanitize("t", False), "regexp_replace(regexp_replace(replace(replace(replace(t, '@everyone', '@' || chr(8203) || 'everyone'), '@here', '@' || chr(8203) || 'here'), chr(10), ' '), '<@!?(\\d+)>', '<@' || chr(8203) || '\\1>', 'g'), '<@&(\\d+)>', '<@&' || chr(8203) || '\\1>', 'g')"),
    ("txt_escape_markdown", lambda: X.escape_markdown("t"), "regexp_replace(t, '([*_`~|>#\\-+=\\[\\]()!])', '\\\\\\1', 'g')"),
    ("txt_ids", lambda: F.array_join(F.transform(X.extract_ids("t"), lambda x: x.cast("string")), ","), "array_to_string(list_transform(regexp_extract_all(t, '\\d{17,20}'), lambda x: x::DECIMAL(20, 0)::VARCHAR), ',')"),
    ("txt_urls", lambda: F.array_join(X.urls("t"), ","), f"array_to_string(regexp_extract_all(t, '{RE_URL}'), ',')"),
    ("txt_invites", lambda: F.array_join(X.invites("t"), ","), f"array_to_string(regexp_extract_all(t, '{RE_INVITE}', 1), ',')"),
    ("txt_mentions", lambda: F.array_join(F.transform(X.mentions("t"), lambda x: x.cast("string")), ","), f"array_to_string(regexp_extract_all(t, '{X.MENTION}', 1), ',')"),
    ("txt_role_mentions", lambda: F.array_join(F.transform(X.role_mentions("t"), lambda x: x.cast("string")), ","), f"array_to_string(regexp_extract_all(t, '{X.ROLE_MENTION}', 1), ',')"),
    ("txt_channel_mentions", lambda: F.array_join(F.transform(X.channel_mentions("t"), lambda x: x.cast("string")), ","), f"array_to_string(regexp_extract_all(t, '{X.CHANNEL_MENTION}', 1), ',')"),
    ("txt_leading_mention", lambda: X.leading_mention("t").cast("string"), f"nullif(regexp_extract(t, '^{X.MENTION}', 1), '')"),
    ("txt_custom_emojis", lambda: F.array_join(F.transform(X.custom_emojis("t"), lambda e: e["name"]), ","), f"array_to_string(regexp_extract_all(t, '{X.CUSTOM_EMOJI}', 1), ',')"),
    ("txt_emoji_count", lambda: X.count_emojis("t").cast("long"), f"({COUNT_EMOJI})::BIGINT"),
    ("txt_is_emoji", lambda: X.is_emoji("t"), f"regexp_matches(t, '^(?:{X.CUSTOM_EMOJI}|{RE_EMOJI})')"),
    ("txt_hex_color", lambda: X.hex_color("t"), f"CASE WHEN regexp_matches(t, '{X.HEX_COLOR}') THEN ('0x' || CASE WHEN length(regexp_extract(t, '{X.HEX_COLOR}', 1)) = 3 THEN regexp_replace(regexp_extract(t, '{X.HEX_COLOR}', 1), '(.)', '\\1\\1', 'g') ELSE regexp_extract(t, '{X.HEX_COLOR}', 1) END)::BIGINT END"),
    ("txt_email", lambda: X.is_email("t"), f"regexp_matches(t, '{X.EMAIL}')"),
    ("txt_snowflake", lambda: X.is_snowflake("t"), "regexp_matches(t, '^\\d{17,20}$') AND NOT regexp_matches(t, '^0+$')"),
    ("txt_url_valid", lambda: X.is_url("t"), "regexp_matches(t, '^(?i:https?)://[^/?#]+')"),
    ("txt_url_image", lambda: X.is_image_url("t"), "regexp_matches(lower(regexp_extract(t, '^(?i:https?)://[^/?#]+([^?#;]*)', 1)), '\\.(png|jpg|jpeg|gif|webp|bmp)$')"),
    ("txt_mass_mentions", lambda: X.mass_mentions("t"), MASS),
    ("txt_caps", lambda: X.caps("t"), CAPS),
    ("txt_emoji_spam", lambda: X.emoji_spam("t"), f"({COUNT_EMOJI}) > 10"),
    ("txt_newlines", lambda: X.newline_count("t").cast("long"), "(length(t) - length(replace(t, chr(10), '')))::BIGINT"),
    ("txt_repetitive", lambda: X.repetitive("t"), REPETITIVE),
    ("txt_username", lambda: X.sanitize_username("t"), "CASE WHEN trim(regexp_replace(regexp_replace(t, '[^\\pL\\pM\\pN_\\s-]', '', 'g'), '\\s+', ' ', 'g')) = '' THEN 'User' ELSE substring(trim(regexp_replace(regexp_replace(t, '[^\\pL\\pM\\pN_\\s-]', '', 'g'), '\\s+', ' ', 'g')), 1, 32) END"),
    ("txt_command_name", lambda: X.is_command_name("t"), "regexp_full_match(t, '[a-z][a-z0-9_-]{0,31}')"),
    ("txt_prefix_error", lambda: X.prefix_error("t"), "CASE WHEN t = '' THEN 'Prefix cannot be empty' WHEN length(t) > 5 THEN 'Prefix must be 5 characters or less' WHEN regexp_full_match(t, '\\s+') THEN 'Prefix cannot be only whitespace' WHEN contains(t, '@') THEN 'Prefix cannot contain @' END"),
    ("txt_reason", lambda: X.reason("t", 20), "CASE WHEN regexp_full_match(t, '\\s*') THEN 'No reason provided' WHEN length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) <= 20 THEN regexp_replace(t, '^\\s+|\\s+$', '', 'g') ELSE substring(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), 1, 17) || '...' END"),
    ("txt_user_id", lambda: X.user_id("t").cast("string"), f"coalesce(nullif(regexp_extract(t, '^{X.MENTION}', 1), ''), CASE WHEN regexp_full_match(trim(t), '[1-9]\\d{{16,19}}') THEN trim(t) END)"),
    ("txt_template", lambda: X.fill_template(F.lit("{user} joined {server} as {count}"), {"user": F.col("t"), "server": F.lit("S"), "count": F.col("id")}), "replace(replace(replace('{user} joined {server} as {count}', '{user}', t), '{server}', 'S'), '{count}', id::VARCHAR)"),
    ("txt_strip_marks", lambda: X.strip_marks("t"), "regexp_replace(t, '\\p{Mn}', '', 'g')"),
    ("txt_join_spaced", lambda: X.join_spaced("t"), "regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'), '([\\pL\\pM\\pN_])\\s+([\\pL\\pM\\pN_])', '\\1\\2', 'g')"),
    ("txt_ordinal", lambda: X.ordinal(F.col("id")), "id::VARCHAR || CASE WHEN id % 100 BETWEEN 11 AND 13 THEN 'th' WHEN id % 10 = 1 THEN 'st' WHEN id % 10 = 2 THEN 'nd' WHEN id % 10 = 3 THEN 'rd' ELSE 'th' END"),
    ("txt_pluralize", lambda: X.pluralize(F.lit("row"), F.col("id")), "CASE WHEN id = 1 THEN 'row' ELSE 'rows' END"),
    ("txt_human_join", lambda: X.human_join(F.slice(X.words("t"), 1, 4)), f"CASE WHEN len(({WORDS})[1:4]) = 0 THEN '' WHEN len(({WORDS})[1:4]) = 1 THEN ({WORDS})[1] WHEN len(({WORDS})[1:4]) = 2 THEN ({WORDS})[1] || ' and ' || ({WORDS})[2] ELSE array_to_string(({WORDS})[1:len(({WORDS})[1:4]) - 1], ', ') || ', and ' || ({WORDS})[len(({WORDS})[1:4])] END"),
    ("txt_link_allowed", lambda: X.allowed_link(X.urls("t"), F.array(F.lit("example.com"), F.lit("safe.org"))), f"len(list_filter(regexp_extract_all(t, '{RE_URL}'), lambda u: contains(u, 'example.com') OR contains(u, 'safe.org'))) > 0"),
    ("hsh_short", lambda: H.short_hash(F.col("t")), "substring(sha256(t), 1, 16)"),
]:
    _sample(_name, _column, _sql)



def _leet_sql(t: str) -> str:
    for token, letter in X.LEET:
        t = f"replace({t}, '{token}', '{letter}')"
    return t


_sample("txt_leet", lambda: X.decode_leet("t"), _leet_sql("t"))
_SPACED = "regexp_replace(regexp_replace(regexp_replace(text, '\\p{Mn}', '', 'g'), '\\s+', ' ', 'g'), '([\\pL\\pM\\pN_])\\s+([\\pL\\pM\\pN_])', '\\1\\2', 'g')"
#: Normalised texts without compatibility characters, as those of the tables are: there NFC is NFKC.
NORMAL_SQL = _leet_sql(f"translate(nfc_normalize({_SPACED}), '{X.LOOK_ALIKE[0]}', '{X.LOOK_ALIKE[1]}')")


@register("txt_normalised", f"SELECT doc_id, md5({NORMAL_SQL}) AS normalised FROM documents")
def normalised(spark, sf_dir):
    """All four steps against evasion, over whole documents; only texts beyond ASCII visit Python."""
    rows = X.with_normalised(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.md5("normalised").alias("normalised"))


_T = lambda sql: sql.replace("(t,", "(text,").replace("(t)", "(text)")


@register(
    "txt_spam_reason",
    f"SELECT conv_id, turn, CASE WHEN length(text) > 2000 THEN 'Message too long' WHEN {_T(CAPS)} THEN 'Excessive caps' WHEN ({_T(COUNT_EMOJI)}) > 10 THEN 'Too many emojis' WHEN {_T(MASS)} THEN 'Mass mentions' "
    "WHEN len(list_filter(range(3, length(text) // 6 + 1), lambda n: contains(array_to_string(list_transform(range(1, len(c) - n + 1), lambda i: "
    "CASE WHEN c[i] = c[i + n] AND c[i] <> chr(10) AND c[i] <> chr(13) THEN '1' ELSE '0' END), ''), repeat('1', 5 * n)))) > 0 THEN 'Repeating pattern' "
    f"WHEN {_T(REPETITIVE)} THEN 'Repetitive words' END AS reason FROM (SELECT *, string_split(text, '') AS c FROM conversations)",
)
def spam(spark, sf_dir):
    """The first reason in order; for the back reference SQL looks for characters that equal those n places on, 5 n in a row."""
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", X.spam_reason("text").alias("reason"))


register(
    "txt_documents",
    f"SELECT doc_id, {CAPS.replace('(t,', '(text,')} AS caps, ({COUNT_EMOJI.replace('(t,', '(text,')})::BIGINT AS emojis, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS newlines, "
    f"len(regexp_extract_all(text, '{RE_URL}'))::BIGINT AS urls, len(regexp_extract_all(text, '{RE_INVITE}', 1))::BIGINT AS invites FROM documents",
)(
    lambda spark, sf_dir: load(spark, sf_dir, "documents").select(
        "doc_id", X.caps("text").alias("caps"), X.count_emojis("text").cast("long").alias("emojis"), X.newline_count("text").cast("long").alias("newlines"),
        F.size(X.urls("text")).cast("long").alias("urls"), F.size(X.invites("text")).cast("long").alias("invites"),
    )
)
register(
    "txt_page_urls",
    "SELECT page_id, regexp_matches(url, '^(?i:https?)://[^/?#]+') AS valid, regexp_matches(lower(regexp_extract(url, '^(?i:https?)://[^/?#]+([^?#;]*)', 1)), '\\.(png|jpg|jpeg|gif|webp|bmp)$') AS image FROM pages",
)(lambda spark, sf_dir: load(spark, sf_dir, "pages").select("page_id", X.is_url("url").alias("valid"), X.is_image_url("url").alias("image")))

# Numbers, levels, durations, times.
LEVEL_SQL = """SELECT event_id, level, total - spent AS rest FROM (
    SELECT event_id, total, max(n) AS level, max(spent) AS spent FROM (SELECT event_id, event_id * 37 AS total FROM events)
    JOIN (SELECT n, sum(5 * n * n + 50 * n + 100) FILTER (n > 0) OVER (ORDER BY n) AS s, coalesce(s, 0)::BIGINT AS spent FROM range(0, (SELECT 2 + cbrt(max(event_id) * 37 * 3 / 5.0)::BIGINT FROM events)) r(n)) ON spent <= total GROUP BY ALL)"""


def _two_sql(x: str) -> str:
    return f"printf('%.2f', {x})"


for _name, _sql, _column in [
    ("fmt_number", f"CASE WHEN n >= 1000000000 THEN {_two_sql('n / 1e9')} || 'B' WHEN n >= 1000000 THEN {_two_sql('n / 1e6')} || 'M' WHEN n >= 1000 THEN {_two_sql('n / 1e3')} || 'K' ELSE n::VARCHAR END", lambda: N.format_number(F.col("n"))),
    ("fmt_bytes", f"CASE WHEN n < 1024 THEN {_two_sql('n::DOUBLE')} || ' B' WHEN n < 1048576 THEN {_two_sql('n / 1024.0::DOUBLE')} || ' KB' WHEN n < 1073741824 THEN {_two_sql('n / 1048576.0::DOUBLE')} || ' MB' ELSE {_two_sql('n / 1073741824.0::DOUBLE')} || ' GB' END", lambda: N.format_bytes(F.col("n"))),
    ("fmt_duration", "CASE WHEN s = 0 THEN '0 seconds' ELSE regexp_replace(array_to_string(list_filter([CASE WHEN s // 86400 > 0 THEN (s // 86400) || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END END, CASE WHEN s % 86400 // 3600 > 0 THEN (s % 86400 // 3600) || ' hour' || CASE WHEN s % 86400 // 3600 = 1 THEN '' ELSE 's' END END, CASE WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || ' minute' || CASE WHEN s % 3600 // 60 = 1 THEN '' ELSE 's' END END, CASE WHEN s % 60 > 0 THEN (s % 60) || ' second' || CASE WHEN s % 60 = 1 THEN '' ELSE 's' END END], lambda x: x IS NOT NULL), ', '), ', ([^,]*)$', ' and \\1') END", lambda: N.format_duration(F.col("s"))),
    ("lvl_cost", "(5 * l * l + 50 * l + 100)::BIGINT", lambda: N.level_cost(F.col("l"))),
    ("met_capacity", "(CASE WHEN floor(s * 60 / 10 / 2 * 0.5) < 50 THEN 'limited' WHEN floor(s * 60 / 10 / 2 * 0.5) < 200 THEN 'small-medium' ELSE 'excellent' END)", lambda: N.capacity_tier(N.capacity(F.col("s")))),
    ("dat_snowflake", "((((event_id * 1000003) << 22) >> 22) + 1420070400000)::BIGINT", lambda: F.unix_millis(N.snowflake_time(F.shiftleft(F.col("event_id") * 1000003, 22)))),
    ("dat_millis", "epoch_us(ts) // 1000", lambda: N.to_millis(F.col("ts"))),
    ("dat_millis_back", "epoch_us(ts) // 1000", lambda: N.to_millis(N.from_millis(N.to_millis(F.col("ts"))))),
    ("dat_stamp", "'<t:' || floor(epoch(ts))::BIGINT || ':R>'", lambda: N.format_timestamp(F.col("ts"), "R")),
    ("dat_age_days", "floor((epoch_us(TIMESTAMP '2030-01-01') - epoch_us(ts)) / 86400000000)::BIGINT", lambda: N.age_days(F.col("ts"), F.lit("2030-01-01").cast("timestamp"))),
    ("dat_expired", "ts <= TIMESTAMP '2024-01-15'", lambda: N.expired(F.col("ts").cast("timestamp"), F.lit("2024-01-15").cast("timestamp"))),
    ("dat_iso", "epoch_us(ts)", lambda: N.micros(F.to_timestamp(F.col("ts").cast("string")))),
    ("dat_healthy", "epoch_us(TIMESTAMP '2024-01-15') - epoch_us(ts) < 30000000 AND event_type = 'click'", lambda: N.healthy(F.when(F.col("event_type") == "click", "active").otherwise("down"), F.col("ts"), F.lit("2024-01-15").cast("timestamp"))),
    ("jsn_field", "json_extract_string(props, '$.k')", lambda: F.get_json_object("props", "$.k")),
    ("jsn_typed", "(json_extract_string(props, '$.k'))::BIGINT", lambda: F.from_json("props", "k long")["k"]),
    ("jsn_settings_defaults", "coalesce((json_extract_string(props, '$.k'))::BIGINT, 5) * 10 + 7", lambda: F.coalesce(F.from_json("props", "k long, missing long")["k"], F.lit(5)) * 10 + F.coalesce(F.from_json("props", "k long, missing long")["missing"], F.lit(7))),
    ("arr_member", "list_contains(['click', 'view'], event_type)", lambda: F.array_contains(F.array(F.lit("click"), F.lit("view")), F.col("event_type"))),
    ("arr_overlap", "list_has_any([event_type, 'z'], ['click', 'view'])", lambda: F.arrays_overlap(F.array(F.col("event_type"), F.lit("z")), F.array(F.lit("click"), F.lit("view")))),
    ("arr_append_absent", "array_to_string(CASE WHEN event_type IN ('click', 'view') THEN ['click', 'view'] ELSE ['click', 'view', event_type] END, ',')", lambda: F.array_join(F.array_union(F.array(F.lit("click"), F.lit("view")), F.array("event_type")), ",")),
    ("arr_remove", "array_to_string(list_filter(['click', 'view'], lambda x: x <> event_type), ',')", lambda: F.array_join(F.array_remove(F.array(F.lit("click"), F.lit("view")), F.col("event_type")), ",")),
    ("set_array_except", "array_to_string(list_filter(['click', 'view', 'error'], lambda x: x <> event_type), ',')", lambda: F.array_join(F.array_except(F.array(F.lit("click"), F.lit("view"), F.lit("error")), F.array("event_type")), ",")),
    ("map_severity", "CASE event_type WHEN 'purchase' THEN 5 WHEN 'error' THEN 3 ELSE 0 END", lambda: X.severity(F.when(F.col("event_type") == "purchase", "kick").when(F.col("event_type") == "error", "warn").otherwise("?"))),
    ("map_log_category", "CASE event_type WHEN 'purchase' THEN 'ticket' WHEN 'error' THEN 'bot' ELSE 'other' END", lambda: X.log_category(F.when(F.col("event_type") == "purchase", "ticket_close").when(F.col("event_type") == "error", "bot_error").otherwise("?"))),
    ("hsh_row_key", "md5('event_id=' || event_id || '|' || 'event_type=' || event_type)", lambda: H.row_key(["event_type", "event_id"])),
    ("idx_hash_bucket", "('0x' || right(md5(event_id::VARCHAR), 3))::INTEGER % 1024", lambda: H.hash_bucket(F.col("event_id"))),
]:
    register(_name, f"SELECT event_id, {_sql} AS v FROM (SELECT *, event_id * event_id * 970 + 3 AS n, event_id * 89 AS s, event_id % 200 AS l FROM events)")(
        lambda spark, sf_dir, column=_column: load(spark, sf_dir, "events")
        .withColumns({"n": F.expr("event_id * event_id * 970 + 3"), "s": F.expr("event_id * 89"), "l": F.expr("event_id % 200")})
        .select("event_id", column().alias("v"))
    )

register("lvl_from_xp", LEVEL_SQL.replace("SELECT event_id, level,", "SELECT event_id, level::BIGINT AS level,", 1))(
    lambda spark, sf_dir: load(spark, sf_dir, "events").select("event_id", N.level_of(F.col("event_id") * 37).alias("l")).select("event_id", "l.level", "l.rest")
)

_SPELLINGS = [(name, seconds) for names, seconds in N.UNITS.items() for name in names.split()]
_SECONDS = f"[{', '.join(str(n) for _, n in _SPELLINGS)}]"


@register(
    "dat_parse_duration",
    f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN (event_id % 90)::BIGINT WHEN 1 THEN NULL ELSE nullif(k * u, 0) + CASE WHEN event_id % 5 = 2 AND u <> 604800 THEN 604800 * 2 ELSE 0 END END::BIGINT AS seconds "
    f"FROM (SELECT event_id, event_id % 40 + 1 AS k, {_SECONDS}[event_id % {len(_SPELLINGS)} + 1] AS u FROM events)",
)
def parse_duration(spark, sf_dir):
    """Every spelling with numbers, alone or beside weeks, bare numbers and texts that are no duration."""
    unit = F.get(F.array(*[F.lit(n) for n, _ in _SPELLINGS]), (F.col("event_id") % len(_SPELLINGS)).cast("int"))
    k, kind = F.concat((F.col("event_id") % 40 + 1).cast("string"), F.when(F.col("event_id") % 2 == 0, " ").otherwise(""), F.when(F.col("event_id") % 3 == 0, F.upper(unit)).otherwise(unit)), F.col("event_id") % 5
    text = (
        F.when(kind == 0, (F.col("event_id") % 90).cast("string")).when(kind == 1, F.concat(F.lit("soon"), unit))
        .when((kind == 2) & ~unit.startswith("w"), F.concat(k, F.lit(" 2w"))).otherwise(k)
    )
    return load(spark, sf_dir, "events").select("event_id", N.parse_duration(text).alias("seconds"))


@register("lvl_progress", "SELECT event_id, '`[' || repeat('█', (event_id % 101) // 10) || repeat('░', 10 - (event_id % 101) // 10) || ']` ' || printf('%.1f', (event_id % 101)::DOUBLE) || '%' AS bar FROM events")
def progress_bar(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", N.progress_bar((F.col("event_id") % 101).cast("double")).alias("bar"))


def _mix_sql(x: str) -> str:
    """The finalizer in 128-bit arithmetic."""
    for m in H.MULTIPLIERS:
        x = f"(((xor({x}, ({x}) >> 33))::UHUGEINT * {m}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"xor({x}, ({x}) >> 33)"


@register(
    "hsh_whiten",
    "SELECT event_id, (" + _mix_sql("x") + ")::DECIMAL(20, 0) AS whitened FROM (SELECT event_id, xor(h, ((l << 17) % 4294967296) | (l >> 15)) * 4294967296 + xor(l, ((h << 13) % 4294967296) | (h >> 19)) AS x "
    "FROM (SELECT event_id, (id >> 32)::UBIGINT AS h, (id % 4294967296)::UBIGINT AS l FROM (SELECT event_id, (event_id % 1000003 * 4398046511111)::UBIGINT AS id FROM events)))",
)
def whitened(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", H.whiten_column(F.col("event_id") % 1000003 * 4398046511111).alias("whitened"))


@register("hsh_place")
def places(spark, sf_dir):
    """BLAKE2b of whitened ids, which SQL lacks."""
    return load(spark, sf_dir, "events").select("event_id", H.guild_hash_column("event_id").alias("place"))


@register("hsh_random_id", "SELECT n_nationkey, true AS well_formed FROM nation")
def random_ids(spark, sf_dir):
    """Random ids differ with every run; their form does not."""
    return load(spark, sf_dir, "nation").select("n_nationkey", H.random_id("T").rlike("^T-[0-9A-F]{8}$").alias("well_formed"))


@register("hsh_query_key", "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}') AS k FROM nation")
def query_keys(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", H.query_key(["n_nationkey", "n_name"]).alias("k"))


M, K = H.bloom_shape(500)


def _bloom_sql(i: int) -> str:
    h = f"md5(c_custkey::VARCHAR::BLOB || '\\x{i:02X}\\x00\\x00\\x00'::BLOB)"
    return f"('0x' || substring({h}, 7, 2) || substring({h}, 5, 2) || substring({h}, 3, 2) || substring({h}, 1, 2))::BIGINT % {M}"


_POSITIONS = "[" + ", ".join(_bloom_sql(i) for i in range(K)) + "]"


@register("bloom_positions", f"SELECT c_custkey, array_to_string({_POSITIONS}, ',') AS bits FROM customer")
def bloom_positions(spark, sf_dir):
    bits = H.bloom_positions(F.col("c_custkey"), M, K)
    return load(spark, sf_dir, "customer").select("c_custkey", F.array_join(bits.cast("array<string>"), ",").alias("bits"))


#: The same positions in a filter that is sized by the keys it holds.
_SIZED = _POSITIONS.replace(f"% {M}", "% m")


@register(
    "bloom_members",
    "WITH n AS (SELECT greatest(64, floor(-count(*) * ln(0.01::DOUBLE) / (ln(2::DOUBLE) * ln(2::DOUBLE))))::BIGINT AS m FROM customer WHERE c_custkey % 7 = 0), "
    f"p AS (SELECT c_custkey, {_SIZED} AS bits FROM customer, n), f AS (SELECT list(DISTINCT bit) AS set_bits FROM (SELECT unnest(bits) AS bit FROM p WHERE c_custkey % 7 = 0)) "
    "SELECT c_custkey, list_has_all(set_bits, bits) AS maybe FROM p, f",
)
def bloom_members(spark, sf_dir):
    """A filter of every seventh customer, as large as its keys ask, asked for all: no false negatives."""
    every = load(spark, sf_dir, "customer").select("c_custkey")
    held = every.filter("c_custkey % 7 = 0")
    m, _ = H.bloom_shape(held.count())
    return filters.asked(every, "c_custkey", filters.filter_words(held, "c_custkey", m, K), m, K)
