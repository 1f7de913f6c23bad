"""Queries of joins, detectors, recurrences, placement, unions, roll-ups and search."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.numbers import seconds_between
from quarry.operators import detect, fanout, folds, joins, metrics, pieces, placement, similarity

from . import q_text, recurrence_sql
from .registry import load, register

EVENTS = "(SELECT *, user_id % 7 AS guild_id FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("guild_id", F.col("user_id") % 7)


def _trailing_sql(keys: str, seconds: int) -> str:
    return f"count(*) OVER (PARTITION BY {keys} ORDER BY epoch_us(ts) RANGE BETWEEN {seconds * 1_000_000 - 1} PRECEDING AND CURRENT ROW)"


# Joins.
@register("join_config", "SELECT event_id, n_name FROM events LEFT JOIN nation ON user_id % 30 = n_nationkey")
def join_config(spark, sf_dir):
    config = load(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "nation")
    return joins.with_config(load(spark, sf_dir, "events").withColumn("nation", (F.col("user_id") % 30).cast("int")), config, "nation").select("event_id", "n_name")


@register("join_exempt", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def join_exempt(spark, sf_dir):
    exempt = load(spark, sf_dir, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("user_id"))
    return joins.without_exempt(load(spark, sf_dir, "events"), exempt, "user_id").select("event_id")


@register("join_exempt_roles", "SELECT event_id FROM events WHERE event_type NOT IN ('view', 'error')")
def join_exempt_roles(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("roles", F.array(F.col("event_type"), F.lit("member")))
    return joins.without_exempt_roles(rows, "roles", ["view", "error"]).select("event_id")


@register("join_afk", "SELECT e.event_id, c.c_custkey AS mentioned, c.c_name FROM (SELECT event_id, unnest(list_distinct([event_id % 50, event_id % 70])) AS m FROM events) e JOIN customer c ON c.c_custkey = e.m WHERE c.c_nationkey % 2 = 0")
def join_afk(spark, sf_dir):
    away = load(spark, sf_dir, "customer").filter("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    messages = load(spark, sf_dir, "events").select("event_id")
    return joins.afk_mentions(messages, F.array(F.expr("event_id % 50"), F.expr("event_id % 70")), away).select("event_id", "mentioned", "c_name")


@register(
    "join_chats",
    "WITH c AS (SELECT event_id, user_id % 20 AS a, event_id % 20 AS b FROM events) SELECT event_id FROM c "
    "WHERE EXISTS (SELECT 1 FROM c p WHERE p.event_id % 10 = 0 AND ((p.a = c.a AND p.b = c.b) OR (p.a = c.b AND p.b = c.a)))",
)
def join_chats(spark, sf_dir):
    chats = load(spark, sf_dir, "events").select("event_id", F.expr("user_id % 20").alias("sender_id"), F.expr("event_id % 20").alias("receiver_id"))
    return joins.chats_between(chats, chats.filter("event_id % 10 = 0")).select("event_id")


@register(
    "join_escalation",
    "SELECT c_custkey, CASE WHEN n >= 10 THEN 'ban' WHEN n >= 7 THEN 'kick' WHEN n >= 3 THEN 'mute' END AS action, CASE WHEN n >= 10 THEN 10 WHEN n >= 7 THEN 7 WHEN n >= 5 THEN 5 WHEN n >= 3 THEN 3 END AS threshold "
    "FROM (SELECT c_custkey, c_custkey % 13 AS n FROM customer)",
)
def join_escalation(spark, sf_dir):
    p = joins.punishment(F.col("c_custkey") % 13)
    return load(spark, sf_dir, "customer").select("c_custkey", p["action"].alias("action"), p["threshold"].alias("threshold"))


@register("join_names", "SELECT e.user_id, e.n, coalesce(c_name, 'User#' || e.user_id) AS name FROM (SELECT user_id + 100 AS user_id, count(*) AS n FROM events GROUP BY 1) e LEFT JOIN customer ON c_custkey = e.user_id")
def join_names(spark, sf_dir):
    board = load(spark, sf_dir, "events").groupBy((F.col("user_id") + 100).alias("user_id")).agg(F.count("*").alias("n"))
    members = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return joins.with_names(board, members, "user_id", "name")


@register(
    "join_rules",
    "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license') AND source <> 'src1' THEN 'r1' WHEN contains(lower(text), 'token') THEN 'r2' WHEN regexp_matches(text, '(?i)the.{1}on') THEN 'r3' END AS rule FROM documents",
)
def join_rules(spark, sf_dir):
    rules = [
        {"id": "r1", "pattern": "license", "kind": "regex", "exempt": {"source": ["src1"]}},
        {"id": "off", "pattern": "e", "kind": "contains", "enabled": False},
        {"id": "r2", "pattern": "token", "kind": "contains"},
        {"id": "r3", "pattern": "the?on", "kind": "wildcard"},
    ]
    return detect.apply_rules(load(spark, sf_dir, "documents"), rules).select("doc_id", "rule")


@register(
    "join_rules_bypass",
    f"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)password') OR regexp_matches({q_text.NORMAL_SQL}, '(?i)password') THEN 'b1' WHEN contains(lower(text), 'theon') OR contains(lower({q_text.NORMAL_SQL}), 'theon') THEN 'b2' END AS rule FROM documents",
)
def join_rules_bypass(spark, sf_dir):
    """Rules against evasive spelling."""
    every = ["spacing", "leet", "unicode", "zalgo"]
    rules = [{"id": "b1", "pattern": "password", "kind": "regex", "bypass": every}, {"id": "b2", "pattern": "theon", "kind": "contains", "bypass": every}]
    return detect.apply_rules(load(spark, sf_dir, "documents"), rules).select("doc_id", "rule")


@register("dom_command_lists", "SELECT event_id, (user_id NOT IN (3, 5) AND event_type <> 'error' AND guild_id IN (0, 1, 2)) AS allowed FROM " + EVENTS)
def command_lists(spark, sf_dir):
    ok = joins.may_use(F.col("user_id"), F.col("guild_id"), F.array("event_type"), {"user": [3, 5], "role": ["error"]}, {"channel": [0, 1, 2]})
    return events(spark, sf_dir).select("event_id", ok.alias("allowed"))


# Trailing windows and ranks.
@register("win_trailing_spam", f"SELECT event_id, {_trailing_sql('guild_id', 600)} AS recent FROM {EVENTS}")
def trailing(spark, sf_dir):
    return detect.trailing_count(events(spark, sf_dir), ["guild_id"], 600).select("event_id", "recent")


@register("win_spam_alerts", f"SELECT event_id FROM (SELECT event_id, {_trailing_sql('guild_id, user_id', 86400)} AS recent FROM {EVENTS}) WHERE recent >= 3")
def spam_alerts(spark, sf_dir):
    return detect.alerts(events(spark, sf_dir), ["guild_id", "user_id"], 86400, 3).select("event_id")


def trailing_actions() -> str:
    """SQL of the watched actions with their trailing counts."""
    return f"SELECT event_id, event_type, {_trailing_sql('event_type, guild_id, user_id', 40000)} AS recent FROM {EVENTS} WHERE event_type IN ('click', 'error') AND user_id NOT IN (1, 2)"


@register("win_nuke", f"SELECT event_id, recent FROM ({trailing_actions()}) WHERE recent >= CASE event_type WHEN 'click' THEN 2 ELSE 1 END")
def nuke(spark, sf_dir):
    return detect.mass_actions(events(spark, sf_dir), {"click": 2, "error": 1}, [1, 2], 40000).select("event_id", "recent")


@register(
    "win_leaderboard",
    "SELECT * FROM (SELECT guild_id, user_id, xp, row_number() OVER (PARTITION BY guild_id ORDER BY xp DESC, user_id)::INTEGER AS rank, ((row_number() OVER (PARTITION BY guild_id ORDER BY xp DESC, user_id) - 1) // 10)::INTEGER + 1 AS page "
    f"FROM (SELECT guild_id, user_id, sum(15 + event_id % 11)::BIGINT AS xp FROM {EVENTS} GROUP BY ALL)) WHERE rank <= 100",
)
def leaderboard(spark, sf_dir):
    totals = events(spark, sf_dir).groupBy("guild_id", "user_id").agg(F.sum(15 + F.col("event_id") % 11).alias("xp"))
    return detect.leaderboard(totals, "guild_id", "xp", "user_id")


@register(
    "win_own_rank",
    "WITH t AS (SELECT guild_id, user_id, sum(15 + event_id % 11)::BIGINT AS xp FROM (SELECT *, user_id % 7 AS guild_id FROM events) GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY guild_id ORDER BY xp DESC, user_id) AS n FROM t) "
    "SELECT g.guild_id, g.guild_id + 7 AS user_id, CASE WHEN n <= 100 THEN n END::INTEGER AS rank FROM range(0, 7) g(guild_id) LEFT JOIN r ON r.guild_id = g.guild_id AND r.user_id = g.guild_id + 7",
)
def own_rank(spark, sf_dir):
    totals = events(spark, sf_dir).groupBy("guild_id", "user_id").agg(F.sum(15 + F.col("event_id") % 11).alias("xp"))
    return detect.own_rank(totals, "guild_id", "xp", "user_id", {g: g + 7 for g in range(7)})


@register("win_daily_cap", f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY guild_id, ts::DATE ORDER BY ts, event_id) AS n FROM {EVENTS}) WHERE n <= 15")
def daily_cap(spark, sf_dir):
    return detect.first_of_day(events(spark, sf_dir), ["guild_id"]).select("event_id")


@register("win_sequence", f"SELECT event_id, row_number() OVER (PARTITION BY guild_id ORDER BY ts, event_id)::INTEGER AS number FROM {EVENTS}")
def sequence(spark, sf_dir):
    return pieces.numbered(events(spark, sf_dir), ["guild_id"]).select("event_id", "number")


@register(
    "win_status_change",
    "SELECT event_id, event_type, previous FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events WHERE event_type <> 'view') WHERE previous <> event_type",
)
def status_change(spark, sf_dir):
    return detect.changes(load(spark, sf_dir, "events"), ["user_id"], "event_type", ("view",)).select("event_id", "event_type", "previous")


@register("win_latest", "SELECT user_id, max_by(event_id, event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest(spark, sf_dir):
    return detect.latest(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id"))


@register("win_newest", "SELECT event_id, value FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 10")
def newest(spark, sf_dir):
    return load(spark, sf_dir, "events").filter("event_type = 'click'").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(10).select("event_id", "value")


@register(
    "win_strikes",
    "SELECT event_id, strike, strike >= 3 AS escalates FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INTEGER AS strike FROM events)",
)
def strikes(spark, sf_dir):
    return detect.strikes(load(spark, sf_dir, "events"), "user_id", "event_type", 3).select("event_id", "strike", "escalates")


@register(
    "win_violation_reset",
    "SELECT event_id, n % 3 = 0 AS mutes FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error')",
)
def violation_reset(spark, sf_dir):
    """Every third violation of a user mutes and starts the count again."""
    rows = pieces.numbered(load(spark, sf_dir, "events").filter("event_type = 'error'"), ["user_id"])
    return rows.select("event_id", (F.col("number") % 3 == 0).alias("mutes"))


def _over(sql: str) -> str:
    return sql.replace("(t,", "(text,").replace("(t)", "(text)")


@register(
    "txt_verdict",
    f"SELECT conv_id, turn, CASE WHEN turn >= 40 THEN 'spam' WHEN {_over(q_text.CAPS)} THEN 'excessive caps' WHEN len(regexp_extract_all(text, '{q_text.RE_INVITE}')) > 0 THEN 'invite link' "
    f"WHEN len(regexp_extract_all(text, '{X.URL}')) > 0 AND len(list_filter(regexp_extract_all(text, '{X.URL}'), lambda u: contains(u, 'example.com'))) = 0 THEN 'unauthorized link' "
    f"WHEN {_over(q_text.COUNT_EMOJI)} > 10 THEN 'emoji spam' WHEN {_over(q_text.MASS)} THEN 'mass mentions' WHEN length(text) - length(replace(text, chr(10), '')) > 10 THEN 'newline spam' END AS verdict FROM conversations",
)
def verdict(spark, sf_dir):
    """The first violation of each message in order."""
    rows = load(spark, sf_dir, "conversations").withColumn("recent", F.col("turn"))
    return rows.select("conv_id", "turn", detect.verdict("text", F.col("recent"), ["example.com"], spam=40).alias("verdict"))


# Recurrences, against recursive SQL. Those that running values express are not folded row by row.
SPLIT = {folds.Points: pieces.points, folds.Away: pieces.away, folds.Levels: pieces.levels}
for _name, _keys, _make, _values, _sql in [
    ("lim_token_bucket", ["guild_id"], partial(folds.TokenBucket, 3, 3600.0), [], recurrence_sql.token_bucket("guild_id", 3, 3600.0)),
    ("lim_token_bucket_member", ["guild_id", "user_id"], partial(folds.TokenBucket, 1, 86400.0), [], recurrence_sql.token_bucket("guild_id, user_id", 1, 86400.0)),
    ("lim_sliding_log", ["guild_id"], partial(folds.SlidingLog, 4, 7200.0), [], recurrence_sql.sliding_log("guild_id", 4, 7200.0)),
    ("lim_adaptive", ["user_id"], partial(folds.AdaptiveCooldown, 10.0), ["bad"], recurrence_sql.adaptive("user_id", 10.0)),
    ("lim_global", ["guild_id"], partial(folds.GlobalCooldown, 1800.0), [], recurrence_sql.global_cooldown("guild_id", 1800.0)),
    ("raid_lockdown", ["guild_id"], partial(folds.Lockdown, 5, 7200.0, 14400.0), [], recurrence_sql.lockdown("guild_id", 5, 7200.0, 14400.0)),
    ("mod_points", ["user_id"], folds.Points, ["change"], recurrence_sql.points("user_id")),
    ("afk_state", ["user_id"], folds.Away, ["bad"], recurrence_sql.away("user_id")),
    ("lvl_stream", ["guild_id", "user_id"], partial(folds.Levels, 15), ["gained"], recurrence_sql.levels("guild_id, user_id", 15)),
]:

    def _fold(spark, sf_dir, keys=_keys, make=_make, values=_values):
        rows = events(spark, sf_dir).withColumns({"bad": F.col("event_type") == "error", "change": F.col("event_id") % 5 - 2, "gained": 15 + F.col("event_id") % 11})
        kind = make.func if isinstance(make, partial) else make
        out = SPLIT[kind](rows, keys, values[0]) if kind in SPLIT else folds.sequential(rows, keys, make, values)
        return out.select("event_id", *folds.names((make.func if isinstance(make, partial) else make).fields))

    register(_name, _sql)(_fold)

# Placement.
RING = placement.Ring({"node-a": 1.0, "node-b": 2.0, "node-c": 0.5})


_RING_SQL = "ring(i, hash, node) AS (VALUES " + ", ".join(f"({i}, '{h}', '{n}')" for i, (h, n) in enumerate(RING.points)) + ")"
#: From each point on, the nodes by their first points, around the ring.
_WALKS_SQL = f"walks AS (SELECT i, hash, list(node ORDER BY d) AS nodes FROM (SELECT p.i, p.hash, q.node, min((q.i - p.i + {len(RING.points)}) % {len(RING.points)}) AS d FROM ring p, ring q GROUP BY ALL) GROUP BY ALL)"
_PLACED_SQL = "SELECT event_id, coalesce(nodes, (SELECT nodes FROM walks WHERE i = 0)) AS nodes FROM (SELECT event_id, md5(event_id::VARCHAR) AS place FROM events) e ASOF LEFT JOIN walks w ON e.place <= w.hash"
_SHARES = {n: w / sum(RING.weights.values()) for n, w in RING.weights.items()}


@register("join_asof_places", f"WITH {_RING_SQL}, {_WALKS_SQL} SELECT event_id, nodes[1] AS node, array_to_string(nodes[2:3], ',') AS replicas FROM ({_PLACED_SQL})")
def nodes_of_places(spark, sf_dir):
    """The as-of lookup itself, of places that SQL can make too: the nodes from the next point of the ring on, around its end."""
    nodes = load(spark, sf_dir, "events").select("event_id", placement.nodes_at(F.md5(F.col("event_id").cast("string")), RING, 3).alias("nodes"))
    return nodes.select("event_id", F.get("nodes", 0).alias("node"), F.array_join(F.slice("nodes", 2, 2), ",").alias("replicas"))


@register(
    "met_place_distribution",
    f"WITH {_RING_SQL}, {_WALKS_SQL}, w(node, share) AS (VALUES " + ", ".join(f"('{n}', {s!r}::DOUBLE)" for n, s in _SHARES.items()) + f"), c AS (SELECT nodes[1] AS node, count(*) AS n FROM ({_PLACED_SQL}) GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS total FROM c) "
    "SELECT node, coalesce(n, 0) AS n, round(coalesce(n, 0) / total * 100, 6) AS percent, round(total * share, 6) AS expected, round((coalesce(n, 0) - total * share) / (total * share) * 100, 6) AS deviation_percent FROM w LEFT JOIN c USING (node), t",
)
def place_distribution(spark, sf_dir):
    """Rows per node against the nodes' weights, of the same places."""
    placed = load(spark, sf_dir, "events").select(F.get(placement.nodes_at(F.md5(F.col("event_id").cast("string")), RING), 0).alias("node"))
    return placement.node_spread(placed, RING).withColumns({c: F.round(c, 6) for c in ("percent", "expected", "deviation_percent")})


@register("join_asof_ring")
def owners(spark, sf_dir):
    """Owners and replicas by the ids' own places, whose BLAKE2b SQL lacks."""
    nodes = load(spark, sf_dir, "events").select("event_id", placement.placed(F.col("event_id"), RING, 3).alias("nodes"))
    return nodes.select("event_id", F.get("nodes", 0).alias("node"), F.slice("nodes", 2, 2).alias("replicas"))


@register("met_ring_distribution")
def ring_distribution(spark, sf_dir):
    placed = load(spark, sf_dir, "events").select(placement.owner(F.col("event_id"), RING).alias("node"))
    return placement.node_spread(placed, RING)


@register("met_hash_distribution")
def hash_distribution(spark, sf_dir):
    return placement.spread(load(spark, sf_dir, "events").select(placement.bucket(F.col("event_id"), 100).alias("bucket")), "bucket", 100)


@register(
    "met_bucket_distribution",
    "WITH b AS (SELECT r.bucket, count(e.event_id) AS n FROM range(0, 64) r(bucket) LEFT JOIN (SELECT event_id, ('0x' || right(md5(event_id::VARCHAR), 3))::INTEGER % 64 AS bucket FROM events) e USING (bucket) GROUP BY 1) "
    "SELECT sum(n)::BIGINT AS total_ids, count(*) AS num_buckets, avg(n) AS expected_per_bucket, max(n) AS max_bucket_count, min(n) AS min_bucket_count, round(stddev_pop(n), 6) AS std_deviation, "
    "round(stddev_pop(n) / avg(n) * 100, 6) AS deviation_percent, round((max(n) - avg(n)) / avg(n) * 100, 6) AS max_deviation_from_expected FROM b",
)
def bucket_distribution(spark, sf_dir):
    from quarry.functions.hashing import hash_bucket

    rows = load(spark, sf_dir, "events").select(hash_bucket(F.col("event_id"), 64).alias("bucket"))
    out = placement.spread(rows, "bucket", 64)
    return out.withColumns({c: F.round(c, 6) for c in ("std_deviation", "deviation_percent", "max_deviation_from_expected")})


# Unions of sources.
def _order_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus")
    return [orders.filter("o_custkey % 3 = 0").withColumn("o_orderstatus", F.lit("first")), orders.filter("o_custkey % 2 = 0"), orders.filter("o_custkey % 5 = 0").drop("o_custkey")]


@register(
    "fan_union_dedupe",
    "SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 OR o_custkey % 2 = 0 THEN o_custkey END AS o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 'first' ELSE o_orderstatus END AS o_orderstatus "
    "FROM orders WHERE o_custkey % 3 = 0 OR o_custkey % 2 = 0 OR o_custkey % 5 = 0",
)
def union_dedupe(spark, sf_dir):
    return fanout.union_first(_order_sources(spark, sf_dir))


@register("fan_union_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def union_rows(spark, sf_dir):
    """Without an id, equal rows are one."""
    orders = load(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    return fanout.union_first([orders, orders])


@register("fan_first_positive", "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_custkey % 2 = 0")
def positive(spark, sf_dir):
    sources = _order_sources(spark, sf_dir)
    return fanout.first_positive([sources[0].filter("false"), sources[1], sources[2]]).select("id", "o_orderstatus")


@register(
    "fan_responses",
    "SELECT 'a' AS source, true AS responded, count(*) AS rows FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT 'b', true, count(*) FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT 'c', false, 0",
)
def responses(spark, sf_dir):
    a, b, _ = _order_sources(spark, sf_dir)
    return fanout.responses({"a": a, "b": b, "c": None})


@register("fan_node_per_cluster", "SELECT s_nationkey % 4 AS cluster_id, min_by('n' || s_suppkey, s_suppkey) AS node_id FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1")
def node_per_cluster(spark, sf_dir):
    nodes = load(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 4).alias("cluster_id"), F.concat(F.lit("n"), "s_suppkey").alias("node_id"), F.col("s_suppkey").alias("load"), (F.col("s_suppkey") % 3 != 0).alias("healthy"))
    return fanout.node_per_cluster(nodes)


# Roll-ups.
@register(
    "met_rollup",
    "SELECT event_type, sum(v)::BIGINT AS total, avg(v) AS mean, count(*) AS n FROM (SELECT event_type, event_id % 100 AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5 GROUP BY 1",
)
def rollup(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("v", F.col("event_id") % 100)
    return metrics.latest_rollup(rows, "event_type", "v", [F.col("ts").desc(), F.col("event_id").desc()])


@register("met_status", "SELECT count(*) AS total, count(*) FILTER (s_suppkey % 3 = 0) AS online, count(*) FILTER (s_suppkey % 3 <> 0) AS offline FROM supplier")
def status(spark, sf_dir):
    return metrics.status_counts(load(spark, sf_dir, "supplier").select(F.when(F.expr("s_suppkey % 3 = 0"), "online").otherwise("timeout").alias("status")))


@register("met_nodes", "SELECT s_nationkey % 5 AS shard, count(*) AS guilds, sum(s_suppkey)::BIGINT AS members FROM supplier GROUP BY 1")
def nodes(spark, sf_dir):
    return load(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 5).alias("shard")).agg(F.count("*").alias("guilds"), F.sum("s_suppkey").alias("members"))


@register(
    "met_p99",
    "SELECT event_type, n, mean_ms, ops_per_second, times[(n * 99 // 100 + 1)::BIGINT] AS p99_ms FROM (SELECT event_type, count(*) AS n, sum(ms)::BIGINT / count(*) AS mean_ms, count(*) * 1000 / sum(ms)::BIGINT AS ops_per_second, "
    "list_sort(list(ms)) AS times FROM (SELECT event_type, event_id * 7919 % 1000 + 1 AS ms FROM events) GROUP BY 1)",
)
def p99(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_type", (F.col("event_id") * 7919 % 1000 + 1).alias("ms"))
    return metrics.latency(rows, "ms", ["event_type"])


@register(
    "met_user_statistics",
    "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error, "
    "count(*) FILTER (event_type = 'signup') AS signup, epoch_us(max(ts)) AS last_seen FROM events GROUP BY 1",
)
def user_statistics(spark, sf_dir):
    out = metrics.user_statistics(load(spark, sf_dir, "events"))
    return out.withColumn("last_seen", F.unix_micros(F.col("last_seen").cast("timestamp")))


@register("met_hit_rate", "SELECT count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type <> 'click') AS misses, count(*) FILTER (event_type = 'click') / count(*) * 100 AS hit_rate FROM events")
def hit_rate(spark, sf_dir):
    return metrics.hit_rate(load(spark, sf_dir, "events"), F.col("event_type") == "click")


@register("met_strike_lists", "SELECT user_id, event_type, count(*) AS strikes, array_to_string(list_sort(list(event_id)), ',') AS at FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def strike_lists(spark, sf_dir):
    rows = load(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id", "event_type")
    return rows.agg(F.count("*").alias("strikes"), F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("at"))


@register("met_response_time", "SELECT user_id, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000)::BIGINT AS seconds FROM events GROUP BY 1")
def response_time(spark, sf_dir):
    rows = load(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return rows.select("user_id", seconds_between(F.col("a"), F.col("b")).alias("seconds"))


@register("stm_window_5min", "SELECT epoch_us(time_bucket(INTERVAL '5 minutes', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_counts(spark, sf_dir):
    """The batch form of the tumbling metric counters."""
    rows = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("window.start").alias("start"), "event_type", "n")


# Search.
QUERIES = ["large polished", "standard", "economy tin", "Part 12"]
_SIM = "CASE WHEN contains(o, q) THEN length(q)::DOUBLE / greatest(length(o), 1) ELSE 1 - levenshtein(q, o)::DOUBLE / greatest(length(q), length(o)) END"


@register(
    "sim_find_similar",
    f"SELECT p_partkey, query, {_SIM} AS similarity FROM (SELECT p_partkey, query, lower(query) AS q, lower(p_name) AS o FROM part, (VALUES "
    + ", ".join(f"('{q}')" for q in QUERIES) + f") v(query)) WHERE contains(o, q) OR {_SIM} >= 0.5",
)
def find_similar(spark, sf_dir):
    return similarity.find_similar(load(spark, sf_dir, "part"), "p_name", QUERIES, 0.5).select("p_partkey", "query", "similarity")


@register("sim_levenshtein", "SELECT p_partkey, levenshtein(p_name, p_brand)::INTEGER AS distance FROM part")
def levenshtein(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_brand").alias("distance"))


__all__ = ["EVENTS", "X", "events", "trailing_actions"]
