"""Roll-ups of metrics, hosts, nodes, users and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rollup(metrics: DataFrame, kind: str, value: str, order: list[Column], n: int = 5) -> DataFrame:
    """Sum and mean of the newest n rows of each kind."""
    number = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    newest = metrics.withColumn("_n", number).filter(F.col("_n") <= n)
    return newest.groupBy(kind).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count("*").alias("n"))


def status_counts(hosts: DataFrame, status: str = "status") -> DataFrame:
    return hosts.agg(F.count("*").alias("total"), F.count_if(F.col(status) == "online").alias("online"), F.count_if(F.col(status) != "online").alias("offline"))


def latency(times: DataFrame, ms: str, keys: list[str] = (), ranges: int = 64) -> DataFrame:
    """Operations a second, mean, and the value at rank int(0.99 n) from 0 of the sorted times.

    Ranks come from a histogram of distinct values, which combines before the shuffle. It is cut in about ``ranges`` ranges of
    like numbers of values by approximate quantiles; only the values of the range that holds the rank are put in order, so neither
    a key's values nor, without keys, all values meet in one task. Null keys are a key; null times are left out."""
    counts = times.filter(F.col(ms).isNotNull()).groupBy(*keys, ms).agg(F.count("*").alias("_c"))
    totals = counts.groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.sum(F.col(ms) * F.col("_c")).alias("_ms"), F.approx_percentile(ms, [k / ranges for k in range(1, ranges)], 1000).alias("_cuts")
    ).withColumn("_rank", F.floor(F.col("n") * 99 / 100))
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    held = totals.select(*names, "n", "_ms", "_cuts", "_rank")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # without keys the totals are one row
    met = counts.join(held, same) if keys else counts.join(F.broadcast(held))
    met = met.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(ms))))
    sums = met.groupBy(*keys, "_range").agg(F.sum("_c").alias("_in"), F.first("_rank").alias("_rank"))
    upto = F.sum("_in").over(Window.partitionBy(*keys).orderBy("_range"))  # ``ranges`` rows a key
    wanted = sums.withColumn("_before", upto - F.col("_in")).filter((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_in")))
    wanted = wanted.select(*[F.col(k).alias(f"_w{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_before")
    here = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        here = here & F.col(k).eqNullSafe(F.col(f"_w{i}"))
    within = met.join(wanted, here)
    ranked = within.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys).orderBy(ms)))
    return ranked.filter(F.col("_upto") > F.col("_rank")).groupBy(*keys).agg(
        F.first("n").alias("n"), (F.first("_ms") / F.first("n")).alias("mean_ms"), (F.first("n") * 1000 / F.first("_ms")).alias("ops_per_second"), F.min(ms).alias("p99_ms")
    )


def member_totals(members: DataFrame, guild: str = "guild_id") -> DataFrame:
    """Members, humans, bots and who is not offline, by guild. members: is_bot, status."""
    bot = F.coalesce(F.col("is_bot"), F.lit(False))
    return members.groupBy(guild).agg(
        F.count("*").alias("members"), F.count_if(~bot).alias("humans"), F.count_if(bot).alias("bots"), F.count_if(F.coalesce(F.col("status"), F.lit("offline")) != "offline").alias("online")
    )


def bot_totals(guilds: DataFrame) -> DataFrame:
    """Guilds, members and channels over all guilds; a guild without a count adds nothing."""
    return guilds.agg(F.count("*").alias("guilds"), F.coalesce(F.sum("member_count"), F.lit(0)).alias("members"), F.coalesce(F.sum("channel_count"), F.lit(0)).alias("channels"))


def user_statistics(events: DataFrame, user: str = "user_id") -> DataFrame:
    """Conditional counts per user and the last time seen."""
    kinds = ("click", "view", "purchase", "error", "signup")
    return events.groupBy(user).agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds], F.max("ts").alias("last_seen"))


def hit_rate(requests: DataFrame, hit: Column) -> DataFrame:
    return requests.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses")).withColumn(
        "hit_rate", F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses")) * 100).otherwise(0.0)
    )
