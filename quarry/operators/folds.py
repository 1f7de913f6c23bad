"""Sequential recurrences over a key's events in time order: limiters, cooldowns, lockdowns.

Every recurrence is a small class with ``step(time in seconds, *values) -> tuple``. In batch, rows
are dealt by key, sorted within the partition and streamed through it, one state at a time: no key
is collected. ``gap`` cuts a key where it has been idle long enough for the state to be as new, so a
hot key spreads over tasks. The streaming operators use the same classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.numbers import micros


class TokenBucket:
    """``rate`` tokens that refill over ``per`` seconds, at first full; a denied event waits for a token."""

    fields = "allowed boolean, tokens double, retry_after double"

    def __init__(self, rate: int, per: float):
        self.rate, self.per, self.tokens, self.last = rate, per, float(rate), None

    def step(self, t: float) -> tuple:
        if self.last is not None:
            self.tokens = min(self.rate, self.tokens + (t - self.last) * self.rate / self.per)
        self.last = t
        if self.tokens >= 1:
            self.tokens -= 1
            return True, self.tokens, 0.0
        return False, self.tokens, (1 - self.tokens) * self.per / self.rate

    def gap(self) -> float:
        return self.per


class SlidingLog:
    """At most ``limit`` allowed events in any ``window`` seconds; denied ones are not logged."""

    fields = "allowed boolean, retry_after double"

    def __init__(self, limit: int, window: float):
        self.limit, self.window, self.log = limit, window, []

    def step(self, t: float) -> tuple:
        self.log = [x for x in self.log if t - x < self.window]
        if len(self.log) < self.limit:
            self.log.append(t)
            return True, 0.0
        return False, max(0.0, self.window - (t - self.log[0]))

    def gap(self) -> float:
        return self.window


class AdaptiveCooldown:
    """A cooldown that violations stretch and successes shrink back to its base."""

    fields = "per double, violations int"

    def __init__(self, base: float, most: float = 300.0, up: float = 1.5, down: float = 0.8, forget: float = 3600.0):
        self.base, self.most, self.up, self.down, self.forget = base, most, up, down, forget
        self.per, self.violations, self.last = base, 0, None

    def step(self, t: float, violation: bool) -> tuple:
        if violation:
            if self.last is not None and t - self.last > self.forget:
                self.violations = 0
            self.violations += 1
            self.last = t
            self.per = min(self.most, self.per * self.up)
        else:
            self.per = max(self.base, self.per * self.down)
            if self.per <= self.base:
                self.violations = max(0, self.violations - 1)
        return self.per, self.violations

    def gap(self) -> None:
        return None


class Lockdown:
    """``threshold`` joins within ``interval`` seconds close the door for ``duration``; joins meanwhile are turned away uncounted."""

    fields = "suppressed boolean, recent int, triggers boolean"

    def __init__(self, threshold: int = 10, interval: float = 10, duration: float = 300):
        self.threshold, self.interval, self.duration = threshold, interval, duration
        self.joins, self.until = [], None

    def step(self, t: float) -> tuple:
        if self.until is not None and t < self.until:
            return True, 0, False
        self.until = None
        self.joins = [x for x in self.joins if x > t - self.interval] + [t]
        hit = len(self.joins) >= self.threshold
        if hit:
            self.until = t + self.duration
        return False, len(self.joins), hit

    def gap(self) -> float:
        return self.interval + self.duration


class Points:
    """Warning points that are given and taken back, never under zero."""

    fields = "points long"

    def __init__(self):
        self.points = 0

    def step(self, t: float, change: int) -> tuple:
        self.points = max(0, self.points + change)
        return (self.points,)

    def gap(self) -> None:
        return None


class GlobalCooldown:
    """One allowed event, then none for ``seconds``."""

    fields = "allowed boolean, remaining double"

    def __init__(self, seconds: float):
        self.seconds, self.until = seconds, None

    def step(self, t: float) -> tuple:
        if self.until is not None and t < self.until:
            return False, self.until - t
        self.until = t + self.seconds
        return True, 0.0

    def gap(self) -> float:
        return self.seconds


class Away:
    """Set away by a mark, back by the next message that is none."""

    fields = "away boolean, returned boolean, away_seconds double"

    def __init__(self):
        self.since = None

    def step(self, t: float, mark: bool) -> tuple:
        if mark:
            self.since = t
            return True, False, None
        if self.since is not None:
            gone, self.since = t - self.since, None
            return False, True, gone
        return False, False, None

    def gap(self) -> None:
        return None


class Levels:
    """Experience per message with a daily cap: level costs are taken off while they fit."""

    fields = "counted boolean, level int, xp long, total_xp long"

    def __init__(self, daily: int = 15):
        self.daily, self.day, self.used, self.level, self.xp, self.total = daily, None, 0, 0, 0, 0

    def step(self, t: float, gained: int) -> tuple:
        day = int(t // 86400)
        if day != self.day:
            self.day, self.used = day, 0
        counted = self.used < self.daily
        if counted:
            self.used += 1
            self.xp += gained
            self.total += gained
            while self.xp >= (cost := 5 * (self.level + 1) ** 2 + 50 * (self.level + 1) + 100):
                self.xp -= cost
                self.level += 1
        return counted, self.level, self.xp, self.total

    def gap(self) -> None:
        return None


def names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _stream(batches: Iterator[pd.DataFrame], keys: list[str], values: list[str], make, out: list[str]) -> Iterator[pd.DataFrame]:
    state, last = None, None
    for batch in batches:
        made = []
        columns = [batch[c].tolist() for c in (*keys, "_at", *values)]
        for row in zip(*columns, strict=True):
            key = row[: len(keys)]
            if state is None or key != last:
                state, last = make(), key
            made.append(state.step(row[len(keys)] / 1e6, *row[len(keys) + 1 :]))
        for name, column in zip(out, zip(*made, strict=True) if made else [[] for _ in out], strict=True):
            batch[name] = pd.Series(list(column), index=batch.index, dtype=object)
        yield batch.drop(columns=["_at", *[c for c in ("_session",) if c in batch]])


#: Seconds of a key's events that one task looks at to cut sessions, at least.
SPLIT_SECONDS = 3600


def with_sessions(rows: DataFrame, keys: list[str], gap: float, tie: str) -> DataFrame:
    """rows(_at in microseconds, ...) with _session, the time at which the key was idle for ``gap`` before.

    A key's time is cut in pieces that look back one gap into the piece before; what a piece hands on
    is the start of its last session, one row a piece. No key's history meets in one task."""
    span, width = int(gap * 1e6), int(max(gap, SPLIT_SECONDS) * 1e6)
    piece = F.floor(F.col("_at") / width).cast("long")
    copies = F.when((piece + 1) * width - F.col("_at") < span, F.array(piece, piece + 1)).otherwise(F.array(piece))
    spread = rows.withColumn("_own", piece).withColumn("_piece", F.explode(copies))
    order = Window.partitionBy(*keys, "_piece").orderBy("_at", tie)
    fresh = F.coalesce(F.col("_at") - F.lag("_at").over(order) >= span, F.lit(True))
    spread = spread.withColumn("_start", F.when(fresh & (F.col("_piece") == F.col("_own")), F.col("_at")))
    spread = spread.withColumn("_inner", F.max("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = spread.filter("_piece = _own")
    ends = own.groupBy(*keys, "_piece").agg(F.max("_start").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_p"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    same = F.col("_piece") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return own.join(handed, same).select(*rows.columns, F.coalesce("_inner", "_carried").alias("_session"))


def sequential(events: DataFrame, keys: list[str], make, values: list[str] = (), ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """events with the fields of a recurrence. make: a callable without arguments, such as
    ``partial(TokenBucket, 5, 10.0)``; values: columns given to each step; tie: order of equal times."""
    fields = (make.func if isinstance(make, partial) else make).fields
    rows, dealt = events.withColumn("_at", micros(F.col(ts))), list(keys)
    gap = make().gap()
    if gap is not None:
        rows = with_sessions(rows, keys, gap, tie)
        dealt.append("_session")
    rows = rows.repartition(*dealt).sortWithinPartitions(*dealt, "_at", tie)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", " + fields
    return rows.mapInPandas(lambda batches: _stream(batches, dealt, list(values), make, names(fields)), schema)


def register_by_value() -> None:
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


register_by_value()
