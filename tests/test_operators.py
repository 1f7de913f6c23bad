"""Recurrences and streams against plain loops, placement invariants, rules, levels."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from quarry.functions import hashing, numbers, text
from quarry.operators import detect, fanout, filters, folds, pieces, placement
from quarry.plans import catalogue
from quarry.streaming import stateful

EVENTS = "event_id long, guild long, ts timestamp, bad boolean"


def make_events(spark, n=300, seed=1):
    rng, rows, t = random.Random(seed), [], 1_700_000_000.0
    for i in range(n):
        t += rng.choice((0.0, 0.5, 1.0, 3.0, 40.0))
        rows.append((i, rng.choice((1, 1, 1, 2, 3)), t, rng.random() < 0.3))
    return spark.createDataFrame(rows, "event_id long, guild long, t double, bad boolean").select("event_id", "guild", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"), "bad"), rows


CASES = [
    (partial(folds.TokenBucket, 3, 10.0), []), (partial(folds.SlidingLog, 3, 5.0), []), (partial(folds.Lockdown, 4, 3.0, 20.0), []),
    (partial(folds.AdaptiveCooldown, 2.0), ["bad"]), (partial(folds.GlobalCooldown, 2.0), []), (folds.Away, ["bad"]),
]


def loop(rows, make, values):
    state, out = {}, {}
    for i, g, t, bad in rows:
        step = state.setdefault(g, make())
        out[i] = step.step(t, *([bad] if values else []))
    return out


def close(a, b):
    return all(x == pytest.approx(y, abs=1e-6) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(("make", "values"), CASES)
def test_batch_equals_loop(spark, make, values):
    """Also where idle keys are cut into sessions."""
    events, rows = make_events(spark)
    fields = folds.names((make.func if isinstance(make, partial) else make).fields)
    got = {r.event_id: tuple(r[f] for f in fields) for r in folds.sequential(events, ["guild"], make, values).collect()}
    want = loop(rows, make, values)
    assert got.keys() == want.keys() and all(close(got[i], want[i]) for i in want)


@pytest.mark.parametrize("split", [1, 20, 10**6])
def test_sessions_do_not_depend_on_pieces(spark, monkeypatch, split):
    """Also with null keys, and sessions that span pieces."""
    monkeypatch.setattr(folds, "SPLIT_SECONDS", split)
    events, rows = make_events(spark)
    events = events.withColumn("guild", F.when(F.col("guild") != 3, F.col("guild")))
    for gap in (2.0, 30.0):
        got = {r.event_id: r._session for r in folds.with_sessions(events.withColumn("_at", F.unix_micros("ts")), ["guild"], gap, "event_id").collect()}
        last, start = {}, {}
        for i, g, t, _ in rows:
            at = round(t * 1e6)
            if g not in last or at - last[g] >= gap * 1e6:
                start[g] = at
            last[g] = at
            assert got[i] == start[g]
        assert len(got) == len(rows)


@pytest.mark.parametrize("watermark", [None, "1 second"])
@pytest.mark.parametrize("case", [0, 1, 2])
def test_stream_equals_loop(spark, tmp_path, case, watermark):
    make, values = CASES[case]
    events, rows = make_events(spark, 200)
    for k in range(4):  # four micro-batches in order of time
        events.filter((F.col("event_id") >= 50 * k) & (F.col("event_id") < 50 * k + 50)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    fields = folds.names(make.func.fields)
    stream = stateful.stateful(stateful.replay(spark, f"{tmp_path}/in"), ["guild"], make, values, watermark=watermark)
    got = stateful.drained(spark, stream, f"file://{tmp_path}/check").collect()
    want = loop(rows[:200], make, values)
    assert len(got) == 200 and all(close(tuple(r[f] for f in fields), want[r.event_id]) for r in got)


def test_window_and_session_streams(spark, tmp_path):
    events, rows = make_events(spark, 200)
    events.write.parquet(f"{tmp_path}/in")
    windows = stateful.window_counts(stateful.replay(spark, f"{tmp_path}/in"), "1 minute", ["guild"])
    assert sum(r.n for r in stateful.drained(spark, windows, f"file://{tmp_path}/c1", "complete").collect()) == 200
    sessions = stateful.session_counts(stateful.replay(spark, f"{tmp_path}/in"), "30 seconds", ["guild"], late="0 seconds")
    closed = stateful.drained(spark, sessions, f"file://{tmp_path}/c2")
    assert 0 < closed.count() and closed.agg(F.sum("n")).first()[0] <= 200


def test_trailing_count_over_pieces(spark):
    """Edges: exactly a window ago does not count; pieces of a key's time agree with a plain count."""
    events, rows = make_events(spark)
    for split in (1, 7, 100000):
        got = {r.event_id: r.recent for r in detect.trailing_count(events, ["guild"], 5, split=split).collect()}
        for i, g, t, _ in rows:
            assert got[i] == sum(g == h and t - 5 < u <= t for _, h, u, _ in rows)


@pytest.mark.parametrize("split", [1, 7, 100000])
def test_running_values_over_pieces(spark, split):
    """Numbers, the row before, points, absence and levels agree with loops, however a key's time is cut; null keys are a key."""
    events, rows = make_events(spark, 300)
    events = events.withColumns({"change": F.col("event_id") % 5 - 2, "mark": F.col("event_id") % 3 == 0, "gained": F.col("event_id") * 40, "guild": F.when(F.col("guild") != 2, F.col("guild"))})
    order = sorted((t, i, g if g != 2 else None) for i, g, t, _ in rows)
    folded = {n: {} for n in ("points", "away", "levels")}
    states, number, last = {}, {}, {}
    want_number, want_last = {}, {}
    for t, i, g in order:
        p, a, l = states.setdefault(g, (folds.Points(), folds.Away(), folds.Levels(4)))  # noqa: E741
        folded["points"][i], folded["away"][i], folded["levels"][i] = p.step(t, i % 5 - 2), a.step(t, i % 3 == 0), l.step(t, i * 40)
        number[g] = number.get(g, 0) + 1
        want_number[i], want_last[i] = number[g], last.get(g)
        last[g] = i
    assert {r.event_id: r.number for r in pieces.numbered(events, ["guild"], split=split).collect()} == want_number
    assert {r.event_id: r._previous and r._previous.event_id for r in pieces.previous(events, ["guild"], ["event_id"], split=split).collect()} == want_last
    assert {r.event_id: (r.points,) for r in pieces.points(events, ["guild"], "change", split=split).collect()} == folded["points"]
    got = {r.event_id: (r.away, r.returned, r.away_seconds) for r in pieces.away(events, ["guild"], "mark", split=split).collect()}
    assert all(close(got[i], w) for i, w in folded["away"].items())
    assert {r.event_id: (r.counted, r.level, r.xp, r.total_xp) for r in pieces.levels(events, ["guild"], "gained", 4, split=split).collect()} == folded["levels"]


def test_ring():
    ring = placement.Ring({"a": 1, "b": 2, "c": 0.5})
    owners = {i: ring.owners(i)[0] for i in range(3000)}
    share = sum(o == "b" for o in owners.values()) / 3000
    assert 0.4 < share < 0.75 and ring.count("b") == 300 and ring.count("c") == 75
    ring.remove("c")
    assert all(ring.owners(i)[0] == o for i, o in owners.items() if o != "c")
    ring.add("c", 0.5)
    assert all(ring.owners(i)[0] == o for i, o in owners.items())
    assert all(len(set(ring.owners(i, 3))) == 3 for i in range(50)) and placement.Ring().owners(1) == []
    ring.reweight("c", 4)
    assert ring.count("c") == 600


def test_spread(spark):
    placed = spark.range(1000).select(placement.bucket(F.col("id"), 10).alias("b"))
    r = placement.spread(placed, "b", 10).first()
    assert r.total_ids == 1000 and r.num_buckets == 10 and r.max_bucket_count >= 100 >= r.min_bucket_count
    empty = placement.spread(placed.limit(0), "b", 10).first()
    assert empty.total_ids == 0 and empty.deviation_percent == 0


def test_bloom_has_no_false_negatives(spark):
    m, k = hashing.bloom_shape(200)
    rows = spark.range(2000).select("id", hashing.bloom_positions(F.col("id"), m, k).alias("p")).collect()
    bits = {x for r in rows if r.id < 200 for x in r.p}
    maybe = {r.id for r in rows if bits.issuperset(r.p)}
    assert set(range(200)) <= maybe and len(maybe) < 200 + 0.05 * 1800


def test_levels(spark):
    totals = [0, 154, 155, 374, 375, 529, 530, 5000, 123456, 98765432]

    def climb(x):
        level = 0
        while x >= (c := 5 * (level + 1) ** 2 + 50 * (level + 1) + 100):
            x -= c
            level += 1
        return level, x

    got = {r.t: (r.l.level, r.l.rest) for r in spark.createDataFrame([(t,) for t in totals], "t long").select("t", numbers.level_of(F.col("t")).alias("l")).collect()}
    assert got == {t: climb(t) for t in totals}


def test_levels_of_all_events(spark, tmp_path):
    """Also of events past the levels that the query's SQL lists."""
    ids = [0, 4, 5, 1_081_081, 1_081_082, 40_000_000]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    want = set()
    for i in ids:
        level, rest = 0, i * 37
        while rest >= (c := 5 * (level + 1) ** 2 + 50 * (level + 1) + 100):
            rest -= c
            level += 1
        want.add((i, level, rest))
    assert {tuple(r) for r in catalogue.QUERIES["lvl_from_xp"](spark, str(tmp_path)).collect()} == want


def test_normalisation(spark):
    rows = [("ｈ３ｌｌｏ", "hello"), ("h́éllo", "hello"), ("𝐡𝐞𝐥𝐥𝐨", "hello"), ("a b c", "ab c"), ("/\\x|\\/|", "axm"), ("$p4m", "spam")]
    got = spark.createDataFrame(rows, "t string, want string").select("t", "want", text.normalised("t").alias("got")).collect()
    assert all(r.got == r.want for r in got), got


def test_spam_reasons(spark):
    rows = {"x" * 2001: "Message too long", "AAAAAAAAAAAAAA": "Excessive caps", "@everyone": "Mass mentions", "abcabcabcabcabcabc": "Repeating pattern", "a b a b a b a b a b a b": "Repetitive words", "b b b b b b b": "Repetitive words", "fine": None}
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", text.spam_reason("t").alias("v")).collect()}
    assert got == rows


def test_fan_out_prefers_the_first_source(spark):
    a, b = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b", 5), (2, "b", 6)], "id int, v string, w int")
    assert {(r.id, r.v, r.w) for r in fanout.union_first([a, b]).collect()} == {(1, "a", None), (2, "b", 6)}
    assert fanout.first_positive([a.limit(0), b]).count() == 2


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_tables(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(1000), 5, None]], "id long")
    m, k = hashing.bloom_shape(100)
    words = filters.filter_words(spark.range(100), "id", m, k)
    got = filters.asked(rows, "id", words, m, k).collect()
    assert len(got) == 1002 and all(r.maybe for r in got if r.id is not None and r.id < 100)
    assert sum(r.maybe for r in got if r.id is not None and r.id >= 100) < 30 and not any(r.maybe for r in got if r.id is None)
    assert filters.asked(rows, "id", filters.filter_words(spark.range(0), "id", m, k), m, k).filter("maybe").count() == 0


def test_latency_equals_sorted_lists(spark):
    from quarry.operators import metrics

    rng = random.Random(12)
    rows = [(rng.choice(("a", "a", "b", None)), rng.choice((1.0, 2.5, rng.random() * 1000))) for _ in range(3000)] + [("one", 7.0), ("a", None)]
    frame = spark.createDataFrame(rows, "k string, ms double")
    got = {r.k: r for r in metrics.latency(frame, "ms", ["k"]).collect()}
    for k in ("a", "b", None, "one"):
        times = sorted(t for j, t in rows if j == k and t is not None)
        assert (got[k].n, got[k].p99_ms) == (len(times), times[int(len(times) * 0.99)]) and got[k].mean_ms == pytest.approx(sum(times) / len(times))
    times = sorted(t for _, t in rows if t is not None)
    assert metrics.latency(frame, "ms").first().p99_ms == times[int(len(times) * 0.99)]
    assert metrics.latency(frame.limit(0), "ms", ["k"]).count() == 0


def test_durations_by_spelling(spark):
    rows = [(f"{n}{gap}{case(u)}", n * s) for us, s in numbers.UNITS.items() for u in us.split() for n in (1, 40) for gap in ("", " ") for case in (str, str.upper)]
    rows += [("1mo 5m", 2592300), ("2h 30m", 9000), ("45 min 10 sec", 2710), ("1d12h", 129600), ("90", 90), ("-5", -5), ("abc", None), ("", None), ("0s", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, want long").select("t", "want", numbers.parse_duration(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == rows


def test_bytes_round_as_python(spark):
    """Half-way hundredths go to the even one, in every unit up to PB; null stays null."""
    want = {0: "0.00 B", 1152: "1.12 KB", 1408: "1.38 KB", -1664: "-1.62 KB", 2**40 - 1: "1024.00 GB", 2**40: "1.00 TB", 99999**2 * 970 + 3: "8.82 TB", 2**63 - 1: "8192.00 PB", None: None}
    for power, unit in enumerate(["KB", "MB", "GB", "TB", "PB"], 1):
        for eighths in (9, 11, 13, 15, 8001):
            for n in (eighths * 1024**power // 8, eighths * 1024**power // 8 - 1, eighths * 1024**power // 8 + 1):
                want[n] = f"{n / 1024**power:.2f} {unit}"
        n = round(1.005 * 1024**power)
        want[n] = f"{n / 1024**power:.2f} {unit}"
    got = spark.createDataFrame([(n,) for n in want], "n long").select("n", numbers.format_bytes(F.col("n")).alias("v")).collect()
    assert {r.n: r.v for r in got} == want


def test_whitening_has_known_values():
    """The finalizer's published value for 1, and 0 for 0; places are 32 hex digits that keep the order of numbers."""
    assert hashing.mix64(0) == 0 and hashing.mix64(1) == 0xB456BCFC34C2CB2C
    assert hashing.whiten(0) == 0 and len({hashing.whiten(i << 22) for i in range(5000)}) == 5000
    import hashlib

    assert hashing.guild_hash(0) == hashlib.blake2b(bytes(16), digest_size=16).hexdigest()
    assert hashing.vnode_hash("a", 3) == hashlib.blake2b(b"a:vnode:3", digest_size=16).hexdigest()


def test_places_by_plain_search(spark):
    ring = placement.Ring({"a": 1.0, "b": 2.0, "c": 0.5})
    ids = [*range(300), 2**62, -5]
    rows = spark.createDataFrame([(i,) for i in [*ids, None]], "i long").select("i", placement.placed(F.col("i"), ring, 3).alias("n"), placement.owner(F.col("i"), ring).alias("o"), placement.replicas(F.col("i"), ring, 1).alias("r")).collect()
    for r in rows[:-1]:
        here = hashing.guild_hash(r.i)
        after = sorted(ring.points, key=lambda p: (p[0] < here, p))
        want = list(dict.fromkeys(node for _, node in after))
        assert (r.n, r.o, r.r) == (want, want[0], want[1:2])
    assert rows[-1].n is None and rows[-1].o is None
    none = spark.range(2).select(placement.owner(F.col("id"), placement.Ring()).alias("o"))
    assert [r.o for r in none.collect()] == [None, None]
