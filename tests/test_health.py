import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pageloom.operators import health, running
from pageloom.operators.health import BreakerRules

START = datetime(2024, 3, 1)
KEY, ORDER = ["host"], ["ts", "seq"]


def log_of(spark, rows):
    """rows: (host, seconds, seq, failed)"""
    made = [(h, START + timedelta(seconds=s), q, f) for h, s, q, f in rows]
    return spark.createDataFrame(made, "host string, ts timestamp, seq int, bad boolean")


def brute(rows, rules):
    """The breaker one event at a time."""
    out, keys = {}, {}
    for host, second, seq, bad in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        b = keys.setdefault(
            host, dict(state="closed", ok=0, streak=0, total=0, failures=0, at=None)
        )
        if b["state"] == "open" and second - b["at"] >= rules.recovery_timeout:
            b["state"], b["ok"] = "half_open", 0
        b["total"] += 1
        if bad:
            b["failures"] += 1
            b["streak"] += 1
            b["at"] = second
            rate = b["failures"] / b["total"]
            if b["streak"] >= rules.failure_threshold:
                b["state"] = "open"
            elif b["total"] >= rules.min_requests and rate >= rules.failure_rate:
                b["state"] = "open"
        else:
            b["streak"] = 0
            if b["state"] == "half_open":
                b["ok"] += 1
                if b["ok"] >= rules.success_threshold:
                    b["state"] = "closed"
        out[host, seq] = (b["state"], b["total"], b["failures"], b["streak"])
    return out


def replayed(df, rules, rows_per_slice=running.ROWS_PER_SLICE):
    out = health.breaker_replay(df, F.col("bad"), KEY, ORDER, rules, rows_per_slice)
    return {
        (r["host"], r["seq"]): (r["state"], r["total"], r["failures"], r["streak"])
        for r in out.collect()
    }


def random_rows(seed, n=900):
    """One host has a third of all events; quiet spells let the breaker recover."""
    rng = random.Random(seed)
    rows, second = [], 0
    for seq in range(n):
        second += rng.choice([0, 1, 1, 3, 20, 61])
        host = "big" if rng.random() < 0.34 else f"h{rng.randrange(25)}"
        phase = (seq // 90) % 3
        rows.append((host, second, seq, rng.random() < (0.1, 0.45, 0.8)[phase]))
    return rows


def test_worked_example(spark):
    events = [(0, 1), (1, 1), (2, 0), (70, 0), (71, 0), (72, 1), (73, 0)]
    rows = [("h", s, i, bool(f)) for i, (s, f) in enumerate(events)]
    got = replayed(log_of(spark, rows), BreakerRules(failure_threshold=2))
    assert [got["h", i][0] for i in range(7)] == [
        "closed", "open", "open", "half_open", "half_open", "half_open", "closed",
    ]


@pytest.mark.parametrize(
    "rules",
    [
        BreakerRules(),
        BreakerRules(failure_threshold=2, recovery_timeout=30),
        BreakerRules(failure_threshold=3, success_threshold=1, failure_rate=0.2, recovery_timeout=5),
        BreakerRules(failure_threshold=4, recovery_timeout=0, min_requests=1, failure_rate=0.9),
    ],
)
def test_replay_equals_brute_force_whole_and_split(spark, rules):
    rows = random_rows(3)
    df = log_of(spark, rows).repartition(5)
    want = brute(rows, rules)
    assert replayed(df, rules) == want
    assert replayed(df, rules, rows_per_slice=60) == want


def test_big_keys_are_cut(spark):
    df = log_of(spark, random_rows(5))
    kept = running.spread_keys(df, KEY, ORDER, 60)
    assert kept.sliced
    sizes = kept.df.groupBy(running.SLICE, "host").count()
    assert sizes.agg(F.max("count")).first()[0] < 150
    assert sizes.filter("host = 'big'").count() > 2
    assert not running.spread_keys(df, KEY, ORDER).sliced


def test_running_health_split_and_whole_agree(spark):
    rows = random_rows(11)
    df = log_of(spark, rows)
    rules = BreakerRules(failure_threshold=3, failure_rate=0.4)
    for fn, args in (
        (health.failure_streak, ()),
        (health.failure_rate, ()),
        (health.first_trip, (rules,)),
        (health.gate_after_trip, (rules,)),
        (health.breaker_stats, (rules,)),
    ):
        whole = fn(df, F.col("bad"), KEY, ORDER, *args)
        split = fn(df, F.col("bad"), KEY, ORDER, *args, rows_per_slice=50)
        assert whole.columns == split.columns
        assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect())), fn


def test_first_trip_is_first_open_of_replay(spark):
    df = log_of(spark, random_rows(13))
    rules = BreakerRules(failure_threshold=3, failure_rate=0.6)
    trips = health.first_trip(df, F.col("bad"), KEY, ORDER, rules)
    opened = (
        health.breaker_replay(df, F.col("bad"), KEY, ORDER, rules)
        .filter("state = 'open'")
        .groupBy("host")
        .agg(F.min(F.struct("ts", "seq")).alias("first"))
    )
    assert {(r["host"], r["seq"]) for r in trips.collect()} == {
        (r["host"], r["first"]["seq"]) for r in opened.collect()
    }


def test_stats_read_the_state_when_asked(spark):
    rows = [("h", s, s, True) for s in range(3)]
    df = log_of(spark, rows)
    rules = BreakerRules(failure_threshold=2)

    def state(seconds):
        as_of = F.lit(START + timedelta(seconds=seconds))
        return health.breaker_stats(df, F.col("bad"), KEY, ORDER, rules, as_of).first()

    assert state(61)["state"] == "open" and state(62)["state"] == "half_open"
    assert state(5)[2:] == (3, 3, 3, 1.0)


ATTEMPT = (
    "host string, url string, attempt int, status int, error_kind string, retry_after string"
)


@pytest.mark.parametrize(
    "attempts, verdict, tries, failures, waits",
    [
        ([(200, None, None)], "ok", 1, 0, 0.0),
        ([(500, None, None)] * 2 + [(200, None, None)], "ok", 3, 2, 3.0),
        ([(404, None, None)] * 5, "failed", 5, 5, 15.0),
        ([(429, None, "7"), (200, None, None)], "ok", 2, 1, 7.0),
        ([(429, None, None)] * 5, "failed", 5, 5, 5.0),
        ([(429, None, "1.5"), (200, None, None)], "fatal", 1, 1, 0.0),
        ([(None, "unexpected", None), (200, None, None)], "fatal", 1, 1, 0.0),
        ([(None, "timeout", None), (None, "client", None), (200, None, None)], "ok", 3, 2, 3.0),
        ([(500, None, None)] * 5 + [(200, None, None)], "failed", 5, 5, 15.0),
    ],
)
def test_fetch_outcomes(spark, attempts, verdict, tries, failures, waits):
    rows = [("h", "u", i, *a) for i, a in enumerate(attempts)]
    got = health.fetch_outcomes(spark.createDataFrame(rows, ATTEMPT)).collect()
    assert [tuple(r) for r in got] == [("h", "u", verdict, tries, failures, waits)]


def test_no_attempt_allowed(spark):
    df = spark.createDataFrame([("h", "u", 0, 200, None, None)], ATTEMPT)
    got = health.fetch_outcomes(df, max_retries=0).collect()
    assert [tuple(r) for r in got] == [("h", "u", "failed", 0, 0, 0.0)]


def test_fatal_codes(spark):
    rows = [("h", "u", i, 404, None, None) for i in range(5)]
    got = health.fetch_outcomes(spark.createDataFrame(rows, ATTEMPT), fatal_codes=[404]).first()
    assert (got["verdict"], got["attempts"]) == ("fatal", 1)
