"""Fetch health from attempt logs: outcomes, streaks, and a circuit breaker.

The breaker is closed at first. A failure *trips* it when the streak of failures
reaches a threshold, or when the failure rate is high after enough requests. Once
open it turns half-open at the first event that comes ``recovery_timeout`` after
the last failure, and closed again after ``success_threshold`` successes.

No fold over a key's events is needed. Whether an event trips, and whether the
wait since the last failure is over, follows from running totals that do not
depend on the state; and the state follows from the last trip, the first event
after it whose wait was over, and the successes counted since. All of these are
running sums and maxima, so ``running`` can cut a big key into slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from pageloom.functions.retry import backoff_delay, retry_after_delay
from pageloom.operators.running import ROWS_PER_SLICE, Keyed, running, spread_keys


@dataclass(frozen=True)
class BreakerRules:
    # The defaults of the breaker.
    failure_threshold: int = 10
    success_threshold: int = 3
    recovery_timeout: float = 60.0
    failure_rate: float = 0.5
    min_requests: int = 10

    def __post_init__(self):
        if min(self.failure_threshold, self.success_threshold) < 1:
            raise ValueError("thresholds must be positive")
        if self.recovery_timeout < 0:
            raise ValueError("recovery_timeout must be non-negative")


DEFAULT_RULES = BreakerRules()


# --- outcomes of retried fetches ---------------------------------------------


def attempt_kind(
    status: Column, error_kind: Column, retry_after: Column, fatal_codes: Sequence[int] = ()
) -> Column:
    """``ok``, ``rate_limited``, ``http_error``, ``client``, ``fatal``, or ``unknown`` for
    an attempt with neither status nor error, which is no success.

    A Retry-After header that holds no whole number makes a 429 fatal.
    ``fatal_codes`` names statuses that are not worth a retry (none by default).
    """
    return (
        F.when(error_kind == "unexpected", "fatal")
        .when(error_kind.isNotNull(), "client")
        .when(status.isin(*fatal_codes) if fatal_codes else F.lit(False), "fatal")
        .when((status == 429) & retry_after_delay(retry_after).isNull(), "fatal")
        .when(status == 429, "rate_limited")
        .when(status >= 400, "http_error")
        .when(status.isNull(), "unknown")
        .otherwise("ok")
    )


def _with_kind(attempts: DataFrame, fatal_codes: Sequence[int] = ()) -> DataFrame:
    return attempts.withColumn(
        "kind",
        attempt_kind(F.col("status"), F.col("error_kind"), F.col("retry_after"), fatal_codes),
    )


def fetch_outcomes(
    attempts: DataFrame,
    max_retries: int = 5,
    base_delay: float = 1.0,
    by: Sequence[str] = ("host", "url"),
    jitter: bool = False,
    fatal_codes: Sequence[int] = (),
) -> DataFrame:
    """One verdict per URL: ``ok``, ``failed`` or ``fatal``, with the number of
    attempts and failures counted and the seconds of waiting planned.

    The first success or fatal attempt ends the series; attempts from
    ``max_retries`` (0-based numbers) on do not exist for the fetcher. A 429 waits
    even after the last attempt, other failures do not.
    """
    kind, attempt = F.col("kind"), F.col("attempt")
    wait = (
        F.when(
            kind == "rate_limited",
            retry_after_delay(F.col("retry_after"), base_delay).cast("double"),
        )
        .when(
            kind.isin("http_error", "client") & (attempt + 1 < max_retries),
            backoff_delay(attempt, base_delay, jitter),
        )
        .otherwise(0.0)
    )
    # Map-side combined first: at most one row per URL and attempt goes on.
    tried = (
        _with_kind(attempts, fatal_codes)
        .withColumn("wait", wait)
        .withColumn("counted", attempt < max_retries)
        .withColumn("attempt", F.when(F.col("counted"), attempt).otherwise(max_retries))
        .groupBy(*by, "attempt", "counted")
        .agg(
            F.max((kind == "ok").cast("int")).alias("ok"),
            F.max((kind == "fatal").cast("int")).alias("fatal"),
            F.max("wait").alias("wait"),
        )
    )
    earlier = (
        Window.partitionBy(*by)
        .orderBy("attempt")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ended = F.coalesce(F.max(F.greatest("ok", "fatal")).over(earlier), F.lit(0))
    live = F.col("counted") & (F.col("ended") == 0)
    good = F.col("ok") == 1
    return (
        tried.withColumn("ended", ended)
        .groupBy(*by)
        .agg(
            F.max(F.when(live & good, 1).otherwise(0)).alias("any_ok"),
            F.max(F.when(live & ~good, F.col("fatal")).otherwise(0)).alias("any_fatal"),
            F.count_if(live).alias("attempts"),
            F.count_if(live & ~good).alias("failures"),
            F.sum(F.when(live & ~good, F.col("wait")).otherwise(0.0)).alias("wait_seconds"),
        )
        .select(
            *by,
            F.when(F.col("any_ok") == 1, "ok")
            .when(F.col("any_fatal") == 1, "fatal")
            .otherwise("failed")
            .alias("verdict"),
            "attempts",
            "failures",
            "wait_seconds",
        )
    )


def status_counts(attempts: DataFrame, by: Sequence[str] = ("host",)) -> DataFrame:
    """Attempts by host and kind."""
    return _with_kind(attempts).groupBy(*by, "kind").agg(F.count("*").alias("attempts"))


# --- running health ----------------------------------------------------------


# What a key's log leaves behind for the log that follows it; ``_replayed`` takes it as the
# column ``_before``.
CARRIED = (
    "struct<total: bigint, failures: bigint, settled: bigint, failed_at: timestamp, "
    "tripped_at: bigint, tested: struct<trip: bigint, back: bigint, successes: bigint>>"
)


def _carry_on(rows: Keyed, carried: bool, **fields: str) -> Keyed:
    """Combine running values with those of the key's earlier log: counts add up, of all
    else the greatest holds."""
    if not carried:
        return rows
    before = {name: F.col(f"_before.{field}") for name, field in fields.items()}
    return rows.with_df(
        rows.df.withColumns(
            {
                n: F.col(n) + F.coalesce(b, F.lit(0)) if n in ("total", "failures") else F.greatest(F.col(n), b)
                for n, b in before.items()
            }
        )
    )


def _history(
    log: DataFrame,
    failed: Column,
    key: Sequence[str],
    order: Sequence[str],
    rows_per_slice: int,
    carried: bool = False,
    **more: tuple[str, Column],
) -> Keyed:
    """Add ``failed``, ``total``, ``failures``, ``streak`` and ``_settled`` (the failures up
    to the last success) to every event, and ``more`` running values."""
    rows = spread_keys(
        log.withColumn("failed", F.coalesce(failed, F.lit(False))),
        key,
        order,
        rows_per_slice,
    )
    rows = running(
        rows,
        total=("sum", F.lit(1).cast("bigint")),
        failures=("sum", F.col("failed").cast("bigint")),
        **more,
    )
    rows = _carry_on(rows, carried, total="total", failures="failures")
    # ``failures`` never falls, so its maximum over successes is its value at
    # the last success.
    rows = running(rows, _settled=("max", F.when(~F.col("failed"), F.col("failures"))))
    rows = _carry_on(rows, carried, _settled="settled")
    streak = F.col("failures") - F.coalesce("_settled", F.lit(0))
    return rows.with_df(rows.df.withColumn("streak", streak))


def failure_streak(
    log: DataFrame,
    failed: Column,
    key: Sequence[str],
    order: Sequence[str],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Events with ``streak``, the failures in a row up to and with this event."""
    rows = _history(log, failed, key, order, rows_per_slice)
    return rows.result().drop("total", "failures", "_settled")


def failure_rate(
    log: DataFrame,
    failed: Column,
    key: Sequence[str],
    order: Sequence[str],
    min_requests: int = DEFAULT_RULES.min_requests,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Events with ``total``, ``failures`` and ``rate``, NULL below
    ``min_requests``."""
    rows = _history(log, failed, key, order, rows_per_slice)
    rate = F.when(F.col("total") >= min_requests, F.col("failures") / F.col("total"))
    return rows.result().drop("streak", "_settled").withColumn("rate", rate)


def _trip_reason(rules: BreakerRules) -> Column:
    by_rate = (F.col("total") >= rules.min_requests) & (
        F.col("failures") / F.col("total") >= rules.failure_rate
    )
    return F.when(
        F.col("failed"),
        F.when(
            F.col("streak") >= rules.failure_threshold, "consecutive failures"
        ).when(by_rate, "failure rate"),
    )


def first_trip(
    log: DataFrame,
    failed: Column,
    key: Sequence[str],
    order: Sequence[str],
    rules: BreakerRules = DEFAULT_RULES,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """The event of each key that first opens the breaker, and why."""
    rows = _history(log, failed, key, order, rows_per_slice)
    detail = [*order, "streak", "total", "failures", "reason"]
    return (
        rows.df.withColumn("reason", _trip_reason(rules))
        .filter("reason IS NOT NULL")
        .groupBy(*key)
        .agg(F.min(F.struct(*detail)).alias("first"))
        .select(*key, "first.*")
    )


@dataclass(frozen=True)
class Totals:
    """What a log holds at its end: events, failures, and failures in a row."""

    total: int = 0
    failures: int = 0
    streak: int = 0


def next_trip(
    log: DataFrame,
    failed: Column,
    order: Sequence[str],
    so_far: Totals = Totals(),
    rules: BreakerRules = DEFAULT_RULES,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> tuple[Row | None, Totals]:
    """The event of ``log``, taken as one key, that first opens the breaker when counted on
    from ``so_far``, and the totals at the end of ``log``. Only these two come to the driver."""
    rows = _history(log.withColumn("_log", F.lit(0)), failed, ["_log"], order, rows_per_slice)
    # A streak that began before the log goes on while the log has no success.
    streak = F.col("streak") + F.when(F.col("streak") == F.col("total"), so_far.streak).otherwise(0)
    counted = rows.df.withColumn("streak", streak).withColumns(
        {"total": F.col("total") + so_far.total, "failures": F.col("failures") + so_far.failures}
    )
    reason = _trip_reason(rules)
    detail = F.struct(*order, "streak", "total", "failures", reason.alias("reason"))
    first, last = counted.agg(
        F.min(F.when(reason.isNotNull(), detail)), F.max(F.struct("total", "failures", "streak"))
    ).first()
    return first, Totals(*last) if last else so_far


def gate_after_trip(
    log: DataFrame,
    failed: Column,
    key: Sequence[str],
    order: Sequence[str],
    rules: BreakerRules = DEFAULT_RULES,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Events up to and with the first trip; what follows would not be fetched."""
    columns = log.columns
    rows = _history(log, failed, key, order, rows_per_slice)
    tripped = F.when(_trip_reason(rules).isNotNull(), 1)
    rows = running(rows, _tripped=("max_before", tripped))
    return rows.df.filter("_tripped IS NULL").select(*columns)


# --- the whole breaker -------------------------------------------------------


def _wait(rules: BreakerRules) -> Column:
    return F.make_dt_interval(secs=F.lit(rules.recovery_timeout).cast("decimal(18,6)"))


def breaker_state(tripped_at: Column, tested: Column, successes: Column, rules: BreakerRules) -> Column:
    """The state after an event: ``tripped_at`` numbers the key's last trip, ``tested`` is the
    first event after it whose wait was over, ``successes`` counts all up to the event."""
    half_open = tested["trip"] == tripped_at
    return (
        F.when(tripped_at.isNull(), "closed")
        .when(~F.coalesce(half_open, F.lit(False)), "open")
        .when(successes - tested["successes"] >= rules.success_threshold, "closed")
        .otherwise("half_open")
    )


def _replayed(
    log: DataFrame,
    failed: Column,
    key: Sequence[str],
    order: Sequence[str],
    rules: BreakerRules,
    rows_per_slice: int,
    carried: bool = False,
) -> Keyed:
    """``breaker_replay`` with the columns it works with. With ``carried`` each event's
    ``_before`` (``CARRIED``, or null) holds what its key's earlier log left behind."""
    ts = order[0]
    failed_before = ("max_before", F.when(F.col("failed"), F.col(ts)))
    rows = _history(
        log, failed, key, order, rows_per_slice, carried, _failed_before=failed_before
    )
    rows = _carry_on(rows, carried, _failed_before="failed_at")
    rows = rows.with_df(
        rows.df.withColumns(
            {
                "_trip": _trip_reason(rules).isNotNull(),
                "_waited": F.col(ts) - F.col("_failed_before") >= _wait(rules),
                "_successes": F.col("total") - F.col("failures"),
                "last_failure": F.when(F.col("failed"), F.col(ts)).otherwise(
                    F.col("_failed_before")
                ),
            }
        )
    )
    # ``total`` numbers the key's events, so it names the event of the last trip.
    rows = running(rows, _tripped_at=("max", F.when(F.col("_trip"), F.col("total"))))
    rows = _carry_on(rows, carried, _tripped_at="tripped_at")
    # Of the events since that trip whose wait was over, the first one: the
    # highest trip number, then the lowest event number.
    tested = F.when(
        F.col("_waited") & ~F.col("_trip"),
        F.struct(
            F.col("_tripped_at").alias("trip"),
            (-F.col("total")).alias("back"),
            (F.col("_successes") - (~F.col("failed")).cast("bigint")).alias("successes"),
        ),
    )
    rows = running(
        rows, _tested=("max", F.when(F.col("_tripped_at").isNotNull(), tested))
    )
    rows = _carry_on(rows, carried, _tested="tested")
    state = breaker_state(F.col("_tripped_at"), F.col("_tested"), F.col("_successes"), rules)
    return rows.with_df(rows.df.withColumn("state", state))


def breaker_replay(
    log: DataFrame,
    failed: Column,
    key: Sequence[str],
    order: Sequence[str],
    rules: BreakerRules = DEFAULT_RULES,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Events with ``state`` after the event (closed, open, half_open), ``total``,
    ``failures``, ``streak`` and ``last_failure``. ``order`` starts with the
    timestamp."""
    rows = _replayed(log, failed, key, order, rules, rows_per_slice)
    return rows.result().drop(
        "_settled", "_failed_before", "_trip", "_waited", "_successes", "_tripped_at", "_tested"
    )


def replay_on(
    log: DataFrame,
    failed: Column,
    key: Sequence[str],
    order: Sequence[str],
    rules: BreakerRules = DEFAULT_RULES,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``breaker_replay`` of a log that goes on from an earlier one, whose leavings are in
    ``_before``; ``_after`` is what each event leaves behind in turn."""
    rows = _replayed(log, failed, key, order, rules, rows_per_slice, carried=True)
    after = F.struct(
        "total",
        "failures",
        F.col("_settled").alias("settled"),
        F.col("last_failure").alias("failed_at"),
        F.col("_tripped_at").alias("tripped_at"),
        F.col("_tested").alias("tested"),
    ).cast(CARRIED)
    return rows.result().withColumn("_after", after)


def breaker_stats(
    log: DataFrame,
    failed: Column,
    key: Sequence[str],
    order: Sequence[str],
    rules: BreakerRules = DEFAULT_RULES,
    as_of: Column | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """One row per key after its last event. Reading the state at ``as_of`` turns
    an open breaker half-open when the wait is over by then."""
    replay = breaker_replay(log, failed, key, order, rules, rows_per_slice)
    fields = ["state", "total", "failures", "streak", "last_failure"]
    last = replay.groupBy(*key).agg(
        F.max_by(F.struct(*fields), F.struct(*order)).alias("last")
    )
    state = F.col("last.state")
    if as_of is not None:
        over = as_of - F.col("last.last_failure") >= _wait(rules)
        state = F.when((state == "open") & over, "half_open").otherwise(state)
    return last.select(
        *key,
        state.alias("state"),
        F.col("last.total").alias("total_requests"),
        F.col("last.failures").alias("total_failures"),
        F.col("last.streak").alias("consecutive_failures"),
        (F.col("last.failures") / F.greatest(F.lit(1), F.col("last.total"))).alias(
            "failure_rate"
        ),
    )
