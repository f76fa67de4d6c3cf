"""The circuit breaker over arriving events: each micro-batch is replayed in windows that go
on from a table of what every key's earlier events left behind.

No key's events meet in a Python loop or need a state store: a batch runs through the same
windows as ``breaker_replay``, which cut a key that fills much of a batch into slices. Output
and carried table are written per micro-batch, so a batch that is run again replaces its own
rows. Every ``COMPACT`` batches the carried table is written whole, so a batch reads at most
so many parts of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.operators.health import CARRIED, DEFAULT_RULES, BreakerRules, breaker_state, replay_on
from pageloom.operators.running import ROWS_PER_SLICE
from pageloom.session import materialize, scratch_path

COMPACT = 16
EVENTS = (
    "key string, ts timestamp, seq bigint, late boolean, state string, "
    "total bigint, failures bigint, streak bigint"
)
_COLUMNS = ("key", "ts", "seq", "late", "state", "total", "failures", "streak")
_LEFT = f"key string, after {CARRIED}, last struct<ts: timestamp, seq: bigint>"


def _newest(left: DataFrame) -> DataFrame:
    """Of several batches' leavings of a key those of the newest."""
    return left.groupBy("key").agg(F.max_by(F.struct("after", "last"), "batch").alias("of")).select("key", "of.*")


class _Step:
    """One micro-batch: read what its keys left behind, replay, write both."""

    def __init__(self, path: str, carried: str, rules: BreakerRules, rows_per_slice: int):
        self.path, self.carried = path, carried
        self.rules, self.rows_per_slice = rules, rows_per_slice

    def left_before(self, spark: SparkSession, batch: int) -> DataFrame:
        if not batch:
            return spark.createDataFrame([], f"{_LEFT}, batch int")
        whole = (batch - 1) // COMPACT * COMPACT
        every = spark.read.schema(f"{_LEFT}, batch int").parquet(self.carried)
        return every.filter((F.col("batch") >= whole) & (F.col("batch") < batch))

    def __call__(self, arrived: DataFrame, batch: int) -> None:
        spark = arrived.sparkSession
        arrived = materialize(arrived, "arrived")
        known = self.left_before(spark, batch)
        keys = arrived.select(F.col("key").alias("_key")).distinct()
        before = _newest(known.join(keys, F.col("key").eqNullSafe(F.col("_key")), "left_semi")).select(
            F.col("key").alias("_key"), F.col("after").alias("_before"), F.col("last").alias("_last")
        )
        place = F.struct("ts", "seq")
        complete = F.col("ts").isNotNull() & F.col("seq").isNotNull()
        late = F.when(complete, F.coalesce(place <= F.col("_last"), F.lit(False)))
        events = materialize(
            arrived.join(before, F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key").withColumn("late", late),
            "placed",
        )
        on_time = replay_on(
            events.filter("NOT late"), F.col("failed"), ["key"], ["ts", "seq"], self.rules, self.rows_per_slice
        )
        on_time = materialize(on_time.select(*_COLUMNS, "_after"), "replayed")
        # A late event meets the state its key had; one without a place meets none.
        old = F.col("_before")
        state = breaker_state(old["tripped_at"], old["tested"], old["total"] - old["failures"], self.rules)
        streak = old["failures"] - F.coalesce(old["settled"], F.lit(0))
        counts = {"state": state, "total": old["total"], "failures": old["failures"], "streak": streak}
        aside = events.filter("late IS NULL OR late").select(
            "key", "ts", "seq", "late", *[F.when(F.col("late"), c).alias(n) for n, c in counts.items()]
        )
        on_time.drop("_after").union(aside).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        left = on_time.groupBy("key").agg(
            F.max_by(F.struct(F.col("_after").alias("after"), place.alias("last")), F.col("total")).alias("of")
        ).select("key", "of.*")
        if batch % COMPACT == 0:
            left = _newest(known.unionByName(left.withColumn("batch", F.lit(batch))))
        left.write.mode("overwrite").parquet(f"{self.carried}/batch={batch}")


def breaker_stream(
    log: DataFrame,
    failed: Column,
    key: str,
    ts: str,
    seq: str,
    path: str,
    rules: BreakerRules = DEFAULT_RULES,
    checkpoint: str | None = None,
    once: bool = True,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> StreamingQuery:
    """Write (key, ts, seq, late, state, total, failures, streak) of every arriving event
    below ``path``; ``read_breaker`` reads them.

    Equals ``breaker_replay`` as long as events arrive in order between micro-batches. An
    event not newer than the key's newest one of an earlier batch comes out with ``late``
    true and the state it met, and does not count. An event without a time or number has no
    place in the order: it comes out with ``late`` and all counts NULL. ``once`` works off
    what is there and stops; the checkpoint, in a folder all executors share, makes a rerun
    go on from there.
    """
    place = checkpoint or scratch_path(log.sparkSession, "breaker")
    events = log.select(
        F.col(key).cast("string").alias("key"),
        F.col(ts).cast("timestamp").alias("ts"),
        F.col(seq).cast("bigint").alias("seq"),
        F.coalesce(failed, F.lit(False)).alias("failed"),
    )
    step = _Step(path, f"{place}/carried", rules, rows_per_slice)
    writer = events.writeStream.foreachBatch(step.__call__).option("checkpointLocation", f"{place}/stream")
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_breaker(spark: SparkSession, path: str) -> DataFrame:
    """The events written so far."""
    return spark.read.schema(EVENTS).parquet(f"{path}/batch=*")
