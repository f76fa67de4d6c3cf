"""Deduplication of a stream against a written table of what was kept, instead of a state store.

Each micro-batch is reduced to the first row of each value, in an order that the caller
names, and compared with the values that earlier batches kept. So it is settled which copy
survives: the first in that order of the earliest batch. A state store keeps whichever comes
first in a task, and only knows the value.

The table holds value and time only, one part per batch. Every ``COMPACT`` batches it is
written whole, without what ``within`` has let go of, so with ``within`` its size follows the
values of that span, not the length of the stream, and a run of repeats adds nothing. A batch
that is run again replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.session import materialize, scratch_path

COMPACT = 16
_KNOWN = "value string, seen timestamp, batch int"


def _value(column: str) -> Column:
    """The value with a sign before it, and '' for null, which is a value like others."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


class _Step:
    """One micro-batch: find the first row of each new value, write rows and values."""

    def __init__(self, path, known, column, order, within, event_time):
        self.path, self.known = path, known
        self.column, self.order = column, order
        self.within, self.event_time = within, event_time

    def known_before(self, spark: SparkSession, batch: int) -> DataFrame:
        if not batch:
            return spark.createDataFrame([], _KNOWN)
        whole = (batch - 1) // COMPACT * COMPACT
        every = spark.read.schema(_KNOWN).parquet(self.known)
        return every.filter((F.col("batch") >= whole) & (F.col("batch") < batch))

    def live(self, known: DataFrame, arrived: DataFrame) -> DataFrame:
        """What was kept no longer than ``within`` before the newest time there is."""
        if not self.within:
            return known
        newest = arrived.agg(F.max("_time").alias("t")).union(known.agg(F.max("seen")))
        # One row.
        horizon = newest.agg((F.max("t") - F.expr(f"INTERVAL {self.within}")).alias("_horizon")).first()[0]
        return known if horizon is None else known.filter(F.col("seen").isNull() | (F.col("seen") > F.lit(horizon)))

    def __call__(self, arrived: DataFrame, batch: int) -> None:
        spark = arrived.sparkSession
        columns = arrived.columns
        rest = [c for c in columns if c not in (*self.order, self.column)]
        added = {
            "_value": _value(self.column),
            "_time": F.col(self.event_time).cast("timestamp") if self.within else F.lit(None).cast("timestamp"),
            "_tie": F.xxhash64(*rest) if rest else F.lit(0).cast("bigint"),
            "_row": F.monotonically_increasing_id(),
        }
        arrived = materialize(arrived.withColumns(added), "arrived")
        # Reduced before the shuffle: a value that fills the batch sends one row per task.
        place = F.struct(*self.order, "_tie", "_row")
        firsts = materialize(
            arrived.groupBy("_value").agg(F.min(place)["_row"].alias("_first"), F.max("_time").alias("_seen")),
            "firsts",
        )
        known = self.live(self.known_before(spark, batch), arrived)
        again = known.join(firsts, F.col("value") == F.col("_value"), "left_semi").select("value")
        fresh = materialize(firsts.join(again, F.col("_value") == F.col("value"), "left_anti"), "fresh")
        kept = arrived.join(fresh.select(F.col("_first").alias("_row")), "_row", "left_semi")
        kept.select(*columns).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        left = fresh.select(F.col("_value").alias("value"), F.col("_seen").alias("seen"))
        if batch % COMPACT == 0:
            left = left.union(known.select("value", "seen")).groupBy("value").agg(F.max("seen").alias("seen"))
        left.write.mode("overwrite").parquet(f"{self.known}/batch={batch}")


def dedup_table_stream(
    chunks: DataFrame,
    path: str,
    column: str = "content_hash",
    order: tuple[str, ...] = ("url", "chunk_number"),
    within: str | None = None,
    event_time: str = "fetched_at",
    checkpoint: str | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Write the first row of each value of ``column`` below ``path``; ``read_kept`` reads them.

    Of the rows of a micro-batch that share a value the first by ``order`` is kept, if no
    earlier batch kept that value. With ``within`` (an interval such as ``"7 days"``) a value
    is forgotten when the newest ``event_time`` there is has gone that far beyond the newest
    copy in the batch that kept it; a later copy then passes again. Values without a time are
    never forgotten. Null is a value like others. ``once`` works off what is there and stops;
    the checkpoint, in a folder all executors share, makes a rerun go on from there.

    Each batch reads the value and time of what is remembered once, which suits large batches;
    for small ones ``dedup_stream`` with its state store costs less.
    """
    place = checkpoint or scratch_path(chunks.sparkSession, "kept")
    step = _Step(path, f"{place}/known", column, order, within, event_time)
    writer = chunks.writeStream.foreachBatch(step.__call__).option("checkpointLocation", f"{place}/stream")
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_kept(chunks: DataFrame, path: str) -> DataFrame:
    """The rows kept so far, with the columns of the stream ``chunks``."""
    return chunks.sparkSession.read.schema(chunks.schema).parquet(f"{path}/batch=*")
