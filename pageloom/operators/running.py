"""Running totals over ordered keys, also when one key holds most rows.

A window partitioned by the key puts each key into one task. That is right for
keys of moderate size. ``spread_keys`` measures the biggest key; beyond a bound
it range-partitions the rows by (key, order) into slices of even size, which cut
through big keys. ``running`` then works per slice and adds what the key carried
in from its earlier slices. At most one key crosses each slice border, so the
carried table has at most as many rows as there are slices and is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import materialize

ROWS_PER_SLICE = 5_000_000
# Carried rows are broadcast; the slice count stays within this bound and the
# slices grow beyond ROWS_PER_SLICE instead.
MAX_SLICES = 100_000
SLICE = "_slice"


@dataclass(frozen=True)
class Keyed:
    """Rows with their ordering columns; ``sliced`` if big keys were split."""

    df: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]
    sliced: bool = False

    def with_df(self, df: DataFrame) -> Keyed:
        return Keyed(df, self.key, self.order, self.sliced)

    def result(self) -> DataFrame:
        return self.df.drop(SLICE)


def spread_keys(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> Keyed:
    """Split the rows of big keys into slices; leave ``df`` alone if no key has
    more than ``rows_per_slice`` rows. (key, order) should be unique."""
    key, order = tuple(key), tuple(order)
    sizes = df.groupBy(*key).count().agg(F.max("count"), F.sum("count")).first()
    biggest, total = sizes[0] or 0, sizes[1] or 0
    if biggest <= rows_per_slice:
        return Keyed(df, key, order)
    slices = min(MAX_SLICES, -(-total // rows_per_slice))
    # The slice numbers are written down: range borders come from a sample, and
    # a second evaluation might draw them elsewhere.
    written = materialize(
        df.repartitionByRange(slices, *key, *order).withColumn(
            SLICE, F.spark_partition_id()
        ),
        "slices",
    )
    return Keyed(written, key, order, sliced=True)


_AGGREGATE = {"sum": F.sum, "max": F.max, "max_before": F.max}


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    return F.greatest(carried, local)


def running(rows: Keyed, **values: tuple[str, Column]) -> Keyed:
    """Add running aggregates, given as ``name=(kind, column)``, kind ``sum``,
    ``max`` or ``max_before``, which leaves the current row out.

    On sliced rows this runs a job for what is carried from slice to slice and
    writes that down, so that later steps do not work it out again.
    """
    parts = ([SLICE] if rows.sliced else []) + list(rows.key)
    ordered = Window.partitionBy(*parts).orderBy(*rows.order)

    def local(kind: str, col: Column) -> Column:
        last = -1 if kind == "max_before" else Window.currentRow
        frame = ordered.rowsBetween(Window.unboundedPreceding, last)
        return _AGGREGATE[kind](col).over(frame)

    counted = rows.df.select(
        "*", *[local(kind, col).alias(n) for n, (kind, col) in values.items()]
    )
    if not rows.sliced:
        return rows.with_df(counted)

    per_slice = rows.df.groupBy(SLICE, *rows.key).agg(
        *[_AGGREGATE[kind](col).alias(n) for n, (kind, col) in values.items()]
    )
    slices = Window.partitionBy(*rows.key).orderBy(SLICE)
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(
        per_slice.select(
            F.col(SLICE).alias("_at"),
            *[F.col(k).alias(f"_key_{k}") for k in rows.key],
            F.row_number().over(slices).alias("_nth"),
            *[
                _AGGREGATE[kind](n).over(earlier).alias(f"_carried_{n}")
                for n, (kind, _) in values.items()
            ],
        )
        .filter("_nth > 1")
        .drop("_nth"),
        "carried",
    )
    same = F.col(SLICE) == F.col("_at")
    for k in rows.key:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = counted.join(F.broadcast(carried), same, "left")
    return rows.with_df(
        joined.select(
            *rows.df.columns,
            *[
                _combine(kind, F.col(f"_carried_{n}"), F.col(n)).alias(n)
                for n, (kind, _) in values.items()
            ],
        )
    )
