"""Streams of pages and URLs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from pageloom.operators.chunks import chunk_pages

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on local disk with changelog checkpoints, so that it
    may outgrow executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set(
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"
    )


def extract_stream(
    pages: DataFrame, split_length: int | None = 2000, parsed: bool = True
) -> DataFrame:
    """Chunks of arriving pages; no state."""
    return chunk_pages(pages, split_length, parsed)


@F.pandas_udf(BooleanType())
def _first_of_batch(value: pd.Series) -> pd.Series:
    return ~value.duplicated()


@F.pandas_udf(BooleanType())
def _newest_of_batch(value: pd.Series, time: pd.Series) -> pd.Series:
    newest = time.sort_values(ascending=False, na_position="last", kind="stable").index
    return ~value.loc[newest].duplicated().loc[value.index]


def _first_seen(
    df: DataFrame, column: str, event_time: str | None = None, within: str | None = None
) -> DataFrame:
    """Each value of ``column`` once.

    Repeats inside one Arrow batch are dropped by their value alone, without state, so
    that a value that fills much of the stream is not shuffled to one task whole; the
    state then holds each distinct value once. With a watermark the newest copy of the
    batch stays: if any of them is in time, that one is.
    """
    if not within:
        first = _first_of_batch.asNondeterministic()(F.col(column))
        return df.filter(first).dropDuplicates([column])
    newest = _newest_of_batch.asNondeterministic()(F.col(column), F.col(event_time))
    marked = df.withWatermark(event_time, within)
    return marked.filter(newest).dropDuplicatesWithinWatermark([column])


def dedup_stream(
    chunks: DataFrame, within: str | None = None, event_time: str = "fetched_at"
) -> DataFrame:
    """Each ``content_hash`` once.

    Without ``within`` a hash is remembered for ever and the state grows with the
    distinct contents. With ``within`` (an interval such as ``"7 days"``) a hash is
    forgotten that long after it was seen, so a later copy passes again.
    """
    return _first_seen(chunks, "content_hash", event_time, within)


def visited_stream(
    urls: DataFrame, within: str | None = None, event_time: str = "fetched_at"
) -> DataFrame:
    """Each ``url`` once: for ever, or with ``within`` as in ``dedup_stream``."""
    return _first_seen(urls, "url", event_time, within)


def observe_run(chunks: DataFrame, name: str = "run") -> DataFrame:
    """Report chunks and characters of every micro-batch in the query progress,
    under ``observedMetrics[name]``."""
    return chunks.observe(
        name,
        F.count("*").alias("chunks_written"),
        F.sum(F.length("content")).alias("chars"),
    )
