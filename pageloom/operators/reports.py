"""Summaries of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.urls import netloc


def crawl_depth_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("depth").agg(F.count("*").alias("urls"))


def run_summary(looked_up: DataFrame, chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """Per site: URLs found, processed and failed, chunks written and duplicates
    dropped. Takes ``fetch_lookup``, the chunk table and its deduplicated form."""
    site = netloc(F.col("url")).alias("site")
    done = F.col("outcome") == "processed"
    zero = F.lit(0).cast("bigint")
    parts = [
        looked_up.groupBy(site).agg(
            F.count("*").alias("found"),
            F.count_if(done).alias("processed"),
            zero.alias("chunks"),
            zero.alias("kept"),
        ),
        chunks.groupBy(site).agg(
            zero.alias("found"), zero.alias("processed"), F.count("*").alias("chunks"), zero.alias("kept")
        ),
        kept.groupBy(site).agg(
            zero.alias("found"), zero.alias("processed"), zero.alias("chunks"), F.count("*").alias("kept")
        ),
    ]
    return (
        parts[0]
        .unionByName(parts[1])
        .unionByName(parts[2])
        .groupBy("site")
        .agg(
            F.sum("found").alias("urls_found"),
            F.sum("processed").alias("urls_processed"),
            (F.sum("found") - F.sum("processed")).alias("urls_failed"),
            F.sum("kept").alias("chunks_written"),
            (F.sum("chunks") - F.sum("kept")).alias("duplicates_dropped"),
        )
    )


def content_audit(chunks: DataFrame) -> DataFrame:
    """Per site: pages, chunks and characters."""
    per_page = chunks.groupBy(netloc(F.col("url")).alias("site"), "url").agg(
        F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars")
    )
    return per_page.groupBy("site").agg(
        F.count("*").alias("pages"),
        F.sum("chunks").alias("chunks"),
        F.sum("chars").alias("chars"),
    )
