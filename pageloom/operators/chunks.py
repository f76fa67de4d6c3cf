"""Chunk tables: (url, chunk_number, content, content_hash)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.html import (
    html_to_text,
    html_to_text_parsed,
    page_native,
    page_parsed,
)
from pageloom.functions.text import chunk_text, content_hash, sanitize_cell
from pageloom.session import materialize, once


def drop_failed(pages: DataFrame, content: str = "html") -> DataFrame:
    """Pages that came back with a body."""
    return pages.filter(F.col(content).isNotNull() & (F.col(content) != ""))


def page_texts(pages: DataFrame, parsed: bool = True) -> DataFrame:
    """(url, text); the HTML goes no further than this."""
    text: Column = html_to_text_parsed("html") if parsed else html_to_text(F.col("html"))
    return drop_failed(pages).select("url", text.alias("text"))


def page_contents(pages: DataFrame, parsed: bool = True) -> DataFrame:
    """(url, text, hrefs) of the pages that came back with a body, in one pass."""
    read: Column = page_parsed("html") if parsed else page_native(F.col("html"))
    both = once(drop_failed(pages), "_read", read)
    return both.select("url", "_read.text", "_read.hrefs")


def hash_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("content_hash", content_hash(F.col("content")))


def chunk_pages(
    pages: DataFrame, split_length: int | None = 2000, parsed: bool = True
) -> DataFrame:
    """All chunks of all pages, numbered within the page, with their hash."""
    return hash_chunks(chunk_text(page_texts(pages, parsed), "text", split_length))


def _repeated(written: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(_hash, _kept): the hashes that several rows have, and the row to keep."""
    place = F.struct(*order, "_tie", "_row")
    return (
        written.groupBy("content_hash")
        .agg(F.min(place).alias("_first"), F.count("*").alias("_copies"))
        .filter("_copies > 1")
        .select(F.col("content_hash").alias("_hash"), F.col("_first._row").alias("_kept"))
    )


def dedup_chunks(
    chunks: DataFrame, order: tuple[str, ...] = ("url", "chunk_number")
) -> DataFrame:
    """Keep each content once: the chunk first in ``order``.

    The chunks are written down with a number each. Only hash, order and number are
    shuffled, to find the chunks that must go: those behind the first of their hash. These
    are taken out of the written table by their number, so no content is in a sort or an
    aggregation, and none is shuffled as long as the repeats are few. A text that fills a
    third of all rows is reduced before the shuffle, and its rows are split between tasks
    when they are compared with the first.
    """
    rest = [c for c in chunks.columns if c not in (*order, "content_hash")]
    # Chunks alike in order and hash are told apart by what else they hold.
    tie = F.xxhash64(*rest) if rest else F.lit(0).cast("bigint")
    written = materialize(chunks.withColumns({"_row": F.monotonically_increasing_id(), "_tie": tie}), "chunks")
    repeated = materialize(_repeated(written, order), "repeated")
    again = written.select("content_hash", "_row").join(repeated, F.col("content_hash").eqNullSafe(F.col("_hash")))
    gone = materialize(again.filter("_row <> _kept").select("_row"), "gone")
    return written.join(gone, "_row", "left_anti").select(*chunks.columns)


def export_chunks(chunks: DataFrame) -> DataFrame:
    """The export record, safe to open in a spreadsheet."""
    return chunks.select(
        sanitize_cell(F.col("url")).alias("URL"),
        sanitize_cell(F.col("content")).alias("Content"),
        F.col("chunk_number").alias("Chunk Number"),
    )
