"""Chunk sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.functions.urls import netloc, safe_dir_name
from pageloom.operators.chunks import export_chunks
from pageloom.session import scratch_path

EXPORT = "URL string, Content string, `Chunk Number` int"
_QUOTING = {"header": True, "quote": '"', "escape": '"'}


def write_chunks_csv(chunks: DataFrame, path: str) -> None:
    """Part files with a header each, quotes doubled, edge blanks kept.

    UTF-8 without byte order mark, lines end with a line feed. An empty chunk
    table writes an empty dataset.
    """
    export_chunks(chunks).write.mode("overwrite").options(
        **_QUOTING, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def read_chunks_csv(spark: SparkSession, path: str) -> DataFrame:
    """The written records; ``multiLine`` as cells may hold line breaks."""
    return (
        spark.read.schema(EXPORT)
        .options(**_QUOTING, multiLine=True, emptyValue="", nullValue="\0")
        .csv(path)
    )


def write_chunks_by_site(
    chunks: DataFrame, path: str, format: str = "parquet"
) -> None:
    """One directory per site.

    The rebalance hint gathers a site's rows into few files, and lets adaptive
    execution split a site that is too big for one task.
    """
    placed = chunks.withColumn("site", safe_dir_name(netloc(F.col("url"))))
    placed.hint("rebalance", "site").write.mode("overwrite").partitionBy("site").format(
        format
    ).save(path)


def write_site_buckets(chunks: DataFrame, path: str, buckets: int = 1024, format: str = "parquet") -> None:
    """The same for any number of sites: sites share ``buckets`` directories by their hash.

    Small sites share files, a large one gets several: there are about as many files as
    buckets, and more only where a bucket is too big for one task. Rows of a file are sorted by
    site, so a reader skips what it does not need. ``_manifest`` below ``path`` lists
    (bucket, site, chunks).
    """
    if buckets < 1:
        raise ValueError("at least one bucket is needed")
    site = safe_dir_name(netloc(F.col("url")))
    placed = chunks.withColumn("site", site).withColumn("bucket", _bucket(F.col("site"), buckets))
    dealt = placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "site")
    dealt.write.mode("overwrite").partitionBy("bucket").format(format).save(path)
    spark = chunks.sparkSession
    written = spark.read.format(format).schema(placed.schema).load(path)
    listed = written.groupBy("bucket", "site").agg(F.count("*").alias("chunks"))
    listed.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/_manifest")


def _bucket(site: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(site), F.lit(buckets)).cast("int")


def site_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, site, chunks, buckets) of a folder that ``write_site_buckets`` wrote."""
    return spark.read.schema("bucket int, site string, chunks bigint, buckets int").parquet(f"{path}/_manifest")


def read_site(spark: SparkSession, path: str, site: str, format: str = "parquet") -> DataFrame:
    """The chunks of one site, read from its bucket alone."""
    known = site_manifest(spark, path).select("buckets").first()
    every = spark.read.format(format).load(path)
    if known is None:
        return every.limit(0)
    return every.filter((F.col("bucket") == _bucket(F.lit(site), known["buckets"])) & (F.col("site") == site)).drop("bucket")


def write_chunks_stream(
    chunks: DataFrame, path: str, checkpoint: str | None = None, once: bool = True
) -> StreamingQuery:
    """Append chunks to a parquet table as pages arrive. ``once`` works off what
    is there and stops; the checkpoint makes a rerun go on from there."""
    place = checkpoint or scratch_path(chunks.sparkSession, "stream")
    writer = (
        chunks.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", place)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
