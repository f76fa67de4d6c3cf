"""Page snapshots. Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pageloom.functions.charset import decode_body

PAGES = "url string, html string"
RAW_PAGES = "url string, body binary, charset string, status int"


def read_pages(
    spark: SparkSession, path: str, format: str = "parquet", schema: str | StructType = PAGES
) -> DataFrame:
    """(url, html) from parquet, JSON, CSV or ORC; CSV cells may be quoted and hold
    line breaks."""
    reader = spark.read.schema(schema)
    if format == "csv":
        reader = reader.options(header=True, multiLine=True, quote='"', escape='"')
    return reader.format(format).load(path)


def spread_splits(df: DataFrame) -> DataFrame:
    """Use all cores when a scan has fewer splits than there are cores, as that of
    one small file has; a scan of many splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_page_files(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """(url, body, charset, status) of loose files below ``path``; the URL is
    ``base_url`` and the relative path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/")
    relative = F.regexp_replace("path", rf"^.*\Q{root}\E/", "")
    return files.select(
        F.concat(F.lit(base_url.rstrip("/") + "/"), relative).alias("url"),
        F.col("content").alias("body"),
        F.lit(None).cast("string").alias("charset"),
        F.lit(200).alias("status"),
    )


def decode_pages(raw: DataFrame) -> DataFrame:
    """(url, html) from raw bodies; error statuses give no content."""
    body = F.when(F.coalesce("status", F.lit(200)) < 400, F.col("body"))
    return raw.select("url", decode_body(body, F.col("charset")).alias("html"))


def read_pages_stream(
    spark: SparkSession,
    path: str,
    schema: str | StructType = PAGES,
    max_files: int = 1000,
    format: str = "parquet",
) -> DataFrame:
    """Newly arriving snapshot files; ``max_files`` bounds a micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .format(format)
        .load(path)
    )
