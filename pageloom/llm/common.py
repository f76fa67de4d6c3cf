"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; a null id counts as "null"."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % folds


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, also not in another case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hashed_sample(df: DataFrame, key: str, size: int) -> DataFrame:
    """The ``size`` rows with the smallest hashes of ``key``: a sample that does not
    depend on partitioning. Spark keeps at most ``size`` rows per task for it."""
    return df.orderBy(F.xxhash64(F.lit("sample"), F.col(key)), F.col(key)).limit(size)
