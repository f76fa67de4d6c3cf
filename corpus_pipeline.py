"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All
but the last return the columns of ``docs``; the last returns the packed pieces.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pageloom.llm import mixing, packing, pii, simhash, toxicity  # noqa: E402
from pageloom.llm.common import free_name, table  # noqa: E402
from pageloom.llm.queries import TOXIC_AT, toxicity_model  # noqa: E402
from pageloom.session import materialize  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity_model(spark, docs, sf_dir)
    score = free_name(docs, "toxicity_score")
    scored = docs.withColumn(score, toxicity.score(model, F.col("text"))["score"])
    return scored.filter(F.col(score) < TOXIC_AT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links: four-word shingles, at most four
    differing bits."""
    return simhash.keep_first(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses replaced by pseudonyms; n_chars follows."""
    found = free_name(docs, "pii_found")
    hidden = pii.pseudonymise(docs, found_name=found)
    changed = F.size(found) > 0
    return hidden.withColumn(
        "n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources get their target shares, shuffled."""
    copy, place = free_name(docs, "copy"), free_name(docs, "position_key")
    return mixing.mix(docs, copy_name=copy, order_name=place).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Trained scores and tokens are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
