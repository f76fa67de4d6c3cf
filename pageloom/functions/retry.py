"""Planned waits between fetch attempts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def backoff_delay(
    attempt: Column, base_delay: float = 1.0, jitter: bool = True, seed: int | None = None
) -> Column:
    """``base_delay * 2^attempt`` seconds, plus up to one second of jitter."""
    delay = F.lit(float(base_delay)) * F.pow(F.lit(2.0), attempt)
    if not jitter:
        return delay
    return delay + (F.rand() if seed is None else F.rand(seed))


def retry_after_delay(header: Column, base_delay: float = 1.0) -> Column:
    """Whole seconds named by a Retry-After header.

    A missing header gives ``base_delay`` cut to whole seconds. NULL means the
    header is there but holds no whole number (a date, say); callers treat such
    an attempt as fatal.
    """
    whole = F.regexp_extract(header, r"^\s*([+-]?\d+)\s*$", 1)
    return F.when(header.isNull(), F.lit(int(base_delay)).cast("bigint")).otherwise(
        whole.try_cast("bigint")
    )
