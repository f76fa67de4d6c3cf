"""Text cleaning, chunking, hashing and cell sanitising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Python's str.split() treats as blanks, and the
# leading characters a spreadsheet may take for a formula.
WHITESPACE = r"(?U)[\s\x1c-\x1f]"
FORMULA_STARTS = ("=", "+", "-", "@", "\t", "\r")


def normalize_ws(c: Column) -> Column:
    """Runs of Unicode whitespace become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, WHITESPACE + "+", " "))


def strip_ws(c: Column) -> Column:
    """Trim Unicode whitespace at both ends only."""
    return F.regexp_replace(c, rf"{WHITESPACE}+\z|\A{WHITESPACE}+", "")


def chunk_array(c: Column, width: int | None) -> Column:
    """Consecutive slices of ``width`` code points, the last one may be shorter.

    Edges are not trimmed. ``''`` gives no slice, ``width=None`` gives the whole
    text. One regex pass keeps this linear in the text length, where
    ``substring`` per slice would walk the UTF-8 bytes from the start each time.
    """
    if width is not None and width < 1:
        raise ValueError("width must be positive or None")
    if width is None:
        return F.when(c != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))


def content_hash(c: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, as lower-case hex."""
    return F.sha2(c, 256)


def sanitize_cell(c: Column) -> Column:
    """Prefix ``'`` when the first character could start a formula."""
    return F.when(
        F.substring(c, 1, 1).isin(*FORMULA_STARTS), F.concat(F.lit("'"), c)
    ).otherwise(c)


def chunk_text(df: DataFrame, text: str = "text", width: int | None = 2000) -> DataFrame:
    """One row per slice: the other columns, then ``chunk_number`` (from 1) and
    ``content``. Rows without text vanish."""
    others = [c for c in df.columns if c != text]
    return df.select(
        *others, F.posexplode(chunk_array(F.col(text), width)).alias("pos", "content")
    ).select(*others, (F.col("pos") + 1).alias("chunk_number"), "content")
