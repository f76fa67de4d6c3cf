"""Hard negatives by a secondary-sort shuffle.

Pair scores are packed into keys (anchor, descending score, kind, id) whose bytes sort as
the tuple does. ``repartitionAndSortWithinPartitions`` brings each anchor's keys to one
partition in that order, where an iterator walks over them: a positive opens a window, a
negative is handed to each open window that its score fits. The iterator holds the windows
of one anchor, never its rows. At equal scores positives come first, so that a window is
open before the negatives that fit it.

Before the shuffle each block of rows is reduced to what can matter. Blocks pair a bounded
number of anchors with a bounded number of rows, so that every anchor meets every row once.
In a first round a block puts out an anchor's ``positives`` best rows of its label; the
first of all blocks are the anchor's positives. In a second round, with the scores of the
positives known, it puts out the ``negatives`` best rows of other labels within the window
of each. Whatever is left out has enough better rows in its own block.

Anchors and rows: rows with a null id, label or vector, or a null or non-finite component
take no part. Of several anchors with one id the one with the smallest (label, vector) is
used. Rows that share the anchor's id are no partners of it; other repeated rows all count.
Shorter vectors count as filled up with zeros. A table without anchors gives no rows.
Scores are 64-bit integers; components beyond about 2**25 would overflow them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.topk import SCALE, matrix, products
from pageloom.session import materialize

POSITIVES = 5
NEGATIVES = 3
# Percent of the positive's score that a negative has at least and at most.
LOW, HIGH = 50, 95
# Rows of a block on either side; blocks are smaller where that keeps all tasks busy.
BLOCK_ROWS = 65536
LEAST_ROWS = 2048
# Scores held at once while a block is worked through.
STEP_SCORES = 1 << 22

_KEY = ">QQBQ"
_HALF = 1 << 63
_FOUND = pa.schema([("key", pa.binary())])


def pack(anchor: int, score: int, negative: bool, vec_id: int) -> bytes:
    return struct.pack(_KEY, anchor + _HALF, _HALF - 1 - score, negative, vec_id + _HALF)


def unpack(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, vec_id = struct.unpack(_KEY, key)
    return anchor - _HALF, _HALF - 1 - score, bool(negative), vec_id - _HALF


def labelled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v, spot): components as floor(scale * x); ``spot`` is an arbitrary
    number that differs between equal rows too. Unusable rows are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    return vectors.filter(known & x.isNotNull() & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"),
        F.xxhash64(F.monotonically_increasing_id()).alias("spot"),
    )


def _first(scores: np.ndarray, fit: np.ndarray, n: int) -> np.ndarray:
    """The places in ``fit`` of the ``n`` highest scores, ties to the earlier place."""
    if len(fit) > n:
        kth = np.partition(scores[fit], len(fit) - n)[len(fit) - n]
        fit = fit[scores[fit] >= kth]
    return fit[np.argsort(-scores[fit], kind="stable")[:n]]


def _block(width: int, pick):
    """Reduce one block: ``pick`` chooses places among an anchor's scores."""

    def reduce(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        ids = right["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, labels = ids[order], right["label"].to_numpy()[order]
        rows = matrix(right["v"], width)[order]
        asked = matrix(left["v"], width)
        anchors, own = left["vec_id"].to_numpy(), left["label"].to_numpy()
        wanted = left["scores"].to_pylist() if "scores" in left.column_names else [None] * len(own)
        keys = []
        step = max(1, STEP_SCORES // len(ids))
        for at in range(0, len(asked), step):
            for i, scores in enumerate(products(asked[at : at + step], rows), at):
                anchor = int(anchors[i])
                places, negative = pick(scores, labels == own[i], ids != anchor, wanted[i])
                keys += [pack(anchor, int(scores[p]), negative, int(ids[p])) for p in places]
        return pa.table([pa.array(keys, pa.binary())], schema=_FOUND)

    return reduce


def _blocks(anchors: DataFrame, rows: DataFrame, parts: tuple[int, int], width: int, pick) -> DataFrame:
    """Packed keys of all blocks: every anchor block with every block of rows."""
    asked, dealt = parts

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.withColumn("asked", F.pmod(F.xxhash64("vec_id"), F.lit(asked)).cast("int"))
    right = rows.withColumn("dealt", F.pmod("spot", F.lit(dealt)).cast("int")).drop("spot")
    keys = ["asked", "dealt"]
    return (
        left.withColumn("dealt", all_of(dealt))
        .groupBy(*keys)
        .cogroup(right.withColumn("asked", all_of(asked)).groupBy(*keys))
        .applyInArrow(_block(width, pick), "key binary")
    )


def _sorted(keys: DataFrame, walk, schema: str) -> DataFrame:
    """Run ``walk`` over each partition's keys in order, all of an anchor in one of them."""
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.rdd.map(lambda row: (bytes(row[0]), None)).repartitionAndSortWithinPartitions(
        parts, lambda key: zlib.crc32(key[:8])
    )
    found = dealt.mapPartitions(lambda pairs: walk(unpack(key) for key, _ in pairs))
    return spark.createDataFrame(found, schema, verifySchema=False)


def _leading(positives: int):
    def walk(keys: Iterator[tuple[int, int, bool, int]]) -> Iterator[tuple]:
        anchor, seen = None, 0
        for a, score, _, vec_id in keys:
            anchor, seen = a, (seen if a == anchor else 0) + 1
            if seen <= positives:
                yield a, vec_id, score

    return walk


def _windows(negatives: int, low: int, high: int):
    def walk(keys: Iterator[tuple[int, int, bool, int]]) -> Iterator[tuple]:
        anchor, windows = None, []
        for a, score, negative, vec_id in keys:
            if a != anchor:
                anchor, windows = a, []
            if not negative:
                windows.append([vec_id, score, 0])
                continue
            for window in windows:
                positive, top, given = window
                if given < negatives and low * top <= 100 * score <= high * top:
                    window[2] += 1
                    yield a, positive, given + 1, vec_id, top, score

    return walk


def mine(
    vectors: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the
    rows of ``vectors`` (vec_id, label, embedding) that satisfy ``anchors``.

    An anchor's positives are its ``positives`` best other rows of the same label; each is
    given the first ``negatives`` rows of other labels whose score is between ``low`` and
    ``high`` percent of the positive's. Scores are inner products of quantised vectors,
    higher first, ties to the smaller id.
    """
    spark = vectors.sparkSession
    schema = (
        "anchor_id long, positive_id long, rank int, negative_id long, "
        "positive_score long, negative_score long"
    )
    base = materialize(labelled(vectors, scale), "labelled")
    asked = materialize(
        base.filter(anchors)
        .groupBy("vec_id")
        .agg(F.min(F.struct("label", "v")).alias("first"))
        .select("vec_id", "first.label", "first.v"),
        "anchors",
    )
    total, width = base.agg(F.count("*"), F.max(F.size("v"))).first()
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], schema)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(LEAST_ROWS, min(BLOCK_ROWS, -(-total // tasks)))
    parts = (-(-n_asked // BLOCK_ROWS), -(-total // size))

    def same(scores, alike, other, _):
        return _first(scores, np.flatnonzero(alike & other), positives), False

    def fitting(scores, alike, other, tops):
        rest = np.flatnonzero(~alike & other)
        near = scores[rest]
        picked = [
            rest[_first(near, np.flatnonzero((low * t <= 100 * near) & (100 * near <= high * t)), negatives)]
            for t in set(tops)
        ]
        return np.unique(np.concatenate(picked)), True

    best = _blocks(asked, base, parts, width, same)
    found = materialize(
        _sorted(best, _leading(positives), "anchor_id long, positive_id long, score long"), "positives"
    )
    # A positive with a score below zero has no window. At most ``positives`` an anchor.
    tops = found.filter("score >= 0").groupBy("anchor_id").agg(F.collect_list("score").alias("scores"))
    seeking = asked.join(tops.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    hard = materialize(_blocks(seeking, base, parts, width, fitting), "negatives")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            keys = [pack(a, s, False, p) for a, p, s in rows]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], schema=_FOUND)

    opened = found.filter("score >= 0").mapInArrow(packed, "key binary")
    return _sorted(hard.union(opened), _windows(negatives, low, high), schema)
