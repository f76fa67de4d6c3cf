"""Exact top-k by inner product with a pivot-distance index.

Vectors get one more coordinate, sqrt(M - |v|^2) with M the largest squared length, and
queries a zero there. The squared distance of a query q and a vector v is then
|q|^2 + M - 2 q.v: the nearest vectors are those with the largest inner products.

Index: every vector is keyed by its nearest pivot and the distance to it; the distances
of a pivot are cut into annuli. Pivots are k-means centres of at most ``SAMPLE_ROWS``
vectors; the index holds all vectors. Search: for a query at distance d from a pivot,
every vector of the annulus [lo, hi] is at least max(lo - d, d - hi, 0) away. Each
query visits annuli in the order of that bound, in rounds of growing size, and stops
once the bound is beyond its k-th best distance. Bounds only ever spare work: results
are exact, with ties to the smaller id.

An annulus is split into parts of bounded size, also if all its vectors are equal, and
queries are taken in blocks, so no task gets an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import hashed_sample
from pageloom.session import materialize

K = 5
SCALE = 256
SAMPLE_ROWS = 4000
MAX_PIVOTS = 128
PART_ROWS = 2048
# The table of annuli goes to every task; annuli get larger rather than more than this.
MAX_ANNULI = 65536
QUERY_ROWS = 2048
# Queries whose distances to all annuli are held at a time.
VISIT_ROWS = 64
# Annuli a query visits in the first rounds; the last round takes what is left.
ROUNDS = (4, 28)
LANES = np.int64


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components as floor(scale * x). Rows without an id, with a null vector
    or a null or non-finite component are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(x.isNotNull() & F.col("vec_id").isNotNull() & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"),
    )


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of numbers, shorter ones filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(LANES)
    out = np.zeros((len(sizes), width), LANES)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Pivots:
    """Centres in the space with the additional coordinate."""

    def __init__(self, sample: np.ndarray, square: float, n: int, rounds: int = 6):
        self.square = square
        points = self.lift(sample.astype(float))
        n = max(1, min(n, len(points)))
        rng = np.random.default_rng(11)
        self.centres = points[rng.choice(len(points), n, replace=False)]
        for _ in range(rounds):
            near = self.distances(points).argmin(axis=1)
            for c in range(n):
                if (near == c).any():
                    self.centres[c] = points[near == c].mean(axis=0)

    def lift(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.square - (v * v).sum(axis=1), 0))
        return np.hstack([v, rest[:, None]])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Distance of each (lifted) point to each centre."""
        c = self.centres
        d = (points * points).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * points @ c.T
        return np.sqrt(np.maximum(d, 0))


def products(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0))
    if top * queries.shape[1] < 2**52:  # every sum is exact in doubles
        return (queries.astype(float) @ block.astype(float).T).astype(LANES)
    return queries @ block.T


def top_k(
    vectors: DataFrame, queries: Column, k: int = K, scale: int = SCALE, pivots: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that satisfy ``queries`` the k other
    rows with the largest inner products of quantised components.

    ``vectors`` has vec_id and embedding. Shorter vectors count as filled up with zeros.
    Rows that share their vec_id are all candidates; of several queries with one vec_id
    the one with the smallest vector is run, and none is its own candidate.
    """
    spark = vectors.sparkSession
    base = materialize(quantised(vectors, scale), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    total, square, width = base.agg(
        F.count("*"), F.max(squares), F.max(F.size("v"))
    ).first()
    if not total or not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = hashed_sample(base, "vec_id", SAMPLE_ROWS).toArrow()
    n_pivots = pivots or int(np.clip(np.sqrt(total) / 4, 4, MAX_PIVOTS))
    centres = Pivots(matrix(sample["v"], width), square, n_pivots)

    @F.arrow_udf("struct<pivot: int, distance: double>")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            d = centres.distances(centres.lift(matrix(lists, width).astype(float)))
            near = d.argmin(axis=1)
            yield pa.StructArray.from_arrays(
                [pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])],
                ["pivot", "distance"],
            )

    keyed = materialize(
        base.withColumn("p", nearest("v")).select("vec_id", "v", "p.pivot", "p.distance"), "keyed"
    )
    # Annuli of about PART_ROWS vectors: quantiles of the distances to each pivot.
    per_pivot = max(PART_ROWS, -(-total // (MAX_ANNULI // 2)))
    cuts = max(1, min(MAX_ANNULI // n_pivots, -(-2 * total // (per_pivot * n_pivots))))
    shares = [i / cuts for i in range(1, cuts)]
    quantiles = keyed.groupBy("pivot").agg(
        F.percentile_approx("distance", shares, 10 * cuts + 1000).alias("q") if shares
        else F.array().cast("array<double>").alias("q")
    )
    bounds = {r["pivot"]: np.unique(r["q"]) for r in quantiles.collect()}

    @F.arrow_udf("int")
    def annulus(pivot: pa.Array, distance: pa.Array) -> pa.Array:
        p, d = pivot.to_numpy(zero_copy_only=False), distance.to_numpy(zero_copy_only=False)
        out = np.zeros(len(p), np.int32)
        for x in np.unique(p):
            out[p == x] = np.searchsorted(bounds[x], d[p == x], side="left")
        return pa.array(out)

    ringed = keyed.withColumn("ring", annulus("pivot", "distance"))
    rings = (
        ringed.groupBy("pivot", "ring")
        .agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count("*").alias("n"))
        .orderBy("pivot", "ring")
        .toPandas()
    )
    rings["id"] = np.arange(len(rings))
    rings["parts"] = -(-rings["n"] // PART_ROWS)
    known = spark.createDataFrame(rings[["pivot", "ring", "id", "parts"]])
    # At most MAX_ANNULI rows.
    index = materialize(
        ringed.join(F.broadcast(known), ["pivot", "ring"]).select(
            F.col("id").alias("annulus"),
            F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"),
            "vec_id",
            "v",
        ),
        "index",
    )
    asked = materialize(
        base.filter(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "queries"
    )
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    parts = rings["parts"].to_numpy()
    best = None
    skip = 0
    for size in (*ROUNDS, None):
        visits = materialize(
            _visits(asked, best, centres, rings, width, k, skip, size).withColumn(
                "block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))
            ),
            "visits",
        )
        pairs = visits.select("query_id", "q", F.explode("annuli").alias("annulus"), "block")
        split = spark.createDataFrame(
            [(i, list(range(int(n)))) for i, n in enumerate(parts)], "annulus long, parts array<long>"
        )
        left = pairs.join(F.broadcast(split), "annulus").withColumn("part", F.explode("parts"))
        # A part of the index goes to those blocks of queries that visit it.
        wanted = visits.select(F.explode("annuli").alias("annulus"), "block").distinct()
        wanted = wanted.join(F.broadcast(split), "annulus").withColumn("part", F.explode("parts")).drop("parts")
        right = index.join(materialize(wanted, "wanted"), ["annulus", "part"])
        keys = ["annulus", "part", "block"]
        found = (
            left.groupBy(*keys)
            .cogroup(right.groupBy(*keys))
            .applyInArrow(_compare(width, k), "query_id long, vec_id long, score long")
        )
        merged = found if best is None else found.union(best)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = materialize(
            merged.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .drop("rank"),
            "best",
        )
        skip += size or 0
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")


def _visits(
    asked: DataFrame,
    best: DataFrame | None,
    centres: Pivots,
    rings: pd.DataFrame,
    width: int,
    k: int,
    skip: int,
    size: int | None,
) -> DataFrame:
    """Each query with the annuli of the next round: ``size`` after the first ``skip`` in
    the order of their bounds (all if None), less those beyond the k-th best distance."""
    pivot, lo, hi = (rings[c].to_numpy() for c in ("pivot", "lo", "hi"))

    @F.arrow_udf("array<long>")
    def chosen(lists: pa.Array, worst: pa.Array) -> pa.Array:
        every = matrix(lists, width).astype(float)
        worst = worst.to_numpy(zero_copy_only=False).astype(float)
        out = []
        # Few queries at a time: each has a distance to every annulus.
        for at in range(0, len(every), VISIT_ROWS):
            v, kth = every[at : at + VISIT_ROWS], worst[at : at + VISIT_ROWS]
            own = (v * v).sum(axis=1)
            d = centres.distances(np.hstack([v, np.zeros((len(v), 1))]))[:, pivot]
            near = np.maximum(np.maximum(lo - d, d - hi), 0)
            limit = np.where(np.isnan(kth), np.inf, own + centres.square - 2 * kth)
            for row, most, length in zip(near, limit, own):
                order = np.argsort(row, kind="stable")[skip : None if size is None else skip + size]
                # Room for rounding: bounds come from doubles.
                slack = 1e-6 * (length + centres.square + 1)
                out.append(order[row[order] ** 2 <= most + slack])
        return pa.array(out, pa.list_(pa.int64()))

    rows = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    if best is None:
        rows = rows.withColumn("worst", F.lit(None).cast("long"))
    else:
        kth = best.groupBy("query_id").agg(
            F.when(F.count("*") >= k, F.min("score")).alias("worst")
        )
        rows = rows.join(kth, "query_id", "left")
    return rows.select("query_id", "q", chosen("q", "worst").alias("annuli"))


def _compare(width: int, k: int):
    """Best k of one part of an annulus for the queries of one block."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        asked = left["query_id"].to_numpy()
        ids = right["vec_id"].to_numpy()
        # By rising id, so that a stable sort breaks ties as wanted.
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        score = products(matrix(left["q"], width), matrix(right["v"], width)[order])
        out_q, out_v, out_s = [], [], []
        for q, row in zip(asked, score):
            other = np.flatnonzero(ids != q)
            if len(other) > k:
                kth = np.partition(row[other], len(other) - k)[len(other) - k]
                other = other[row[other] >= kth]
            first = other[np.argsort(-row[other], kind="stable")[:k]]
            out_q.append(np.full(len(first), q))
            out_v.append(ids[first])
            out_s.append(row[first])
        return pa.table([np.concatenate(x) for x in (out_q, out_v, out_s)], schema=schema)

    return compare
