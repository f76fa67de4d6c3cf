"""Near-duplicates by SimHash, found with covering locality-sensitive hashing.

Fingerprints: ASCII letters are lower-cased, words are runs of characters other than
ASCII white space, shingles are 4 words joined by single spaces, repeats included (of
fewer words: all of them). A bit of the 64-bit fingerprint is 1 if set in more than
half of the shingles' XXH64 hashes (seed 42). A null, empty or blank text has
fingerprint zero and links like any other.

Links: two fingerprints link at ``RADIUS`` or fewer differing bits. Every bit position
gets a vector of ``RADIUS + 1`` bits; for each non-zero vector v of that size, the mask
v keeps the positions whose vector has odd overlap with v. At most ``RADIUS``
differing positions span less than the whole space, so some v is orthogonal to all
of them: the pair agrees on that mask. No pair within the radius is missed.

A bucket is one mask with the bits kept there. A bucket of two is a link to check. Up
to ``GROUP`` members are compared in place, and only links that join something new
are put out. In larger ones the positions the mask drops are covered anew by the same
rule, which drops half as many; after three masks at most 8 positions, so at most 256
different fingerprints, are left. No bucket is ever compared or gathered whole beyond
``GROUP``, and no candidate is left out.

Components come from alternating steps that hang each vertex below the smallest
neighbour, on tables in the shared folder. All work is on distinct fingerprints, so
exact copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import free_name
from pageloom.session import materialize

WORDS = 4
SEED = 42
RADIUS = 4
GROUP = 1024
# Shingles hashed before their bits are summed.
STEP = 1 << 16


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - WORDS + 1].tolist()
    stops = ends[WORDS - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), STEP):
        hashes = np.array(
            [digest(line[a:b], SEED) for a, b in zip(starts[at : at + STEP], stops[at : at + STEP])],
            "<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums in bytes for 255 rows at a time are several times faster than wide ones.
        for part in range(0, len(bits), 255):
            ones += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    packed = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(packed.view("<u8")[0])


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of ``text`` as a signed 64-bit number."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = np.array([fingerprint(t.as_py()) for t in texts], np.uint64)
            yield pa.array(values.view(np.int64))

    return docs.withColumn(name, of(F.col("text")))


def masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Covering masks over the given bit positions, as signed 64-bit numbers."""
    half = 1 << radius
    # The vectors with the top bit come first: even few positions then have an odd
    # overlap with every v, so each mask keeps something.
    order = [*range(half, 2 * half), *range(1, half)]
    vector = {p: order[i % len(order)] for i, p in enumerate(positions)}
    out = []
    for v in range(1, 2 * half):
        kept = sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2)
        out.append(kept - (1 << 64) if kept >> 63 else kept)
    return sorted(set(out))


def _dropped(mask: int) -> list[int]:
    return [p for p in range(64) if not mask >> p & 1]


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all members of one bucket within the radius, none twice."""
    u = values.view(np.uint64)
    todo = np.ones(len(u), bool)
    links = []
    for first in range(len(u)):
        if not todo[first]:
            continue
        todo[first] = False
        queue = [first]
        while queue and todo.any():
            at = queue.pop()
            rest = np.flatnonzero(todo)
            near = rest[np.bitwise_count(u[rest] ^ u[at]) <= radius]
            todo[near] = False
            queue.extend(near.tolist())
            links += [(int(values[at]), int(values[n])) for n in near]
    return links


def _within(radius: int):
    @F.pandas_udf("array<struct<a: long, b: long>>")
    def linked(groups: pd.Series) -> pd.Series:
        return groups.map(
            lambda g: [{"a": a, "b": b} for a, b in _forest(np.sort(np.asarray(g, np.int64)), radius)]
        )

    return linked


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links(prints: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(a, b) links between distinct ``fingerprint`` values, a < b, enough to join all
    that are within the radius of each other, directly or through others."""
    every = F.array(*[F.lit(m).cast("long") for m in masks(list(range(64)), radius)])
    keyed = prints.select(F.col("fingerprint").alias("f"), F.explode(every).alias("mask"))
    found = None
    while True:
        keyed = keyed.withColumn("kept", F.col("f").bitwiseAND(F.col("mask")))
        # Nearly all buckets hold one fingerprint; counting first spares their shuffle.
        sizes = materialize(
            keyed.groupBy("mask", "kept")
            .agg(F.count("*").alias("n"), F.min("f").alias("lo"), F.max("f").alias("hi"))
            .filter("n > 1"),
            "buckets",
        )
        pairs = sizes.filter(
            (F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius)
        ).select(*_ordered(F.col("lo"), F.col("hi")))
        shared = keyed.join(sizes.filter("n > 2").select("mask", "kept", "n"), ["mask", "kept"])
        small = (
            shared.filter(F.col("n") <= group)
            .groupBy("mask", "kept")
            .agg(F.collect_list("f").alias("g"))
            .select(F.explode(_within(radius)(F.col("g"))).alias("l"))
            .select(*_ordered(F.col("l.a"), F.col("l.b")))
        )
        step = materialize(pairs.union(small).distinct(), "links")
        found = step if found is None else found.union(step)
        heavy = sizes.filter(F.col("n") > group)
        used = [r["mask"] for r in heavy.select("mask").distinct().collect()]
        if not used:
            return found.distinct()
        # Each mask in use is followed by finer ones over what it dropped. Their
        # number is bounded by the level, not by the data.
        finer = {m: sorted({m | x for x in masks(_dropped(m), radius)}) for m in used}
        dropped = max(64 - (x & (1 << 64) - 1).bit_count() for f in finer.values() for x in f)
        if dropped <= 10:  # no bucket can hold more different fingerprints now
            group = max(group, 1 << dropped)
        table = prints.sparkSession.createDataFrame(
            [(m, f) for m, f in finer.items()], "mask long, finer array<long>"
        )
        keyed = (
            keyed.join(heavy.select("mask", "kept"), ["mask", "kept"])
            .join(F.broadcast(table), "mask")
            .select("f", F.explode("finer").alias("mask"))
            .distinct()
        )


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the (a, b) edges; root is the smallest vertex.

    Large-star and small-star steps in turn until nothing changes. A vertex's
    neighbours are never gathered: each step is a minimum per vertex and a join. What a
    step joins is written down, so that the edges of a vertex with very many are split.
    """
    edges = materialize(edges.filter("a <> b").select(*_ordered(F.col("a"), F.col("b"))).distinct(), "edges")
    before = None
    while True:
        # Large star: larger neighbours are hung below the smallest one around.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = edges.join(least, "a").select(F.col("m").alias("a"), "b")
        large = materialize(large.filter("a <> b").distinct(), "large")
        # Small star: smaller neighbours, and the vertex, below the smallest.
        least = materialize(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        small = large.join(least, "b").select(
            F.explode(F.array("a", "b")).alias("v"), F.col("m")
        )
        step = materialize(
            small.filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(),
            "edges",
        )
        # The sum over all edges changes whenever the edge set does.
        state = step.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
        ).first()
        edges = step
        if state == before:
            break
        before = state
    roots = edges.groupBy("b").agg(F.min("a").alias("root"))
    return roots.select(F.col("b").alias("v"), "root").union(
        roots.select(F.col("root").alias("v"), "root").distinct()
    )


def cluster(docs: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links lead to, the row's own included.
    Rows with a null doc_id take part; they are smallest of none.
    """
    marked = materialize(with_fingerprint(docs.select("doc_id", "text")).drop("text"), "prints")
    classes = materialize(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "classes")
    roots = materialize(components(links(classes, radius, group)), "roots")
    first = F.col("first")
    grown = classes.join(roots, classes["fingerprint"] == roots["v"])
    smallest = grown.groupBy("root").agg(F.min(first).alias("component"))
    joined = grown.select("fingerprint", "root").join(smallest, "root").drop("root")
    # Written down, so that the last join stands between two shuffles and a fingerprint
    # that very many documents share can be split.
    named = materialize(
        classes.join(joined, "fingerprint", "left").select(
            "fingerprint", F.coalesce("component", first).alias("component_id")
        ),
        "named",
    )
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """One row of each component: that with the smallest doc_id, of rows that share it the
    first by a hash of the text. Rows with a null doc_id are compared, but all stay.

    Rows are told apart by a number of their own, written beside them, so unlike texts that
    share a doc_id are rows like any others. Columns are returned as they are, whatever they
    are called. Only those that go are looked up, by their number; texts are not shuffled
    if these are few.
    """
    uid, mark = free_name(docs, "row_uid"), free_name(docs, "row_print")
    read = docs.select(F.col("text").alias("text"), F.struct(*docs.columns).alias("row"))
    tagged = materialize(
        with_fingerprint(read, "print").select(
            F.monotonically_increasing_id().alias(uid), F.col("print").alias(mark), "row.*"
        ),
        "tagged",
    )
    known = tagged.filter("doc_id IS NOT NULL").select(
        F.col(mark).alias("fingerprint"),
        F.struct("doc_id", F.xxhash64("text").alias("hash"), F.col(uid).alias("uid")).alias("at"),
    )
    firsts = known.groupBy("fingerprint").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    every = materialize(tagged.select(F.col(mark).alias("fingerprint")).distinct(), "classes")
    roots = materialize(components(links(every, radius, group)), "roots")
    firsts = materialize(
        firsts.join(roots, F.col("fingerprint") == F.col("v"), "left")
        .select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "first", "n"),
        "firsts",
    )
    least = firsts.groupBy("root").agg(F.min("first").alias("least"), F.sum("n").alias("rows"))
    # Written down, so that a fingerprint that very many rows share can be split.
    leaders = materialize(
        firsts.join(least.filter("rows > 1"), "root").select("fingerprint", F.col("least.uid").alias("keeps")),
        "leaders",
    )
    gone = materialize(
        tagged.filter("doc_id IS NOT NULL")
        .select(F.col(uid).alias("uid"), F.col(mark).alias("fingerprint"))
        .join(leaders, "fingerprint")
        .filter("uid <> keeps")
        .select(F.col("uid").alias(uid)),
        "gone",
    )
    return tagged.join(gone, uid, "left_anti").select(*docs.columns)
