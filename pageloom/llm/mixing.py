"""Mixing sources to target weights by Poisson replication, in native expressions.

Each source gets a mean repetition rate: target share x output size / its own size.
Every document draws a uniform number from a keyed hash and inverts the Poisson
distribution with its source's mean, which gives its count of copies. The copies are
exploded and shuffled globally by another keyed hash. Draws depend on the document
alone, so lost tasks are redone with equal results, and more partitions or sources
change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import free_name
from pageloom.session import materialize

# One inversion covers means up to this; larger means are sums of several draws.
# 80 steps reach a tail far below the 2**-52 that a draw can tell apart.
PART = 16.0
STEPS = 80


def _text(*keys: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the keys' text."""
    return F.conv(F.substring(F.md5(_text(*keys)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cumulative(mean: Column) -> Column:
    """Probabilities that a Poisson count is at most 0, 1, ... ``STEPS`` - 1."""
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("below"))

    def step(acc: Column, i: Column) -> Column:
        return F.transform(
            F.array(acc["term"] * mean / i),
            lambda term: F.struct(
                term.alias("term"),
                F.concat(acc["below"], F.array(F.element_at(acc["below"], -1) + term)).alias("below"),
            ),
        )[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS - 1)), start, step)["below"]


def _parts(mean: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(mean / PART)).cast("int")


def drawn(below: Column, parts: Column, *keys: Column) -> Column:
    """Sum of ``parts`` counts drawn from the hash of ``keys``: each is the number of
    entries of ``below`` that its draw reaches, found by halving."""
    draws = F.transform(F.sequence(F.lit(1), parts), lambda p: uniform(*keys, p))
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(STEPS.bit_length()))])

    def inverse(u: Column) -> Column:
        return F.aggregate(
            halves, F.lit(0), lambda n, s: F.when(F.get(below, n + s - 1) <= u, n + s).otherwise(n)
        )

    return F.aggregate(F.transform(draws, inverse), F.lit(0), lambda a, b: a + b)


def poisson(mean: Column, *keys: Column) -> Column:
    """A Poisson count with the given mean, drawn from the hash of ``keys``."""
    return drawn(cumulative(mean / _parts(mean)), _parts(mean), *keys)


def rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = 0.5,
    epochs: float = 1.0,
) -> DataFrame:
    """(source, rate): mean repetitions so that sources have the target shares of
    characters, and the output ``epochs`` times the input's.

    ``weights`` names target shares, others get none; without it, shares are in
    proportion to size ** ``power``, which evens out large and small sources. Sizes
    are characters of ``text`` plus one for each document, so empty ones count too.
    A null source is a source like others, named by null in ``weights``.
    """
    if epochs < 0 or (weights and min(weights.values()) < 0):
        raise ValueError("epochs and weights can't be negative")
    size = F.sum(F.length(F.coalesce("text", F.lit(""))) + 1)
    sizes = docs.groupBy("source").agg(size.cast("double").alias("size"))
    if weights is None:
        target = sizes.withColumn("weight", F.pow("size", F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame(
            list(weights.items()), "named string, weight double"
        )
        target = sizes.join(
            F.broadcast(given), F.col("source").eqNullSafe(F.col("named")), "left"
        ).fillna(0.0, ["weight"])
    target = materialize(target, "sources")
    size_sum, weight_sum = target.agg(F.sum("size"), F.sum("weight")).first()
    scale = epochs * (size_sum or 0.0) / weight_sum if weight_sum else 0.0
    return target.select("source", (F.col("weight") / F.col("size") * scale).alias("rate"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = 0.5,
    epochs: float = 1.0,
    seed: str = "mix",
    copy_name: str = "copy",
    order_name: str = "position_key",
) -> DataFrame:
    """Every document as often as its draw says, with its columns, the number of the
    copy from 0, and the key that places it: rows are dealt to partitions by its hash
    and sorted by it there.

    Draws take (seed, doc_id, md5 of text): rows with equal id and text draw alike. A
    null doc_id or source is a value like others, a null text counts as empty. Added
    columns get a leading underscore where ``docs`` has the name already.
    """
    copy_name = free_name(docs, copy_name)
    order_name = free_name(docs, order_name)
    below, parts, src, count, digest = (
        free_name(docs, n) for n in ("rate_below", "rate_parts", "rate_source", "count", "digest")
    )
    rate = F.col("rate")
    # The distribution is worked out once for each source, not for each document.
    found = materialize(
        rates(docs, weights, power, epochs).select(
            F.col("source").alias(src), _parts(rate).alias(parts), cumulative(rate / _parts(rate)).alias(below)
        ),
        "rates",
    )
    keyed = docs.join(found, F.col("source").eqNullSafe(F.col(src))).withColumn(
        digest, F.md5(F.coalesce("text", F.lit("")))
    )
    counted = keyed.withColumn(
        count, drawn(F.col(below), F.col(parts), F.lit(seed), F.col("doc_id"), F.col(digest))
    )
    key = F.md5(_text(F.lit(seed), F.lit("order"), F.col("doc_id"), F.col(copy_name), F.col(digest)))
    copies = (
        counted.filter(F.col(count) > 0)
        .select(
            *[F.col(c) for c in docs.columns],
            digest,
            F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(copy_name),
        )
        .withColumn(order_name, key)
        .drop(digest)
    )
    # The key is uniform, so its hash deals rows evenly and at random, without the
    # sampling pass that a sort by ranges needs.
    return copies.repartition(order_name).sortWithinPartitions(order_name)
