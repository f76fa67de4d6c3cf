"""A Merkle manifest of a dataset, with proofs by checkpoint and recompute.

Leaves: H, the lower-case hex SHA-256, over the fields of a row, each written as its length
in bytes, a colon and the value, or ``-`` if null. Per group, leaves ascend by the ordering
column. While several nodes remain, every ``ARITY`` consecutive ones become the H of their
hex digests; a last run may be shorter, even one node. What remains is the group's subroot.
The subroots, in group order (null first, by bytes), form a tree of their own to the root.

Only every ``STRIDE``-th level is stored, as blocks: the ``ARITY ** STRIDE`` nodes below one
node of the next stored level. A block is all that is needed to work out the levels between.
Proofs are made from the top down: each block is joined with the path above it, the missing
levels are worked out again, each node gets its siblings level by level with the path above
appended, and the levels are dropped. A proof is a list of (left, right): the digests beside
the node within its run, joined up, from the leaf to the root.

Rows are numbered within their group by range-partitioned slices and their counts, so a
group of any size is spread evenly, equal rows too. No task holds more than one block.

Rows with equal ordering values are ordered by leaf; null values come first. A null group is
a group like any other. A lone leaf is its group's subroot. An empty table has no root.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import materialize, once

ARITY = 3
STRIDE = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left: string, right: string>>"
# Rows of one task's number are counted in the lower bits of Spark's identifiers.
_ROW_BITS = 33


def leaf(*fields: Column) -> Column:
    def written(field: Column) -> Column:
        text = field.cast("string")
        sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        return F.coalesce(sized, F.lit("-"))

    return F.sha2(F.concat(*map(written, fields)), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along a proof."""
    return F.aggregate(
        path, digest, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]), 256)
    )


def path_digest(path: Column) -> Column:
    """H of all siblings of a proof in a row."""
    beside = F.transform(path, lambda run: F.concat(run["left"], run["right"]))
    return F.sha2(F.array_join(beside, ""), 256)


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, a row's number from 0 within its group, and ``n``, the group's size."""
    dealt = rows.withColumn("_spot", F.monotonically_increasing_id())
    by = [group, *order, "_spot"]
    written = materialize(
        dealt.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("_spot")
        .withColumn("_at", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("_slice", F.shiftright("_at", _ROW_BITS))
    # One row per group and slice; a group crosses at most all slices.
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = written.groupBy(group, "_slice").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    starts = materialize(
        slices.select(
            F.col(group).alias("_group"),
            F.col("_slice").alias("_in"),
            (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_rows").over(whole).alias("n"),
        ),
        "starts",
    )
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_in"))
    placed = written.join(starts, same).withColumn("pos", F.col("_at") + F.col("_shift"))
    return placed.drop("_at", "_slice", "_group", "_in", "_shift")


def _height(n: str) -> Column:
    """Levels above the leaves of a group of ``n``."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= ARITY
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda x: x < F.col(n)))


def _with_levels(blocks: DataFrame) -> DataFrame:
    """Add ``levels``: the block's nodes and the ``steps`` levels above them."""
    above = f"""
        transform(sequence(0, cast((size(element_at(acc, -1)) - 1) div {ARITY} as int)), i ->
          sha2(array_join(slice(element_at(acc, -1), {ARITY} * i + 1, {ARITY}), ''), 256))"""
    steps = ", ".join(map(str, range(STRIDE)))
    levels = F.expr(
        f"aggregate(slice(array({steps}), 1, steps), array(nodes), (acc, s) -> concat(acc, array({above})))"
    )
    return once(blocks, "levels", levels)


@dataclass(frozen=True)
class Tree:
    """Stored levels as blocks (grp, block, n, steps, last, nodes, rows), lowest first, and
    ``tops`` (grp, digest) of all groups."""

    stored: list[DataFrame]
    tops: DataFrame


def build(leaves: DataFrame) -> Tree:
    """The tree of (grp, pos, n, digest, row); ``row`` may hold anything that goes along."""
    size = ARITY**STRIDE
    nodes, stored, tops, done = leaves, [], [], 0
    while True:
        blocks = (
            nodes.groupBy("grp", F.expr(f"pos div {size}").alias("block"))
            .agg(
                F.max("n").alias("n"),
                F.array_sort(F.collect_list(F.struct("pos", "digest", "row"))).alias("of"),
            )
            .withColumn("steps", F.least(F.lit(STRIDE), _height("n") - done))
            .select(
                "grp",
                "block",
                "n",
                "steps",
                (_height("n") <= done + STRIDE).alias("last"),
                F.col("of.digest").alias("nodes"),
                F.col("of.row").alias("rows"),
            )
        )
        blocks = materialize(blocks, f"level-{done}")
        top = F.element_at(F.element_at("levels", -1), 1)
        grown = _with_levels(blocks.drop("rows")).select(
            "grp", F.col("block").alias("pos"), "n", top.alias("digest"), "last", F.lit(None).cast("int").alias("row")
        )
        stored.append(blocks)
        tops.append(grown.filter("last").select("grp", "digest"))
        done += STRIDE
        if blocks.filter("NOT last").isEmpty():
            break
        nodes = grown.filter("NOT last")
    for more in tops[1:]:
        tops[0] = tops[0].union(more)
    return Tree(stored, materialize(tops[0], "tops"))


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """(grp, pos, digest, row, path, top) of all leaves. ``above`` (grp, path, top) holds what
    follows a group's top node."""
    powers = ", ".join(str(ARITY**level) for level in range(STRIDE))
    steps = ", ".join(map(str, range(STRIDE)))
    at = f"cast(i div element_at(array({powers}), s + 1) as int)"
    beside = f"""
        transform(slice(array({steps}), 1, steps), s -> named_struct(
          'left', array_join(slice(levels[s], {at} - {at} % {ARITY} + 1, {at} % {ARITY}), ''),
          'right', array_join(slice(levels[s], {at} + 2, {ARITY} - 1 - {at} % {ARITY}), '')))"""
    each = F.expr(f"""
        transform(sequence(0, size(nodes) - 1), i -> named_struct(
          'pos', block * {ARITY**STRIDE} + i, 'digest', nodes[i], 'row', rows[i],
          'path', concat({beside}, path)))""")
    higher = None
    for level in reversed(range(len(tree.stored))):
        blocks = tree.stored[level]
        over = above.select(F.col("grp").alias("_grp"), "path", "top")
        same = F.col("grp").eqNullSafe(F.col("_grp"))
        open_ = blocks.filter("last").join(over, same)
        if higher is not None:
            over = higher.select(F.col("grp").alias("_grp"), F.col("pos").alias("_pos"), "path", "top")
            open_ = open_.union(
                blocks.filter("NOT last").join(over, same & (F.col("block") == F.col("_pos"))).drop("_pos")
            )
        found = _with_levels(open_.drop("_grp")).select("grp", "top", F.explode(each).alias("of"))
        higher = found.select("grp", "of.pos", "of.digest", "of.row", "of.path", "top")
        if level:
            higher = materialize(higher.drop("digest", "row"), f"paths-{level}")
    return higher


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    group: str = "source",
    order: str = "doc_id",
    **along: Column,
) -> DataFrame:
    """(``order``, ``group``, leaf, subroot, root, proof) of every row of ``docs``, and the
    columns ``along``, worked out from ``docs``. Other columns are left out."""
    read = docs.withColumns({"_leaf": leaf(*map(F.col, fields)), **{f"_{k}": v for k, v in along.items()}})
    rows = read.select(
        F.col(group).alias("grp"),
        F.col(order).alias("_order"),
        F.col("_leaf").alias("digest"),
        F.struct(F.col(order).alias("_order"), *[F.col(f"_{k}").alias(k) for k in along]).alias("row"),
    )
    tree = build(numbered(rows, "grp", ["_order", "digest"]).drop("_order"))
    # The tree of the subroots is one group.
    tops = tree.tops.select(F.lit(0).alias("grp"), F.col("grp").alias("_of"), "digest")
    listed = numbered(tops, "grp", ["_of"]).withColumn("row", F.struct("_of")).drop("_of")
    upper = build(listed)
    last = upper.tops.first()
    root = F.lit(last["digest"] if last else None).cast("string")
    start = upper.tops.select("grp", F.array().cast(_PATH).alias("path"), F.col("digest").alias("top"))
    above = materialize(
        paths(upper, start).select(F.col("row._of").alias("grp"), "path", F.col("digest").alias("top")), "above"
    )
    return paths(tree, above).select(
        F.col("row._order").alias(order),
        F.col("grp").alias(group),
        F.col("digest").alias("leaf"),
        F.col("top").alias("subroot"),
        root.alias("root"),
        F.col("path").alias("proof"),
        *[F.col(f"row.{k}").alias(k) for k in along],
    )
