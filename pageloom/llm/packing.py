"""Best-fit packing of token pieces into sequences of fixed capacity.

1. Texts become token ids and an end id. Only documents longer than the capacity are
   cut: all pieces but the first are full, the first may be shorter.
2. The pieces' length histogram, at most ``capacity`` numbers, goes to the driver.
3. The configuration linear program over the histogram (how often to use each multiset
   of lengths that fits) is solved by multiplicative weights: lengths carry weights;
   a knapsack dynamic program finds, for every length, the best-weighted pattern that
   holds it; patterns are stepped up and the lengths they cover lose weight. Its duals
   bound the optimum from below.
4. Pattern uses are rounded down to whole numbers within the histogram, and the rest is
   solved again until it is at most ``REST`` pieces, which are placed by best fit. All
   of this sees lengths and counts only, and its size does not grow with the corpus.
5. Pieces of one length are numbered in Spark, by buckets of about the square root of
   their count, so no length is gathered in one task, and looked up in the plan.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import materialize

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k.json"
ROUNDS = 12
STEP = 1.5
REST = 4096
LOOK_AHEAD = r"|\s+(?!\S)|\s+"
SPACES = re.compile(r"\s\s")

# ---------------------------------------------------------------- tokens


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    Ids are those of the ``tokenizers`` file. Where its merges are also given as ranks,
    ``tiktoken`` finds the same ids several times faster. Its pattern needs a look-ahead
    only for neighbouring white space; texts without it take a pattern that splits them
    alike and needs none, which is faster again. Texts that hold a special token's name
    go to ``tokenizers``.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = self.plain = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            with open(ranks, "rb") as lines:
                pairs = [line.split() for line in lines]
            table = {base64.b64decode(token): int(rank) for token, rank in pairs}
            pattern = public_tokenizers.PATTERN
            self.spaced, self.plain = (
                tiktoken.Encoding(p, pat_str=p, mergeable_ranks=table, special_tokens={}).encode_ordinary
                for p in (pattern, pattern.replace(LOOK_AHEAD, r"|\s"))
            )

    def ids(self, text: str) -> bytes:
        if self.spaced is None or any(name in text for name in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        elif SPACES.search(text):
            ids = self.spaced(text)
        else:
            ids = self.plain(text)
        return array("I", ids).tobytes()


def encoder(path: str) -> Encoder:
    """One encoder for a worker process, so that its memory serves later tasks too."""
    shared = sys.modules.setdefault("_pageloom_encoders", types.ModuleType("_pageloom_encoders"))
    if not hasattr(shared, path):
        setattr(shared, path, Encoder(path))
    return getattr(shared, path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, keep_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece, and ``ids`` if asked.

    A null or empty text is one piece that holds the end id alone. Rows with equal or
    null doc_id are pieces of different rows nevertheless.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
              ("length", pa.int64()), ("ids_crc32", pa.int64())]
    if keep_ids:
        schema += ", ids array<int>"
        fields.append(("ids", pa.list_(pa.int32())))
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary_path(vocabulary))
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            held = 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                raw = known.ids(text.as_py() or "") + end
                total = len(raw) // 4
                start, piece = 0, 0
                size = total % capacity or capacity
                while start < total:
                    part = raw[4 * start : 4 * (start + size)]
                    values = [doc_id, piece, start, size, zlib.crc32(part)]
                    if keep_ids:
                        values.append(np.frombuffer(part, "<i4"))
                    for column, value in zip(rows, values):
                        column.append(value)
                    start, piece, size = start + size, piece + 1, capacity
                    held += size
                if held > 4_000_000:
                    yield _batch(rows, fields)
                    rows, held = [[] for _ in fields], 0
            yield _batch(rows, fields)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def _batch(rows: list[list], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, (_, t) in zip(rows, fields)], [n for n, _ in fields])


# ---------------------------------------------------------------- plan


@dataclass
class Plan:
    """Patterns in use: lengths with multiplicities, how often, and the number of the
    first sequence. ``bound`` is a lower bound on the number of sequences."""

    capacity: int
    patterns: list[tuple[tuple[tuple[int, int], ...], int]] = field(default_factory=list)
    bound: float = 0.0

    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)

    def slots(self) -> dict[str, np.ndarray]:
        """For each length, the numbered pieces a pattern takes: rows sorted by (length,
        first), with the multiplicity, the first sequence and the offset inside it."""
        rows = []
        taken: dict[int, int] = {}
        sequence = 0
        for items, times in self.patterns:
            offset = 0
            for length, many in items:
                rows.append((length, taken.get(length, 0), many, sequence, offset))
                taken[length] = taken.get(length, 0) + many * times
                offset += length * many
            sequence += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        return dict(zip(("length", "first", "many", "sequence", "offset"), table.T.copy()))


def price(weight: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack table: best weight for each capacity, and the last length put in (0: none)."""
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)
    gain = weight[lengths]
    for c in range(1, capacity + 1):
        n = np.searchsorted(lengths, c, side="right")
        if n:
            value = best[c - lengths[:n]] + gain[:n]
            k = int(value.argmax())
            if value[k] > best[c - 1] + 1e-15:
                best[c], last[c] = value[k], lengths[k]
                continue
        best[c], last[c] = best[c - 1], -1  # one place stays empty
    return best, last


def fractional(
    counts: np.ndarray, capacity: int, rounds: int = ROUNDS
) -> tuple[dict[tuple[int, ...], float], float]:
    """Pattern uses that cover the histogram about once, and a lower bound."""
    lengths = np.flatnonzero(counts)
    need = counts[lengths].astype(float)
    weight = np.zeros(capacity + 1)
    weight[lengths] = lengths / capacity
    covered = np.zeros(capacity + 1)
    uses: dict[tuple[int, ...], float] = {}
    bound = 0.0
    for r in range(rounds):
        best, last = price(weight, lengths, capacity)
        bound = max(bound, float(counts[lengths] @ weight[lengths]) / best[capacity])
        # For every length, the best pattern that holds it: the length and the table's
        # answer for the room left. All patterns are followed back at once.
        room = capacity - lengths
        held = [lengths.copy()]
        while True:
            step = last[np.maximum(room, 0)] * (room > 0)
            if not step.any():
                break
            taken = np.maximum(step, 0)
            held.append(taken)
            room = room - np.where(step < 0, 1, taken)
        grid = np.sort(np.stack(held, axis=1), axis=1)[:, ::-1]
        own = (grid == lengths[:, None]).sum(axis=1)
        # What a length still lacks decides how far its pattern is stepped up.
        lack = np.maximum(need * (r + 1) / rounds - covered[lengths], 0)
        amount = lack / own
        for row, x in zip(grid, amount):
            if x > 0:
                key = tuple(int(v) for v in row if v > 0)
                uses[key] = uses.get(key, 0.0) + x
                for v in key:
                    covered[v] += x
        ahead = covered[lengths] / need - (r + 1) / rounds
        weight[lengths] = lengths / capacity * np.exp(-STEP * np.clip(ahead, -1, 2))
    return uses, bound


def best_fit(rest: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Place the pieces of a histogram from long to short, each where least room is left."""
    at: dict[int, list[list[int]]] = {}
    rooms = 0  # bit r is set if a sequence has room r left
    done = []
    for length in np.flatnonzero(rest)[::-1].tolist():
        for _ in range(int(rest[length])):
            fit = rooms >> length
            if fit:
                room = length + (fit & -fit).bit_length() - 1
                held = at[room].pop()
                if not at[room]:
                    rooms &= ~(1 << room)
            else:
                room, held = capacity, []
                done.append(held)
            held.append(length)
            left = room - length
            if left:
                at.setdefault(left, []).append(held)
                rooms |= 1 << left
    return [tuple(h) for h in done]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, rest: int = REST) -> Plan:
    """Whole pattern uses that hold every piece of the histogram exactly once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan = Plan(capacity)
    total = int(left @ np.arange(capacity + 1))
    plan.bound = float(-(-total // capacity))
    used: dict[tuple[int, ...], int] = {}
    if left[capacity]:
        used[(capacity,)] = int(left[capacity])
        left[capacity] = 0
    first = True
    while left.sum() > rest:
        uses, bound = fractional(left, capacity)
        if first:
            plan.bound = max(plan.bound, bound + sum(used.values()))
            first = False
        before = left.sum()
        # Fullest patterns first; a pattern never takes more than is left.
        for key in sorted(uses, key=lambda k: (-sum(k), -uses[k], k)):
            many: dict[int, int] = {}
            for v in key:
                many[v] = many.get(v, 0) + 1
            n = min(int(uses[key]), *(int(left[v]) // m for v, m in many.items()))
            if n > 0:
                used[key] = used.get(key, 0) + n
                for v, m in many.items():
                    left[v] -= n * m
        if left.sum() > 0.9 * before:
            break  # only crumbs of each pattern are left
    for key in best_fit(left, capacity):
        used[key] = used.get(key, 0) + 1
    for key, n in sorted(used.items(), reverse=True):
        items = tuple(sorted(((v, key.count(v)) for v in set(key)), reverse=True))
        plan.patterns.append((items, n))
    return plan


# ---------------------------------------------------------------- places


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table with ``length`` from 1 to capacity.

    ``pieces`` is read several times and must give the same rows each time. A column
    ``row`` that numbers the rows keeps equal ones from falling into one bucket.
    """
    spark = pieces.sparkSession
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(sizes, capacity)
    slots = spark.sparkContext.broadcast(plan.slots())
    # Numbers within a length: about sqrt(n) buckets of sqrt(n) pieces each.
    counts = spark.createDataFrame(
        [(int(k), max(1, int(n**0.5))) for k, n in sizes.items()] or [(1, 1)], "length long, buckets int"
    )
    known = [c for c in pieces.columns if c != "length"]
    names = ("doc_id", "piece", "start", "ids_crc32", "row")
    spread = F.xxhash64(*[F.col(c) for c in names if c in known])
    # One row for each length, at most ``capacity`` rows.
    dealt = pieces.join(F.broadcast(counts), "length").withColumn(
        "bucket", F.pmod(spread, F.col("buckets")).cast("int")
    ).drop("buckets")
    inside = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = inside.select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from")
    )
    order = Window.partitionBy("length", "bucket").orderBy(*[c for c in known])
    ranked = (
        dealt.withColumn("place", F.row_number().over(order) - 1)
        .join(starts, ["length", "bucket"])
        .withColumn("place", F.col("place") + F.col("from"))
        .drop("bucket", "from")
    )

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def looked_up(length: pa.Array, place: pa.Array) -> pa.Array:
        s = slots.value
        size, rank = length.to_numpy(zero_copy_only=False), place.to_numpy(zero_copy_only=False)
        wide = np.int64(1) << 48
        row = np.searchsorted(s["length"] * wide + s["first"], size * wide + rank, side="right") - 1
        at = rank - s["first"][row]
        many = s["many"][row]
        return pa.StructArray.from_arrays(
            [
                pa.array(s["sequence"][row] + at // many, pa.int64()),
                pa.array(s["offset"][row] + at % many * size, pa.int64()),
            ],
            ["sequence_id", "offset"],
        )

    return ranked.withColumn("slot", looked_up("length", "place")).select(
        *pieces.columns, "slot.sequence_id", "slot.offset"
    )


def pack(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, keep_ids: bool = False
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their sequence and the offset in it.

    Rows that agree in all columns of a piece may swap places, which changes nothing.
    They are numbered when they are written, so any number of them is spread.
    """
    found = token_pieces(docs, capacity, vocabulary, keep_ids)
    pieces = materialize(found.withColumn("row", F.monotonically_increasing_id()), "pieces")
    return place(pieces, capacity).drop("row")
