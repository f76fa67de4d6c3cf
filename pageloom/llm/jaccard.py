"""Exact Jaccard join of word n-gram sets, size-aware.

Sets: ASCII letters are lower-cased, words are runs of characters other than ASCII white
space, and a document's set holds its distinct shingles of ``WORDS`` words; with fewer words
the whole sequence is one shingle, without any the set is empty. Two documents link when
100 * |A and B| >= ``PERCENT`` * |A or B|; empty sets link with nothing. Shingles are held
as 64-bit hashes, sets are named by 96-bit digests; sizes and intersections count hashes,
so two shingles of one comparison that share a hash (below one in 10**12 for sets of a
thousand) would count as one.

Documents with equal sets form a class and cost one row from then on. Classes link through
keys that any two linked classes share:

* Light classes, of at most ``boundary`` shingles, enumerate fixed-size subsets. Sizes s <= t
  that link need an overlap of o(s, t); a class of either size puts out its subsets of
  exactly that many shingles under the key (s, t, subset). Who shares one links.
* Heavy classes scan inverted lists. Shingles are ordered by how frequent they are in all
  documents, rarest first; two linked classes share one of the first n - ceil(p * n) + 1 of
  each. Only those lists are built and scanned, without lists of one class.

The boundary is where the rows to put out, plus ``VERIFY`` for every class whose candidates
have to be compared, cost least over the histogram of sizes. Light classes within reach of a
heavy one in size are in the lists too.

Frequencies: every task counts its shingles in packed arrays by ranges of hashes, which are
summed range by range. The most frequent ones, at most ``MAX_FREQUENT``, get a rank by their
logarithm; all others rank alike and are ordered by hash. The order only decides how short
the lists are. No pair depends on it.

Lists without all pairs: first every list's members are compared with one leader, the member
whose listed shingles are shared most, and linked classes are merged. As long as the pairs
that are left, of different merged classes within a list, are many for the lists' size and
merging makes them fewer, members are compared with other leaders. What is left then is compared pair
by pair. Whole sets are only compared where sizes, places in the lists and the number of
shared listed shingles allow a link. So a group of near copies costs its size, and a list
whose members are all merged costs nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.minhash import Hasher
from pageloom.llm.simhash import components
from pageloom.session import materialize

WORDS = 5
PERCENT = 80
# A comparison of two sets in rows put out, about.
VERIFY = 16
MAX_LIGHT = 24
# Shingles in at least so many documents are ranked by frequency, the most frequent first.
FREQUENT = 16
MAX_FREQUENT = 1 << 21
# Shingles counted in one task, about.
COUNT_ROWS = 1 << 21
# Keys worked through at once, about.
KEY_ROWS = 1 << 18
# Rows of one shingle that one task takes; lists beyond that are dealt out.
LIST_ROWS = 1 << 16
# Documents whose sets a task holds at once.
STEP_DOCS = 256
# Pairs left for each row of the lists, up to which all of them are looked at.
ROOM = 64
# Texts a task remembers to put equal ones out once.
REMEMBERED = 1 << 17
# Bits that mark texts to compare; more of them than bits only cost work.
MARKS = 1 << 25

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_NAME_BYTES = 12
# Within a range of hashes, shingles are counted by so many bits.
_COUNT_BITS = 32


# ---------------------------------------------------------------------- sets


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``WORDS`` in one row of word hashes; of fewer, of all."""
    n = max(1, len(words) - WORDS + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(words))):
        total = total * _BASE + words[j : j + n]
    total ^= total >> np.uint64(32)
    total *= _MIX
    total ^= total >> np.uint64(29)
    return total


def shingle_sets(texts: list[bytes], hasher: Hasher) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, begin = hasher.word_lists(texts)
    runs = _shingles(words) if len(words) else words
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        few = b - a < WORDS
        found = (_shingles(words[a:b]) if b > a else words[:0]) if few else runs[a : b - WORDS + 1]
        out.append(np.unique(found))
    return out


def _stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Short runs of rows with their texts as bytes. A null text is empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_DOCS):
            step = batch.slice(at, STEP_DOCS)
            yield step, [(t or "").encode() for t in step["text"].to_pylist()]


def _name(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())[:_NAME_BYTES]


def _text_hash(text: bytes) -> int:
    """A signed 64-bit hash of a text; it only saves work, nothing depends on it."""
    hashed = xxhash.xxh3_64_intdigest(text)
    return hashed - (1 << 64) if hashed >> 63 else hashed


class _Once:
    """Whether a value is new to the task, as far as it remembers."""

    def __init__(self):
        self.seen: set[int | bytes] = set()

    def __call__(self, value: int | bytes) -> bool:
        if value in self.seen:
            return False
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen.add(value)
        return True


def with_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, c, t): the size and the digest of each document's set, and a hash of its
    text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c", pa.binary()), ("t", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for step, texts in _stepped(batches):
            sets = shingle_sets(texts, hasher)
            sizes, names = pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_name, sets), pa.binary())
            hashes = pa.array(map(_text_hash, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([step["doc_id"], sizes, names, hashes], schema=schema)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, n long, c binary, t long")


# -------------------------------------------------------------- thresholds


def least_partner(n: int, percent: int = PERCENT) -> int:
    """The smallest size that a set of ``n`` can link with."""
    return -(-percent * n // 100)


def overlap(s: int, t: int, percent: int = PERCENT) -> int:
    """The smallest intersection with which sizes s and t link."""
    return -(-percent * (s + t) // (100 + percent))


def _partners(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(smaller, larger, overlap) of every pair of sizes that ``n`` can be part of."""
    sizes = range(max(1, least_partner(n, percent)), 100 * n // percent + 1)
    return [(min(n, t), max(n, t), overlap(n, t, percent)) for t in sizes if overlap(n, t, percent) <= min(n, t)]


@lru_cache
def _subset_rows(n: int, percent: int) -> int:
    return sum(comb(n, o) for _, _, o in _partners(n, percent))


def boundary(histogram: dict[int, int], percent: int = PERCENT) -> int:
    """The size up to which enumerating subsets costs less than scanning lists.
    ``histogram`` counts the classes of each size up to ``MAX_LIGHT`` and beyond."""

    def listed(n: int) -> int:
        return n - least_partner(n, percent) + 1

    def cost(limit: int) -> int:
        total = 0
        for n, classes in histogram.items():
            if n <= limit:
                total += classes * _subset_rows(n, percent)
            if n > limit:
                total += classes * VERIFY
            if n >= least_partner(limit + 1, percent):
                total += classes * listed(n)
        return total

    return min(range(MAX_LIGHT + 1), key=lambda limit: (cost(limit), limit))


# -------------------------------------------------------------- frequencies


def _frequent(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The sorted upper bits of frequent shingles, their counts, and the number of bits."""
    level = max(0, (total // COUNT_ROWS).bit_length())  # 2 ** level ranges
    ranges, bits = 1 << level, level + _COUNT_BITS
    shift = np.uint64(64 - bits)
    schema = pa.schema([("range", pa.int32()), ("packed", pa.binary()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            begins = np.arange(1, ranges, dtype=np.uint64) << np.uint64(_COUNT_BITS)
            cuts = np.searchsorted(values, begins)
            rows = [
                (r, v, c)
                for r, (v, c) in enumerate(zip(np.split(values, cuts), np.split(counts, cuts)))
                if len(v)
            ]
            packed = [v.astype("<u4").tobytes() for _, v, _ in rows]  # repeats are listed aside
            repeats = [
                np.stack([np.flatnonzero(c > 1), c[c > 1]]).astype("<i8").tobytes() for _, _, c in rows
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _, _ in rows], pa.int32()), pa.array(packed, pa.binary()), pa.array(repeats, pa.binary())],
                schema=schema,
            )

        for _, texts in _stepped(batches):
            sets = shingle_sets(texts, hasher)
            held += [found >> shift for found in sets]
            size += sum(map(len, sets))
            if size >= COUNT_ROWS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def add(table: pa.Table) -> pa.Table:
        values, counts = [], []
        for packed, repeats in zip(table["packed"].to_pylist(), table["counts"].to_pylist()):
            values.append(np.frombuffer(packed, "<u4"))
            one = np.ones(len(values[-1]), np.int64)
            places = np.frombuffer(repeats, "<i8").reshape(2, -1)
            one[places[0]] = places[1]
            counts.append(one)
        every, place = np.unique(np.concatenate(values), return_inverse=True)
        summed = np.bincount(place, np.concatenate(counts)).astype(np.int64)
        often = summed >= FREQUENT
        above = table["range"][0].as_py() << _COUNT_BITS
        return pa.table({"v": every[often].astype(np.int64) + above, "n": summed[often]})

    packed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        count, "range int, packed binary, counts binary"
    )
    summed = materialize(packed.groupBy("range").applyInArrow(add, "v long, n long"), "frequent")
    # The least count with at most MAX_FREQUENT shingles at or above it, by eighths of a
    # power of two; at most so many rows of two numbers come to the driver.
    step = F.floor(8 * F.log2(F.col("n").cast("double")))
    least, held = None, 0
    for row in summed.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += row["count"]
        if held > MAX_FREQUENT:
            break
        least = row["step"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64), bits
    found = summed.filter(step >= least).toArrow()
    values, counts = found["v"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(values)
    return values[order].astype(np.uint64), counts[order], bits


class _Order:
    """How frequent shingles are, as far as they are frequent at all."""

    def __init__(self, values: np.ndarray, counts: np.ndarray, bits: int):
        self.values, self.counts, self.bits = values, counts, bits
        self.marked = np.zeros(1 << 24, bool)
        self.marked[(values >> np.uint64(bits - 24)).astype(np.int64)] = True

    def frequency(self, found: np.ndarray) -> np.ndarray:
        """How often each shingle occurs, 0 if it is not frequent."""
        out = np.zeros(len(found), np.int64)
        maybe = np.flatnonzero(self.marked[(found >> np.uint64(40)).astype(np.int64)])
        if len(maybe):
            short = found[maybe] >> np.uint64(64 - self.bits)
            at = np.minimum(np.searchsorted(self.values, short), len(self.values) - 1)
            hit = self.values[at] == short
            out[maybe[hit]] = self.counts[at[hit]]
        return out


# --------------------------------------------------------------------- keys

# A key of a class: a listed shingle, with its place in the order, or a subset, with the
# smaller of its two sizes (``_SPLIT`` stands for a part of a split list).
_RECORD = np.dtype([("key", "<u8"), ("c", "<u4", _NAME_BYTES // 4), ("n", "<u4"), ("pos", "<u4"), ("smaller", "u1")])
_SPLIT = 255


def _subsets(found: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    for s, t, o in _partners(len(found), percent):
        for chosen in combinations(found.tolist(), o):
            yield xxhash.xxh3_64_intdigest(np.array([s, t, *chosen], np.uint64).tobytes()), s


def _records(found: np.ndarray, limit: int, order: _Order, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of one set, and for each the part of its list, 0 unless that is very long."""
    n, name = len(found), _name(found)
    subsets = list(_subsets(found, percent)) if n <= limit else []
    first = found[:0]
    if n >= least_partner(limit + 1, percent):
        often = order.frequency(found)
        # Ranks are logarithms; equal ones keep the order of the hashes.
        first = np.argsort(np.frexp(often.astype(float))[1], kind="stable")
        first = first[: n - least_partner(n, percent) + 1]
    out = np.zeros(len(subsets) + len(first), _RECORD)
    part = np.zeros(len(out), np.int64)
    out["c"], out["n"] = np.frombuffer(name, "<u4"), n
    if subsets:
        out["key"][: len(subsets)], out["smaller"][: len(subsets)] = zip(*subsets)
    if len(first):
        out["key"][len(subsets) :] = found[first]
        out["pos"][len(subsets) :] = np.arange(len(first))
        parts = often[first] // LIST_ROWS
        part[len(subsets) :] = int.from_bytes(name[:4], "little") % (1 + parts)
        out["smaller"][len(subsets) :] = np.where(parts > 0, _SPLIT, 0)
    return out, part


def _shared_records(found: np.ndarray) -> np.ndarray:
    """Each record once, without those whose key one class alone has. Parts of a split list
    all stay."""
    found = found[np.argsort(found["key"], kind="stable")]
    several = np.zeros(len(found), bool)
    same = found["key"][1:] == found["key"][:-1]
    several[1:] |= same
    several[:-1] |= same
    found = found[several | (found["smaller"] == _SPLIT)]
    found = found[np.lexsort((*found["c"].T, found["key"]))]
    repeat = np.zeros(len(found), bool)
    repeat[1:] = (found["key"][1:] == found["key"][:-1]) & (found["c"][1:] == found["c"][:-1]).all(axis=1)
    found = found[~repeat]
    _, run_of, sizes = np.unique(found["key"], return_inverse=True, return_counts=True)
    return found[(sizes[run_of] > 1) | (found["smaller"] == _SPLIT)]


def _shared(docs: DataFrame, limit: int, order: _Order, total: int, percent: int) -> DataFrame:
    """(key, smaller, c, n, pos) of all keys that several classes have. ``smaller`` is 0 for
    listed shingles. ``total`` is about the number of keys of all documents."""
    ranges = max(1, -(-total // KEY_ROWS))
    shared = docs.sparkSession.sparkContext.broadcast((order.values, order.counts, order.bits))
    schema = pa.schema([("range", pa.int64()), ("records", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ranks, new = Hasher(), _Order(*shared.value), _Once()
        held, parts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            every, part = np.concatenate(held), np.concatenate(parts)
            to = ((every["key"] >> np.uint64(16)).astype(np.int64) + part) % ranges
            by = np.argsort(to, kind="stable")
            used, begin = np.unique(to[by], return_index=True)
            packed = [r.tobytes() for r in np.split(every[by], begin[1:])]
            return pa.RecordBatch.from_arrays([pa.array(used), pa.array(packed, pa.binary())], schema=schema)

        for _, texts in _stepped(batches):
            fresh = [t for t in texts if new(_text_hash(t))]
            for found in shingle_sets(fresh, hasher):
                if len(found):
                    records, part = _records(found, limit, ranks, percent)
                    held.append(records)
                    parts.append(part)
                    size += len(records)
            if size >= KEY_ROWS:
                yield flush()
                held, parts, size = [], [], 0
        if size:
            yield flush()

    def keep(table: pa.Table) -> pa.Table:
        found = _shared_records(np.frombuffer(b"".join(table["records"].to_pylist()), _RECORD))
        names = pa.Array.from_buffers(
            pa.binary(_NAME_BYTES), len(found), [None, pa.py_buffer(np.ascontiguousarray(found["c"]).tobytes())]
        )
        return pa.table({
            "key": found["key"].view(np.int64), "smaller": np.where(found["smaller"] == _SPLIT, 0, found["smaller"]).astype(np.int32),
            "c": names.cast(pa.binary()), "n": found["n"].astype(np.int64), "pos": found["pos"].astype(np.int32),
        })

    packed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "range long, records binary")
    return packed.groupBy("range").applyInArrow(keep, "key long, smaller int, c binary, n long, pos int")


# --------------------------------------------------------------- comparisons


def _marks(names: DataFrame) -> np.ndarray:
    """A bit for every text hash in ``names`` (t), packed. A bounded number of them comes to
    the driver."""
    bit = F.pmod("t", F.lit(MARKS)) + 1
    found = (
        names.select(F.bitmap_bucket_number(bit).alias("b"), F.bitmap_bit_position(bit).alias("p"))
        .groupBy("b")
        .agg(F.bitmap_construct_agg("p").alias("bits"))
        .collect()
    )
    out = np.zeros(MARKS // 8, np.uint8)
    for row in found:
        bits = np.frombuffer(row["bits"], np.uint8)
        at = (row["b"] - 1) * len(bits)
        out[at : at + len(bits)] = bits[: len(out) - at]
    return out


def _members(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(c, members): the sets of the classes in ``names`` (c, t), read from the texts again.
    Only texts that may be among them are cut into shingles."""
    bits = docs.sparkSession.sparkContext.broadcast(_marks(names))
    schema = pa.schema([("c", pa.binary()), ("members", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, new, marked = Hasher(), _Once(), bits.value

        def wanted(text: bytes) -> bool:
            hashed = _text_hash(text)
            at = hashed % MARKS
            return bool(marked[at >> 3] >> (at & 7) & 1) and new(hashed)

        for _, texts in _stepped(batches):
            found = shingle_sets([t for t in texts if wanted(t)], hasher)
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(_name, found), pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))],
                schema=schema,
            )

    read = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "c binary, members array<long>")
    once = read.groupBy("c").agg(F.first("members").alias("members"))
    return materialize(once.join(names, "c", "left_semi"), "members")


def _fit(a: Column, b: Column, percent: int) -> Column:
    """Whether two sizes can link."""
    return percent * F.greatest(a, b) <= 100 * F.least(a, b)


def _overlap(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(percent * (a + b) / (100 + percent))


def _listed(n: Column, percent: int) -> Column:
    """How many of a set's shingles are listed."""
    return n - F.ceil(percent * n / 100) + 1


def _to_leaders(shared: DataFrame, rank: Column, percent: int) -> DataFrame:
    """(a, b, na, nb), a < b: the members of each list and of each subset beside a leader,
    that with the highest ``rank``, unless both have the same ``root``."""
    leaders = materialize(
        shared.withColumn("rank", rank)
        .groupBy("key", "smaller")
        .agg(F.max(F.struct("rank", "c", "n", "pos", "root")).alias("of"))
        .select("key", "smaller", *[F.col(f"of.{c}").alias(f"l{c}") for c in ("c", "n", "pos", "root")]),
        "leaders",
    )
    n, ln, pos, lpos = (F.col(c) for c in ("n", "ln", "pos", "lpos"))
    # Before and behind a shared place two sets can share no more than the shorter part.
    most = F.least(pos, lpos) + F.least(n - pos, ln - lpos)
    placed = (F.col("smaller") > 0) | (most >= _overlap(n, ln, percent))
    small = (F.col("smaller") == 0) | (ln == F.col("smaller"))
    beside = shared.join(leaders, ["key", "smaller"]).filter(
        (F.col("root") != F.col("lroot")) & _fit(n, ln, percent) & placed & small
    )
    flip = F.col("lc") < F.col("c")
    return beside.select(
        F.when(flip, F.col("lc")).otherwise(F.col("c")).alias("a"),
        F.when(flip, F.col("c")).otherwise(F.col("lc")).alias("b"),
        F.when(flip, ln).otherwise(n).alias("na"),
        F.when(flip, n).otherwise(ln).alias("nb"),
    ).distinct()


def _unmerged(shared: DataFrame, merged: DataFrame) -> DataFrame:
    """The lists whose members are not all merged, with the ``root`` of each member."""
    lists = shared.filter("smaller = 0").drop("root").join(merged, F.col("c") == F.col("v"), "left")
    rooted = lists.drop("v").withColumn("root", F.coalesce("root", "c"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    return materialize(rooted.join(mixed.select("key"), "key", "left_semi"), "unmerged")


def _left(lists: DataFrame) -> tuple[int, float]:
    """The rows of the lists, and their pairs of different roots."""
    each = lists.groupBy("key", "root").agg(F.count("*").cast("double").alias("m"))
    left = each.groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("s"))
    rows, pairs = left.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("s")) / 2)).first()
    return rows or 0, pairs or 0


def _across(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb), a < b, of one list and of different roots, that can link by their
    places."""
    left = lists.select("key", *[F.col(c).alias(f"{c}a") for c in ("c", "n", "pos", "root")])
    right = lists.select("key", *[F.col(c).alias(f"{c}b") for c in ("c", "n", "pos", "root")])
    na, nb = F.col("na"), F.col("nb")
    # The first shingle that two sets share has none before it.
    first = F.least(na - F.col("posa"), nb - F.col("posb")) >= _overlap(na, nb, percent)
    different = (F.col("ca") < F.col("cb")) & (F.col("roota") != F.col("rootb"))
    met = left.join(right, "key").filter(different & _fit(na, nb, percent) & first)
    return met.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "na", "nb").distinct()


def _promising(shared: DataFrame, pairs: DataFrame, limit: int, percent: int) -> DataFrame:
    """Those pairs that share enough listed shingles to link. Of two sets, the one whose
    listed shingles end first in the order has all that they share up to there listed in
    both. Pairs of light sets stay."""
    listed = materialize(
        shared.filter("smaller = 0").groupBy("c").agg(F.collect_list("key").alias("keys")), "listed"
    )
    na, nb = F.col("na"), F.col("nb")
    need = _overlap(na, nb, percent)
    least = F.least(_listed(na, percent) - na + need, _listed(nb, percent) - nb + need)
    both = pairs.join(listed.select(F.col("c").alias("a"), F.col("keys").alias("ka")), "a", "left").join(
        listed.select(F.col("c").alias("b"), F.col("keys").alias("kb")), "b", "left"
    )
    common = F.coalesce(F.size(F.array_intersect("ka", "kb")), F.lit(0))
    light = F.greatest(na, nb) <= limit
    return materialize(both.filter(light | (common >= least)).select("a", "b", "na", "nb"), "promising")


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of the pairs whose whole sets link."""

    @F.arrow_udf("long")
    def common(left: pa.Array, right: pa.Array) -> pa.Array:
        x, y = left.flatten().to_numpy().view(np.uint64), right.flatten().to_numpy().view(np.uint64)
        i, j = (np.cumsum([0, *a.value_lengths().to_pylist()]) for a in (left, right))
        out = []
        for k in range(len(left)):
            u, v = x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]
            if len(u) > len(v):
                u, v = v, u
            at = np.minimum(np.searchsorted(v, u), len(v) - 1)
            out.append(int((v[at] == u).sum()))
        return pa.array(out, pa.int64())

    names = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    members = _members(docs, materialize(names.join(classes.select("c", "t"), "c"), "names"))
    both = pairs.join(members.select(F.col("c").alias("b"), F.col("members").alias("mb")), "b").join(
        members.select(F.col("c").alias("a"), F.col("members").alias("ma")), "a"
    )
    found = both.select("a", "b", "na", "nb", common("ma", "mb").alias("common"))
    return materialize(
        found.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"),
        "linked",
    )


def cluster(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links lead to, the row's own included. Rows with
    a null doc_id take part and are smallest of none. A null text is empty; empty sets are
    alone. Rows that share a doc_id are rows of their own.
    """
    sets = materialize(with_sets(docs), "sets")
    classes = materialize(
        sets.filter("n > 0")
        .groupBy("c", "n")
        .agg(
            F.min("doc_id").alias("first"), F.min("t").alias("t"), F.count("*").alias("rows")
        ),
        "classes",
    )
    sizes = classes.groupBy(F.least(F.col("n"), F.lit(2 * MAX_LIGHT)).alias("n")).count().collect()
    limit = boundary({r["n"]: r["count"] for r in sizes}, percent)
    total = classes.agg(F.sum(F.col("n") * F.col("rows"))).first()[0] or 0
    order = _Order(*_frequent(docs, total))
    listed = classes.agg(F.sum(_listed(F.col("n"), percent) * F.col("rows"))).first()[0] or 0
    shared = materialize(_shared(docs, limit, order, listed, percent), "shared")
    shared = shared.withColumn("root", F.col("c"))

    def compare(pairs: DataFrame) -> DataFrame:
        return _linked(docs, classes, _promising(shared, pairs, limit, percent), percent)

    # First the most central member of a list; of a subset, one of the smaller size, if any.
    use = shared.filter("smaller = 0").groupBy("c", "n").agg(F.count("*").alias("shared"))
    use = use.select("c", (F.col("shared") / _listed(F.col("n"), percent)).alias("use"))
    rank = F.when(F.col("smaller") == 0, F.col("use")).otherwise(-F.col("n").cast("double"))
    edges = compare(_to_leaders(shared.join(use, "c", "left"), rank, percent))
    turn, before = 0, float("inf")
    while True:
        merged = materialize(components(edges), "merged")
        lists = _unmerged(shared, merged)
        rows, pairs = _left(lists)
        if pairs <= ROOM * rows or pairs > 0.8 * before:
            break
        # Then any member, in each list another one.
        turn, before = turn + 1, pairs
        edges = edges.union(compare(_to_leaders(lists, F.xxhash64("key", "c", F.lit(turn)), percent)))
    rest = compare(_across(lists, percent))
    if not rest.isEmpty():
        merged = materialize(components(edges.union(rest)), "merged")
    grown = classes.join(merged, classes["c"] == merged["v"]).select("c", "root", "first")
    lowest = materialize(grown.groupBy("root").agg(F.min("first").alias("component")), "lowest")
    joined = grown.join(lowest, "root").select("c", "component")
    named = materialize(
        classes.join(joined, "c", "left").select("c", F.coalesce("component", "first").alias("component_id")), "named"
    )
    found = sets.join(named, "c", "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
