"""Document fingerprints by MinHash, vectorised over many texts at once.

Shingles are five words (runs of visible bytes, ASCII letters in lower case); a text
of fewer words is one shingle, an empty one has none. Words and shingles are hashed by
polynomials modulo 2**64 over whole arrays. ``PERMUTATIONS`` universal hash functions
a * x + b modulo 2**64 stand for random permutations; a fingerprint holds 16 bits of
the mixed smallest value under each. The likeness of two fingerprints is
the share of equal places, an estimate of the Jaccard similarity of their shingles.
Equal texts have equal fingerprints; empty texts are alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.simhash import components
from pageloom.session import materialize

PERMUTATIONS = 64
WORDS = 5
BANDS = 16
SIMILARITY = 0.8
GROUP = 256
BLOCK_BYTES = 1 << 23  # shingle hashes in one slot, about
STEP_BYTES = 1 << 20
STEP_SHINGLES = 1 << 15

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends, from a rule and always the same."""
    raw = b"".join(hashlib.sha256(b"permutation %d" % i).digest()[:16] for i in range(n))
    pairs = np.frombuffer(raw, "<u8").reshape(n, 2)
    return pairs[:, 0] | np.uint64(1), pairs[:, 1]


_A, _B = _functions(PERMUTATIONS)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    both = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


class Hasher:
    """Fingerprints of batches of texts; keeps tables for one step."""

    def __init__(self):
        self.power, self.inverse = _powers(STEP_BYTES + 1)
        self.space = np.empty(STEP_SHINGLES, np.uint64)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of each word of at most ``STEP_BYTES`` bytes."""
        blank = _BLANK[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        terms = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * self.power[: len(data)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return _mix((sums[ends] - sums[starts]) * self.inverse[starts]), starts

    def word_lists(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts in a row, and where each text's begin (and the end)."""
        hashes, counts = [], np.zeros(len(texts), np.int64)
        group: list[int] = []
        size = 0

        def flush() -> None:
            if group:
                joined = np.frombuffer(b" ".join(texts[i] for i in group), np.uint8)
                h, starts = self.words(joined)
                first = np.cumsum([0] + [len(texts[i]) + 1 for i in group])
                counts[group] = np.diff(np.searchsorted(starts, first))
                hashes.append(h)

        for i, text in enumerate(texts):
            if len(text) >= STEP_BYTES - 1:
                flush()
                group, size = [], 0
                counts[i] = sum(hashes.append(h) or len(h) for h in self.long_words(text))
                continue
            if size + len(text) + 1 > STEP_BYTES:
                flush()
                group, size = [], 0
            group.append(i)
            size += len(text) + 1
        flush()
        every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        return every, np.concatenate([[0], np.cumsum(counts)])

    def long_words(self, text: bytes) -> Iterator[np.ndarray]:
        """Words of a long text, in pieces cut behind white space. A word longer than a
        step is hashed by its pieces' digest."""
        at = 0
        while at < len(text):
            piece = text[at : at + STEP_BYTES - 1]
            if at + len(piece) < len(text):
                blanks = np.flatnonzero(_BLANK[np.frombuffer(piece, np.uint8)])
                if len(blanks):
                    piece = piece[: blanks[-1] + 1]
                else:
                    rest = np.frombuffer(text, np.uint8)[at:]
                    ends = np.flatnonzero(_BLANK[rest])
                    piece = text[at : at + (int(ends[0]) if len(ends) else len(rest))]
                    short = hashlib.sha256(piece.lower()).digest()
                    yield self.words(np.frombuffer(short.hex().encode(), np.uint8))[0]
                    at += len(piece)
                    continue
            yield self.words(np.frombuffer(piece, np.uint8))[0]
            at += len(piece)

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """Hashes (below 2**32) of the runs of five in one row of words."""
        n = max(1, len(words) - WORDS + 1)
        total = np.zeros(n, np.uint64)
        for j in range(min(WORDS, len(words))):
            total = total * _BASE + words[j : j + n]
        return _mix(total) >> np.uint64(32)

    def fingerprints(self, texts: list[bytes]) -> np.ndarray:
        """A row of 16-bit numbers for each text."""
        words, begin = self.word_lists(texts)
        best = np.full((len(texts), PERMUTATIONS), _EMPTY, np.uint64)
        counts = np.diff(begin)
        full = np.flatnonzero(counts >= WORDS)
        if len(full):
            # All runs of five at once; those that cross into the next text are left out.
            runs = self.shingles(words)
            starts, stops = begin[full], begin[full + 1] - WORDS + 1
            self.minima(runs, starts, stops, best, full)
        for i in np.flatnonzero((counts > 0) & (counts < WORDS)):
            x = self.shingles(words[begin[i] : begin[i + 1]])
            best[i] = x[0] * _A + _B
        # Minima are small numbers; mixing spreads what tells them apart over all bits.
        return (_mix(best) >> np.uint64(48)).astype("<u2")

    def minima(
        self, runs: np.ndarray, starts: np.ndarray, stops: np.ndarray, best: np.ndarray, rows: np.ndarray
    ) -> None:
        """Smallest value of every function over [start, stop) of each row, in steps."""
        at = 0
        while at < len(rows):
            lo = int(starts[at])
            last = int(np.searchsorted(stops, lo + STEP_SHINGLES, side="right"))
            if last <= at:  # one long text: step through it
                for a in range(lo, int(stops[at]), STEP_SHINGLES):
                    x = runs[a : min(a + STEP_SHINGLES, int(stops[at]))]
                    buffer = self.space[: len(x)]
                    for k in range(PERMUTATIONS):
                        np.multiply(x, _A[k], out=buffer)
                        np.add(buffer, _B[k], out=buffer)
                        best[rows[at], k] = min(best[rows[at], k], buffer.min())
                at += 1
                continue
            x = runs[lo : int(stops[last - 1])]
            buffer = self.space[: len(x)]
            # Even entries are texts, odd ones the runs between them.
            cuts = np.stack([starts[at:last], stops[at:last]], axis=1).ravel()[:-1] - lo
            for k in range(PERMUTATIONS):
                np.multiply(x, _A[k], out=buffer)
                np.add(buffer, _B[k], out=buffer)
                best[rows[at:last], k] = np.minimum.reduceat(buffer, cuts)[0::2]
            at = last


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row."""
    return (a == b).mean(axis=1)


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of ``text`` as binary. A null text counts as empty."""

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = Hasher()
        for texts in batches:
            prints = hasher.fingerprints([(t.as_py() or "").encode() for t in texts])
            yield pa.array([p.tobytes() for p in prints], pa.binary())

    return docs.withColumn(name, of(F.col("text")))


# ------------------------------------------------------------ next documents

PROBED = (
    "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, "
    "edited_fingerprint binary, near_edited double, near_next double"
)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _probe(hasher: Hasher, ids: list, texts: list[str], own: np.ndarray | None = None) -> dict:
    """Results for all rows but the last, which only serves as a next document."""
    changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:])]
    if own is None:
        own = hasher.fingerprints([t.encode() for t in texts])
    new = hasher.fingerprints(changed)
    return {
        "doc_id": ids[:-1],
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(c).digest() for c in changed],
        "fingerprint": [p.tobytes() for p in own[:-1]],
        "edited_fingerprint": [p.tobytes() for p in new],
        "near_edited": likeness(own[:-1], new),
        "near_next": likeness(own[:-1], own[1:]),
    }


def probe_next(docs: DataFrame) -> DataFrame:
    """Fingerprint every document (doc_id, text) and its edited text, made with the next
    document in ascending doc_id; the first follows the last.

    Rows with equal doc_id are ordered by text, null ids come first, a null text counts
    as empty. A single document is its own next one. Texts are shuffled once, by ranges
    of doc_id. Each task knows the next row of all but its last; the first and the last
    row of each task, and nothing else, are matched up afterwards.
    """
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    schema = PROBED + ", edge string, task int, text string"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        target = pa.schema(
            [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()),
             ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
             ("near_edited", pa.float64()), ("near_next", pa.float64()),
             ("edge", pa.string()), ("task", pa.int32()), ("text", pa.string())]
        )

        def edge(kind: str, doc_id: int | None, text: str) -> pa.RecordBatch:
            row = {"doc_id": doc_id, "edge": kind, "task": TaskContext.get().partitionId(), "text": text}
            return pa.RecordBatch.from_pylist([row], schema=target)

        ids, texts, held, first = [], [], 0, True
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                if first:
                    yield edge("first", doc_id, text)
                    first = False
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
                if held > 4 * STEP_BYTES and len(ids) > 1:
                    yield _rows(_probe(hasher, ids, texts), target)
                    ids, texts, held = ids[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            yield _rows(_probe(hasher, ids, texts), target)
        if ids:
            yield edge("last", ids[-1], texts[-1])

    walked = materialize(dealt.mapInArrow(walk, schema), "probed")
    inner = walked.filter("edge IS NULL").drop("edge", "task", "text")
    # Two rows for each task: the next task's first row follows a task's last one. The
    # window sees the number of a task and the kind of the row; texts are joined by them.
    edges = walked.filter("edge IS NOT NULL").select("edge", "doc_id", "task", "text")
    # Ranges of doc_id are numbered in ascending order; empty ones leave gaps.
    order = Window.orderBy("task")
    n = F.count("*").over(Window.partitionBy())
    tasks = edges.filter("edge = 'last'").select("task").withColumn("at", F.row_number().over(order) - 1)
    tasks = materialize(tasks.withColumn("next", (F.col("at") + 1) % n), "tasks")
    following = tasks.select(F.col("at").alias("next"), F.col("task").alias("next_task"))
    after = edges.filter("edge = 'first'").select(
        F.col("task").alias("next_task"), F.col("text").alias("following")
    )
    pairs = (
        edges.filter("edge = 'last'")
        .join(tasks.join(following, "next").select("task", "next_task"), "task")
        .join(after, "next_task")
        .select("doc_id", "text", "following")
    )

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            for doc_id, text, following in batch.itertuples(index=False):
                found = _probe(hasher, [None if pd.isna(doc_id) else int(doc_id), None], [text, following])
                frame = pd.DataFrame(found)
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    return inner.unionByName(pairs.mapInPandas(finish, PROBED))


def _rows(found: dict, target: pa.Schema) -> pa.RecordBatch:
    n = len(found["doc_id"])
    columns = [
        pa.array(found[f.name], f.type) if f.name in found else pa.nulls(n, f.type) for f in target
    ]
    return pa.RecordBatch.from_arrays(columns, schema=target)


# ------------------------------------------------------------ similar pairs


def _shared(a: Column, b: Column) -> Column:
    """Exact Jaccard similarity of the shingles of two texts."""

    @F.pandas_udf("double")
    def jaccard(left: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hasher = Hasher()

        def runs(text: str) -> np.ndarray:
            words, _ = hasher.word_lists([text.encode()])
            return np.unique(hasher.shingles(words)) if len(words) else words

        for x, y in left:
            found = []
            for s, t in zip(x, y):
                u, v = runs(s or ""), runs(t or "")
                both = len(np.intersect1d(u, v, assume_unique=True))
                found.append(both / (len(u) + len(v) - both) if len(u) + len(v) else 1.0)
            yield pd.Series(found)

    return jaccard(a, b)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's fingerprint, and the classes of equal ones with their smallest doc_id
    (and that row's text, by its hash, as rows may share a doc_id)."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    )
    marked = materialize(with_fingerprint(rows).drop("text"), "prints")
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    grouped = marked.groupBy("fingerprint").agg(first)
    return marked, materialize(
        grouped.select("fingerprint", F.col("first.doc_id").alias("id"), "first.text_hash"), "classes"
    )


def _agreeing(bands: int, least: int):
    """Pairs (a, b) of one block whose fingerprints agree in at least ``least`` places
    and in no band before the block's own, so that a pair comes out of one bucket only."""

    @F.pandas_udf("array<struct<a: long, b: long>>")
    def pairs(band: pd.Series, lo: pd.Series, hi: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for own, low, high, members in zip(band, lo, hi, rows):
            ids = np.array([m["id"] for m in members], np.int64)
            slot = np.array([m["slot"] for m in members], np.int64)
            prints = np.frombuffer(b"".join(m["fingerprint"] for m in members), "<u2")
            prints = prints.reshape(len(ids), PERMUTATIONS)
            left, right = np.flatnonzero(slot == low), np.flatnonzero(slot == high)
            found = []
            for i in left:
                others = right[right > i] if low == high else right
                near = others[(prints[others] == prints[i]).sum(axis=1) >= least]
                same = (prints[near] == prints[i]).reshape(len(near), bands, PERMUTATIONS // bands).all(axis=2)
                near = near[same.argmax(axis=1) == own]
                found += [
                    {"a": min(ids[i], ids[j]).item(), "b": max(ids[i], ids[j]).item()} for j in near
                ]
            out.append(found)
        return pd.Series(out)

    return pairs


def candidates(
    classes: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, group: int | None = None
) -> DataFrame:
    """(a, b) of ``classes`` (id, fingerprint) that share a band and whose fingerprints
    agree nearly as often as ``threshold`` asks, each pair once.

    A bucket is one band with its values. Its members are dealt to slots of about
    ``group``; each pair of slots is compared by itself, so buckets of any size are
    compared whole and none is gathered whole, and only agreeing pairs are put out.
    """
    group = group or GROUP
    # Four standard deviations below the expected number of equal places.
    spread = (PERMUTATIONS * threshold * (1 - threshold)) ** 0.5
    least = max(1, int(PERMUTATIONS * threshold - 4 * spread))
    width = 2 * PERMUTATIONS // bands
    slices = F.array(*[F.substring("fingerprint", 1 + i * width, width) for i in range(bands)])
    keyed = classes.select("id", "fingerprint", F.posexplode(slices).alias("band", "piece"))
    # Counting first spares the shuffle of buckets of one.
    sizes = materialize(keyed.groupBy("band", "piece").agg(F.count("*").alias("n")).filter("n > 1"), "bands")
    slots = F.ceil(F.col("n") / group).cast("int")
    dealt = (
        keyed.join(sizes, ["band", "piece"])
        .withColumn("slot", F.pmod(F.xxhash64("id"), slots).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), slots - 1)))
        .withColumns({"lo": F.least("slot", "other"), "hi": F.greatest("slot", "other")})
    )
    blocks = dealt.groupBy("band", "piece", "lo", "hi").agg(
        F.collect_list(F.struct("id", "slot", "fingerprint")).alias("rows")
    )
    return blocks.select(
        F.explode(_agreeing(bands, least)("band", "lo", "hi", "rows")).alias("p")
    ).select("p.a", "p.b")


def membership(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every row: the smallest doc_id with an equal fingerprint. Rows
    with a null doc_id can't be named and take no part."""
    marked, classes = _classes(docs)
    named = classes.select("fingerprint", F.col("id").alias("class_id"))
    return marked.join(named, "fingerprint").select("doc_id", "class_id")


def similar_pairs(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """(a, b, jaccard) of documents (doc_id, text) whose shingles' Jaccard similarity is
    at least ``threshold``, between classes of equal fingerprints, a < b, each class by
    its smallest doc_id; ``membership`` tells which rows a class holds. Rows with a null
    doc_id take no part; no rows give no pairs.

    Bands join classes, not documents, so copies make no pairs. A pair of similarity 0.8
    shares a band with probability above 0.999 (16 bands of 4) and is a candidate then
    with probability above 0.999. There is no bound on a bucket's size: see ``candidates``.
    """
    _, classes = _classes(docs)
    found = materialize(candidates(classes.select("id", "fingerprint"), threshold, bands), "candidates")
    # Only the texts of classes with a candidate are shuffled on.
    used = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = classes.join(used, "id").select(F.col("id").alias("doc_id"), "text_hash")
    texts = docs.select(
        F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    )
    texts = texts.join(wanted, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id"])
    whole = (
        found.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    )
    return whole.select("a", "b", _shared(F.col("text_a"), F.col("text_b")).alias("jaccard")).filter(
        F.col("jaccard") >= threshold
    )


# ------------------------------------------------------------ groups of near copies


def _least(threshold: float) -> int:
    """Equal places that a pair at ``threshold`` has but for one chance in a thousand."""
    spread = (PERMUTATIONS * threshold * (1 - threshold)) ** 0.5
    return max(1, int(PERMUTATIONS * threshold - 4 * spread))


def _joined(slot: np.ndarray, prints: np.ndarray, low: int, high: int, least: int, alike) -> list[tuple[int, int]]:
    """Links that join all members of a block whose fingerprints agree in ``least`` places
    and that are ``alike``, none twice; those of one slot, or across two slots."""
    todo = np.ones(len(slot), bool)
    found = []
    for first in range(len(slot)):
        if not todo[first]:
            continue
        todo[first] = False
        queue = [first]
        while queue and todo.any():
            at = queue.pop()
            rest = np.flatnonzero(todo if low == high else todo & (slot != slot[at]))
            near = rest[(prints[rest] == prints[at]).sum(axis=1) >= least]
            near = [n for n in near.tolist() if alike(at, n)]
            todo[near] = False
            queue.extend(near)
            found += [(at, n) for n in near]
    return found


def _block_links(least: int, threshold: float | None):
    """Links of each block; with a threshold only between sets of that similarity."""

    @F.pandas_udf("array<struct<a: string, b: string>>")
    def links(lo: pd.Series, hi: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for low, high, members in zip(lo, hi, rows):
            slot = np.array([m["slot"] for m in members], np.int64)
            prints = np.frombuffer(b"".join(m["fingerprint"] for m in members), "<u2")
            prints = prints.reshape(len(slot), PERMUTATIONS)
            if threshold is None:
                pairs = _joined(slot, prints, low, high, least, lambda i, j: True)
            else:
                runs = [np.frombuffer(m["runs"], "<u4") for m in members]

                def alike(i: int, j: int) -> bool:
                    u, v = runs[i], runs[j]
                    if min(len(u), len(v)) < threshold * max(len(u), len(v)):
                        return False
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    return both >= threshold * (len(u) + len(v) - both)

                pairs = _joined(slot, prints, low, high, least, alike)
            ids = [m["id"] for m in members]
            out.append([{"a": min(ids[i], ids[j]), "b": max(ids[i], ids[j])} for i, j in pairs])
        return pd.Series(out)

    return links


def _blocks(keyed: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Blocks (lo, hi, rows) of the groups ``keys``: members are dealt to ``slots`` slots,
    and each pair of slots is a block, so no group is gathered whole."""
    dealt = (
        keyed.withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        .withColumns({"lo": F.least("slot", "other"), "hi": F.greatest("slot", "other")})
    )
    return dealt.groupBy(*keys, "lo", "hi").agg(F.collect_list(F.struct("id", "slot", *carried)).alias("rows"))


def _runs(text: Column) -> Column:
    """The different shingle hashes of a text in ascending order, as binary."""

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = Hasher()
        for texts in batches:
            out = []
            for t in texts:
                words, _ = hasher.word_lists([(t.as_py() or "").encode()])
                runs = np.unique(hasher.shingles(words)) if len(words) else words
                out.append(runs.astype("<u4").tobytes())
            yield pa.array(out, pa.binary())

    return of(text)


def leaders(
    docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, group: int | None = None
) -> DataFrame:
    """The smallest doc_id of each group of ``docs`` (doc_id, text) that pairs of Jaccard
    similarity ``threshold`` or more join, directly or through others.

    Equal texts are one vertex. First, texts that share a band and agree nearly as often
    as ``threshold`` asks are joined by their fingerprints alone; only a spanning set of
    links leaves a block, so a group of n near copies makes about n links and not n * n.
    Then the texts of each group so found are compared by their shingles, and links
    verified that way join the final groups. Chances to miss a pair: see ``similar_pairs``.
    Rows with a null doc_id take part; a group of them alone gives a null.
    """
    group = group or GROUP
    least = _least(threshold)
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    marked = with_fingerprint(docs.select("doc_id", "text")).select("doc_id", digest.alias("id"), "fingerprint")
    classes = materialize(
        marked.groupBy("id").agg(F.min("doc_id").alias("first"), F.first("fingerprint").alias("fingerprint")),
        "classes",
    )
    width = 2 * PERMUTATIONS // bands
    slices = F.array(*[F.substring("fingerprint", 1 + i * width, width) for i in range(bands)])
    keyed = classes.select("id", "fingerprint", F.posexplode(slices).alias("band", "piece"))
    sizes = materialize(keyed.groupBy("band", "piece").agg(F.count("*").alias("n")).filter("n > 1"), "bands")
    shared = keyed.join(sizes, ["band", "piece"]).withColumn("slots", F.ceil(F.col("n") / group).cast("int"))
    blocks = _blocks(shared, ["band", "piece"], ["fingerprint"])
    loose = blocks.select(F.explode(_block_links(least, None)("lo", "hi", "rows")).alias("l")).select("l.a", "l.b")
    roots = materialize(components(loose), "roots")
    # Only texts with a possible near copy are read again, each once.
    texts = docs.select(digest.alias("id"), "text").join(roots.select(F.col("v").alias("id")), "id", "left_semi")
    held = materialize(
        texts.withColumn("runs", _runs(F.col("text"))).groupBy("id").agg(F.first("runs").alias("runs")), "runs"
    )
    named = held.join(roots.withColumnRenamed("v", "id"), "id")
    wide = named.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("runs")).alias("size"))
    wide = wide.select(
        "root", F.greatest(F.ceil(F.col("n") / group), F.ceil(F.col("size") / BLOCK_BYTES), F.lit(1)).cast("int").alias("slots")
    )
    full = materialize(named.join(classes.select("id", "fingerprint"), "id").join(wide, "root"), "sets")
    near = _blocks(full, ["root"], ["fingerprint", "runs"]).select(
        F.explode(_block_links(least, threshold)("lo", "hi", "rows")).alias("l")
    )
    final = components(near.select("l.a", "l.b")).withColumnRenamed("v", "id")
    grouped = classes.join(final, "id", "left").groupBy(F.coalesce("root", "id").alias("root"))
    return grouped.agg(F.min("first").alias("doc_id")).select("doc_id")
