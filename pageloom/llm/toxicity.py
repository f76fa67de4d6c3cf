"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and word beginnings of 4 to 6 letters (inflected forms of one stem
share those), lower-case. The vocabulary holds the terms whose labelled counts lean
to one side by more than chance explains among so many terms, and by a factor of
``ODDS``; other words would only add noise to the cosine. Inverse document
frequencies are counted over all documents. The labelled examples, at most
``SAMPLE_ROWS``, form a block-max inverted index: examples lie in blocks, each term
keeps its largest weight per block, and blocks are scored in falling order of the
bound that gives, until the bound is below the k-th best cosine. The result is the
exact k nearest.

Votes weigh by distance. The vote is turned into a probability by a logistic curve
fitted on the examples, each scored without itself. A text without any vocabulary
term (null and empty ones as well) gets the rate of such texts among the examples.
Equal texts get equal scores. Without labelled rows every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from pageloom.llm import minhash
from pageloom.llm.common import hashed_sample
from pageloom.session import materialize

SAMPLE_ROWS = 6000
MAX_TERMS = 4096
NEIGHBOURS = 15
BLOCK = 64
COPY = 0.8  # similarity of near copies
STEMS = (4, 5, 6)
ODDS = 4.0  # a term must change the odds by this factor at least
MEMO = 20_000  # vectors whose score a task remembers
WORD = re.compile(r"[^\W\d_]+")

VECTOR = "terms array<int>, counts array<int>"


def terms_of(word: str) -> set[str]:
    """The word, and its beginnings with a mark that it goes on."""
    return {word} | {word[:n] + "*" for n in STEMS if len(word) > n}


class Terms:
    """Finds vocabulary terms in texts by one automaton over their beginnings."""

    def __init__(self, vocabulary: list[str]):
        self.ids = {t: i for i, t in enumerate(vocabulary)}
        self.heads = ahocorasick.Automaton()
        for head in {t.rstrip("*")[:4] for t in vocabulary}:
            self.heads.add_word(head, len(head))
        if self.ids:
            self.heads.make_automaton()

    def counts(self, text: str | None) -> Counter:
        found: Counter = Counter()
        if not text or not self.ids:
            return found
        text = text.lower()
        starts = {end - size + 1 for end, size in self.heads.iter(text)}
        for start in starts:
            if start == 0 or not text[start - 1].isalpha():
                word = WORD.match(text, start)
                for t in terms_of(word[0]) if word else ():
                    if t in self.ids:
                        found[self.ids[t]] += 1
        return found


def weights(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted term ids and their TF-IDF weights, scaled to length 1."""
    ids = np.array(sorted(counts), np.int64)
    w = np.array([1 + np.log(counts[i]) for i in ids]) * idf[ids]
    return ids, w / (np.sqrt((w * w).sum()) or 1.0)


def runs_of(text: str | None) -> np.ndarray:
    """The different hashes of the three-word runs, ascending."""
    words = (text or "").lower().split()
    runs = {" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2))}
    return np.unique(np.array([xxhash.xxh32_intdigest(r) for r in runs], "<u4"))


def copy_keys(runs: np.ndarray) -> list[bytes]:
    """Bands of the runs' MinHash signature: near copies share one, but for a chance below
    one in a thousand at ``COPY``; others may."""
    best = np.array([(runs * a + b).min() for a, b in zip(minhash._A, minhash._B)], "<u8")
    return [band.tobytes() for band in best.reshape(minhash.BANDS, -1)]


def without_copies(rows: list[tuple[int, int, list[bytes], np.ndarray]]) -> list[int]:
    """Ids of rows (id, label, keys, runs) in ascending order, leaving out those whose
    runs have a Jaccard similarity of ``COPY`` with those of an earlier one of the same
    label."""
    seen: dict[tuple, list[np.ndarray]] = {}
    kept = []
    for doc_id, label, keys, runs in sorted(rows, key=lambda r: r[:3]):
        places = [(label, i, k) for i, k in enumerate(keys)]
        near = {id(r): r for p in places for r in seen.get(p, [])}
        if not any(_alike(runs, r) for r in near.values()):
            kept.append(doc_id)
            for p in places:
                seen.setdefault(p, []).append(runs)
    return sorted(set(kept))


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= COPY * (len(a) + len(b) - both)


class BlockMaxIndex:
    """Inverted lists cut at block borders, with each list's largest weight per block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        n = len(vectors)
        self.size = n
        self.blocks = -(-n // BLOCK)
        lens = [len(ids) for ids, _ in vectors]
        term = np.concatenate([ids for ids, _ in vectors]) if n else np.empty(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if n else np.empty(0)
        doc = np.repeat(np.arange(n), lens)
        order = np.lexsort((doc, term))
        self.doc, self.weight, term = doc[order], weight[order], term[order]
        cell = term * max(self.blocks, 1) + self.doc // BLOCK
        self.bounds = np.searchsorted(cell, np.arange(n_terms * max(self.blocks, 1) + 1))
        self.top = np.zeros(n_terms * max(self.blocks, 1))
        np.maximum.at(self.top, cell, self.weight)
        self.top = self.top.reshape(n_terms, max(self.blocks, 1))

    def nearest(
        self, ids: np.ndarray, w: np.ndarray, k: int, skip: int = -1
    ) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest positive cosine, ties to smaller numbers."""
        bound = w @ self.top[ids]
        best_doc, best_cos = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best_cos) == k and bound[b] < best_cos[-1] - 1e-12):
                break
            score = np.zeros(BLOCK)
            for t, x in zip(ids, w):
                lo, hi = self.bounds[t * self.blocks + b], self.bounds[t * self.blocks + b + 1]
                score[self.doc[lo:hi] - b * BLOCK] += x * self.weight[lo:hi]
            hit = np.flatnonzero(score > 0)
            doc = np.concatenate([best_doc, hit + b * BLOCK])
            cos = np.concatenate([best_cos, score[hit]])
            keep = doc != skip
            doc, cos = doc[keep], cos[keep]
            order = np.lexsort((doc, -np.round(cos, 12)))[:k]
            best_doc, best_cos = doc[order], cos[order]
        return best_doc, best_cos


@dataclass
class Model:
    vocabulary: list[str]
    idf: np.ndarray
    index: BlockMaxIndex
    toxic: np.ndarray  # labels of the indexed examples
    ids: np.ndarray  # their doc_ids, for evidence
    base: float  # toxic share of examples without any term
    prior: float  # toxic share of examples with terms
    slope: float = 1.0
    shift: float = 0.0

    def vote(self, ids: np.ndarray, w: np.ndarray, skip: int = -1):
        doc, cos = self.index.nearest(ids, w, NEIGHBOURS, skip)
        if not len(doc):
            return self.prior, doc, cos
        power = 1 / (1.05 - np.minimum(cos, 1.0))
        share = (power @ self.toxic[doc] + self.prior) / (power.sum() + 1)
        return float(share), doc, cos

    def calibrated(self, share: float) -> float:
        x = np.log((share + 0.01) / (1.01 - share))
        return float(1 / (1 + np.exp(-(self.slope * x + self.shift))))


def choose_terms(
    counts: list[tuple[str, int, int]], n0: int, n1: int, tested: int
) -> list[str]:
    """Terms (term, n in other texts, n in toxic texts) whose odds differ by a factor
    of ``ODDS`` and by more than the largest chance deviation among ``tested`` terms;
    of more than ``MAX_TERMS`` those that lean most."""
    ranked = []
    limit = np.log(max(tested, 2))
    for term, c0, c1 in counts:
        a, b = c1 + 0.5, c0 + 0.5
        ratio = np.log(a / (n1 - c1 + 0.5)) - np.log(b / (n0 - c0 + 0.5))
        evidence = ratio * ratio / (1 / a + 1 / b) / 2
        if c0 == 0:  # the normal approximation fails here: chance that all are toxic
            evidence = max(evidence, c1 * np.log((n0 + n1) / n1))
        if abs(ratio) >= np.log(ODDS) and evidence >= limit:
            ranked.append((-evidence, term))
    return [t for _, t in sorted(ranked)[:MAX_TERMS]]


def _sample_terms(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: in how many toxic and other texts each term occurs."""
    seen: dict[str, list[int]] = {}
    for part in pairs:
        for text, toxic in zip(part["text"], part["toxic"]):
            words = set(WORD.findall((text or "").lower()))
            for t in set().union(*(terms_of(w) for w in words)) if words else ():
                seen.setdefault(t, [0, 0])[int(toxic)] += 1
        if len(seen) > 200_000:
            yield _frame(seen)
            seen = {}
    if seen:  # an empty frame would have columns without a type
        yield _frame(seen)


def _frame(seen: dict[str, list[int]]) -> pd.DataFrame:
    return pd.DataFrame(
        {"term": list(seen), "c0": [v[0] for v in seen.values()], "c1": [v[1] for v in seen.values()]}
    )


@F.pandas_udf(ArrayType(BinaryType()))
def _keys(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: copy_keys(runs_of(t)))


@F.pandas_udf(BinaryType())
def _runs(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: runs_of(t).tobytes())


def _vectors(vocabulary: list[str]):
    @F.pandas_udf(VECTOR)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Terms(vocabulary)
        for batch in texts:
            rows = [sorted(finder.counts(t).items()) for t in batch]
            yield pd.DataFrame(
                {
                    "terms": [[i for i, _ in r] for r in rows],
                    "counts": [[n for _, n in r] for r in rows],
                }
            )

    return found


def build(
    examples: list[tuple[int, dict[int, int], int]], vocabulary: list[str], idf: np.ndarray
) -> Model:
    """Index and calibrate labelled examples (doc_id, term counts, toxic)."""
    none = [y for _, c, y in examples if not c]
    some = [(d, weights(c, idf), y) for d, c, y in examples if c]
    # Examples that share their heaviest term lie together, which tightens block bounds.
    some.sort(key=lambda e: (int(e[1][0][e[1][1].argmax()]), e[0]))
    toxic = np.array([y for _, _, y in some], float)
    model = Model(
        vocabulary,
        idf,
        BlockMaxIndex([v for _, v, _ in some], len(vocabulary)),
        toxic,
        np.array([d for d, _, _ in some], np.int64),
        (sum(none) + 0.0) / len(none) if none else 0.0,
        float(toxic.mean()) if len(some) else 0.0,
    )
    if len(some) and 0 < toxic.mean() < 1:
        shares = np.array([model.vote(*v, skip=i)[0] for i, (_, v, _) in enumerate(some)])
        x = np.log((shares + 0.01) / (1.01 - shares))
        a, b = 1.0, 0.0
        for _ in range(25):  # Newton steps with a weak pull to the plain vote
            p = 1 / (1 + np.exp(-(a * x + b)))
            r = p * (1 - p)
            g = np.array([(p - toxic) @ x + (a - 1), (p - toxic).sum() + b])
            h = np.array([[r @ (x * x) + 1, r @ x], [r @ x, r.sum() + 1]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
        if a > 0:
            model.slope, model.shift = float(a), float(b)
    return model


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS
) -> Model:
    """Model from at most ``sample_rows`` rows of ``labels`` (doc_id, toxic) that satisfy
    ``usable``, a condition on doc_id; document frequencies come from all of ``docs``. Of
    documents that share their id the one with the smallest hash of its text counts."""
    known = labels.filter(usable & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    chosen = F.broadcast(hashed_sample(known.distinct(), "doc_id", sample_rows))
    # Written down with one row for each id and label: the lists below are bounded by
    # sample_rows, and ``docs`` is not read again for them.
    sample = materialize(
        docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "toxic")
        .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text")),
        "labelled",
    )
    # One of each group of copies: else a rare word of a much-copied text would seem
    # to have been judged many times.
    keyed = sample.select("doc_id", "toxic", _keys(F.col("text")).alias("k"))
    keyed = [(r["doc_id"], r["toxic"], [bytes(k) for k in r["k"]]) for r in keyed.collect()]
    # Only rows that share a band with another need their sets.
    uses = Counter((y, i, k) for _, y, ks in keyed for i, k in enumerate(ks))
    shared = {d for d, y, ks in keyed if any(uses[y, i, k] > 1 for i, k in enumerate(ks))}
    kept = {d for d, _, _ in keyed} - shared
    if shared:
        ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(shared)], "doc_id long")
        sets = sample.join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", _runs(F.col("text")).alias("r"))
        found = [(r["doc_id"], r["toxic"], np.frombuffer(r["r"], "<u4")) for r in sets.collect()]
        kept |= set(without_copies([(d, y, copy_keys(r), r) for d, y, r in found]))
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(kept)], "doc_id long")
    sample = sample.join(F.broadcast(ids), "doc_id")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    vocabulary: list[str] = []
    if n0 and n1:
        counted = (
            sample.select("text", "toxic")
            .mapInPandas(_sample_terms, "term string, c0 long, c1 long")
            .groupBy("term")
            .agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
        )
        tested = counted.count()
        rate = (F.col("c1") / n1) / ((F.col("c0") + 0.5) / n0)
        leaning = (
            counted.filter((F.col("c0") + F.col("c1") >= 3) & ((rate >= 2) | (rate <= 0.5)))
            .orderBy(F.desc(F.abs(F.col("c1") / n1 - F.col("c0") / n0)), "term")
            .limit(20 * MAX_TERMS)
        )
        vocabulary = choose_terms([tuple(r) for r in leaning.collect()], n0, n1, tested)
    found = _vectors(vocabulary)
    total = docs.count()
    df = np.zeros(len(vocabulary))
    if vocabulary:
        rows = (
            docs.select(F.explode(found(F.col("text"))["terms"]).alias("term"))
            .groupBy("term")
            .count()
            .collect()
        )
        for r in rows:
            df[r["term"]] = r["count"]
    idf = np.log((1 + total) / (1 + df)) + 1
    rows = sample.select("doc_id", "toxic", found(F.col("text")).alias("v")).collect()
    examples = sorted(
        ((r["doc_id"], dict(zip(r["v"]["terms"], r["v"]["counts"])), int(r["toxic"])) for r in rows),
        key=lambda e: (e[0], e[2], sorted(e[1].items())),
    )
    return build(examples, vocabulary, idf)


def judged(model: Model, counts: dict[int, int]) -> tuple[float, list[dict]]:
    """Score and nearest examples of one text."""
    if not counts:
        return model.base, []
    share, doc, cos = model.vote(*weights(counts, model.idf))
    near = [
        {"doc_id": int(model.ids[d]), "cosine": float(c), "toxic": int(model.toxic[d])}
        for d, c in zip(doc, cos)
    ]
    return model.calibrated(share), near


SCORED = (
    "score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>, "
    "terms array<string>"
)


def score(model: Model, text: Column) -> Column:
    """Struct of the score, the nearest examples and the vocabulary terms found."""

    @F.pandas_udf(SCORED)
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Terms(model.vocabulary)
        memo: dict[tuple, tuple] = {}
        for batch in texts:
            score, evidence, terms = [], [], []
            for text in batch:
                counts = finder.counts(text)
                key = tuple(sorted(counts.items()))
                if key not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[key] = judged(model, counts)
                s, e = memo[key]
                score.append(s)
                evidence.append(e)
                terms.append([model.vocabulary[i] for i, _ in key])
            yield pd.DataFrame({"score": score, "evidence": evidence, "terms": terms})

    return scored(text)
