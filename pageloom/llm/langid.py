"""Language identification as inference of a mixture of languages.

Each language has a distribution over byte trigrams of lower-case text, hashed to
2**15 codes, smoothed, fitted on at most ``SAMPLE_ROWS`` labelled rows of bounded
length (``TRAIN_CHARS``). A document's trigrams are taken as drawn from a mixture of languages.
Expectation-maximisation finds the proportions for every language set that backward
elimination visits: all languages first, then without the one with the smallest
share, and so on. The set with the best log-likelihood less ``PENALTY`` times the
logarithm of the trigram count for each language is kept.

The prediction is the language with the largest proportion in that set, ties to the
first by name; the score is its proportion. A text that is null or has no letter is
``und`` with score 0. Equal texts get equal results. Without labelled rows every
text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import materialize

CODES = 1 << 15
SAMPLE_ROWS = 4000
TRAIN_CHARS = 8000
PENALTY = 2.0
ROUNDS = 30
# Trigrams are counted over pieces of this many bytes, so memory does not follow length.
PIECE = 1 << 22
LETTER = regex.compile(r"\p{L}")

UNKNOWN = "und"
RESULT = "lang_pred string, score double, languages array<struct<lang: string, share: double>>"


def codes(raw: np.ndarray) -> np.ndarray:
    """A code for each three neighbouring bytes."""
    wide = raw.astype(np.uint32)
    key = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))
    return (key * np.uint32(2654435761)) >> np.uint32(17)


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes that occur in the text, with one blank around it, and how often."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    if len(raw) <= 600:
        return np.unique(codes(raw), return_counts=True)
    total = np.zeros(CODES, np.int64)
    for at in range(0, len(raw) - 2, PIECE):
        total += np.bincount(codes(raw[at : at + PIECE + 2]), minlength=CODES)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    languages: list[str]
    chance: np.ndarray  # code x language

    def mixture(self, found: np.ndarray, times: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Languages and proportions of one document."""
        chance = self.chance[found]
        # The best single language is found without iterations. Where no other
        # explains any noticeable part, nothing else needs fitting.
        total = float(times.sum())
        cost = PENALTY * np.log(total + 1)
        active = list(range(len(self.languages)))
        share = np.full(len(active), 1 / len(active))
        best = None
        while True:
            p = chance[:, active]
            for _ in range(ROUNDS):
                mix = p @ share
                new = share * ((times / mix) @ p) / total
                done = np.abs(new - share).max() < 1e-3
                share = new
                if done:
                    break
            fit = float(times @ np.log(p @ share)) - cost * len(active)
            if best is None or fit >= best[0]:
                best = (fit, list(active), share.copy())
            if len(active) == 1:
                break
            # Languages below one part in a hundred go together, else the smallest.
            drop = share < 0.01
            if not drop.any():
                drop = np.arange(len(active)) == int(share.argmin())
            if drop.all():
                drop[share.argmax()] = False
            active = [a for a, d in zip(active, drop) if not d]
            share = share[~drop] / share[~drop].sum()
        return best[1], best[2]

    def judge(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, []
        active, share = self.mixture(*trigram_counts(text))
        order = sorted(zip(-np.round(share, 9), (self.languages[a] for a in active)))
        ranked = [(lang, float(min(1.0, -s))) for s, lang in order]
        return ranked[0][0], ranked[0][1], ranked


def train(rows: list[tuple[str, str]]) -> Model:
    """Model from (language, text) rows: add-half smoothing towards the pooled counts."""
    languages = sorted({lang for lang, _ in rows})
    at = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((CODES, max(len(languages), 1)))
    for lang, text in rows:
        found, times = trigram_counts(text)
        counts[found, at[lang]] += times
    pooled = counts.sum(axis=1) + 0.5
    counts += 200.0 * (pooled / pooled.sum())[:, None]
    return Model(languages, counts / counts.sum(axis=0))


def sample(known: DataFrame, sample_rows: int) -> DataFrame:
    """(lang, doc_id): for each language an even share of ``sample_rows`` different ids, those
    with the smallest hashes, and one at least. One pass over the ids counts the languages,
    one picks: most rows go by a bound on the hash that the counts give, so what is ranked
    is little more than the sample, however large a language is."""
    sizes = materialize(known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")), "languages")
    languages = max(1, sizes.count())
    each = max(1, sample_rows // languages)
    # Hashes are uniform over 64 bits. Ten deviations above the wanted share, and ten of the
    # count, which is off by about a twentieth.
    share = F.lit(1.5 * (each + 10 * each**0.5 + 10)) / F.col("ids")
    mark = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    near = known.join(sizes, "lang").filter((mark / F.lit(2.0**64) + 0.5) <= share)
    order = Window.partitionBy("lang").orderBy("mark", "doc_id")
    near = near.select("lang", "doc_id", mark.alias("mark")).distinct()
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= each).select("lang", "doc_id")


def fit(docs: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on rows of ``docs`` (doc_id, text, lang) that satisfy ``usable`` and have a
    language: an even share of ``sample_rows`` for each language, one row at least, of each
    text at most ``TRAIN_CHARS`` characters from its middle. Of rows that share id and
    language the one with the smallest hash of its text counts."""
    known = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = materialize(sample(known.select("lang", "doc_id"), sample_rows), "sample")
    middle = F.greatest(F.lit(1), ((F.length("text") - TRAIN_CHARS) / 2).cast("int") + 1)
    part = F.substring("text", middle, F.lit(TRAIN_CHARS))
    rows = (
        known.select("doc_id", "lang", F.struct(F.xxhash64("text").alias("hash"), part.alias("t")).alias("of"))
        # Ids and languages of the sample.
        .join(F.broadcast(picked), ["doc_id", "lang"])
        .groupBy("doc_id", "lang")
        .agg(F.min("of")["t"].alias("t"))
        .collect()
    )
    return train(sorted((r["lang"], r["t"]) for r in rows))


def identify(model: Model, text: Column) -> Column:
    """Struct of predicted language, its share and all languages found."""

    @F.pandas_udf(RESULT)
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = [model.judge(t) for t in batch]
            yield pd.DataFrame(
                {
                    "lang_pred": [r[0] for r in rows],
                    "score": [r[1] for r in rows],
                    "languages": [[{"lang": a, "share": s} for a, s in r[2]] for r in rows],
                }
            )

    return judged(text)
