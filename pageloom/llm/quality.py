"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into chunks of 32 bytes that overlap by half and cover
all of it. Filters see each chunk as learned byte vectors, position by position,
and as the number of bytes that equal the byte 1 to 32 places before them, by which
repetition can be learned. Each filter is max-pooled over the chunks; a logistic
unit turns the pooled values into one probability.

The network is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, and
``TRAIN_BYTES`` from spread places of each); scoring reads whole texts. A null or
empty text is one chunk of padding and gets the score the network gives that. Equal
texts get equal scores. Without labelled rows every score is 0.5; with one class
only, every score is that class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import hashed_sample

HALF = 16
LAGS = 32
DIM = 6
FILTERS = 24
SAMPLE_ROWS = 2400
TRAIN_BYTES = 4096
EPOCHS = 16
# Bytes worked on at once: keeps the arrays of one step small, however long the text.
STEP_BYTES = 1 << 20


@dataclass
class Network:
    """Weights; ``constant`` is set instead if there was nothing to tell apart."""

    embed: np.ndarray | None = None
    left: np.ndarray | None = None
    right: np.ndarray | None = None
    lags: np.ndarray | None = None
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: float = 0.0
    constant: float | None = None


def lag_blocks(data: np.ndarray, start: int) -> np.ndarray:
    """For each block of 16 bytes from ``start`` on: how many bytes equal the byte
    ``d`` places before, for d = 1 to 32. ``start`` is at least 32."""
    n = len(data) - start
    counts = np.empty((n // HALF, LAGS), np.float32)
    here = data[start:]
    for d in range(1, LAGS + 1):
        same = (here == data[start - d : len(data) - d]).view(np.uint8)
        # Eight 0/1 bytes are summed by one multiplication.
        eights = (same.view(np.uint64) * np.uint64(0x0101010101010101)) >> np.uint64(56)
        counts[:, d - 1] = eights[0::2] + eights[1::2]
    return counts / HALF


def padded(text: bytes | memoryview | np.ndarray) -> np.ndarray:
    """32 zero bytes before the text, and after it up to two whole blocks at least.

    Padding positions hold falling values so that they match nothing around them.
    """
    raw = np.frombuffer(text, np.uint8) if not isinstance(text, np.ndarray) else text
    blocks = max(2, -(-len(raw) // HALF))
    data = np.zeros(LAGS + blocks * HALF, np.uint8)
    data[:LAGS] = 255 - np.arange(LAGS)  # bytes that UTF-8 does not hold, mostly
    data[LAGS : LAGS + len(raw)] = raw
    rest = len(data) - LAGS - len(raw)
    data[LAGS + len(raw) :] = 1 + np.arange(rest) % 8  # control characters
    return data


def pooled(net: Network, data: np.ndarray) -> np.ndarray:
    """Each filter's largest response over all chunks of one padded text."""
    best = np.zeros(FILTERS, np.float32)
    blocks = (len(data) - LAGS) // HALF
    step = STEP_BYTES // HALF
    # Steps share one block, so no chunk is lost between them.
    for first in range(0, blocks - 1, step):
        last = min(blocks, first + step + 1)
        part = data[first * HALF : LAGS + last * HALF]
        x = net.embed[part[LAGS:]].reshape(last - first, HALF * DIM)
        g = lag_blocks(part, LAGS) @ net.lags
        z = x[:-1] @ net.left + x[1:] @ net.right + g[:-1] + g[1:]
        np.maximum(best, z.max(axis=0) + net.bias, out=best)
    return best


def probability(net: Network, values: np.ndarray) -> np.ndarray:
    z = values @ net.out + net.out_bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """Fit by Adam on cross-entropy; the gradient flows through each filter's best chunk."""
    labels = np.asarray(labels, np.float32)
    if len(labels) == 0:
        return Network(constant=0.5)
    if labels.min() == labels.max():
        return Network(constant=float(labels[0]))
    rng = np.random.default_rng(seed)
    chunk = 2 * HALF * DIM
    p = {
        "embed": rng.normal(0, 0.5, (256, DIM)),
        "w": rng.normal(0, 1 / np.sqrt(chunk), (chunk, FILTERS)),
        "lags": rng.normal(0, 0.3, (LAGS, FILTERS)),
        "bias": np.zeros(FILTERS),
        "out": rng.normal(0, 0.5, FILTERS),
        "out_bias": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    data = [padded(t) for t in texts]
    lags = [lag_blocks(d, LAGS) for d in data]
    lags = [g[:-1] + g[1:] for g in lags]
    # Both classes weigh the same while filters form; the prior is put back at the end.
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(data))
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        for at in range(0, len(order), 50):
            batch = order[at : at + 50]
            codes = [data[i][LAGS:].reshape(-1, HALF) for i in batch]
            sizes = np.array([len(c) - 1 for c in codes])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            pairs = np.concatenate([np.hstack([c[:-1], c[1:]]) for c in codes])
            near = np.concatenate([lags[i] for i in batch])
            x = p["embed"][pairs].reshape(len(pairs), chunk)
            z = x @ p["w"] + near @ p["lags"]
            top = np.maximum.reduceat(z, starts, axis=0)
            # The row of each maximum, found without a sort.
            which = np.stack([z[s : s + n].argmax(axis=0) + s for s, n in zip(starts, sizes)])
            act = np.maximum(top + p["bias"], 0)
            score = 1 / (1 + np.exp(-np.clip(act @ p["out"] + p["out_bias"], -40, 40)))
            err = (score - labels[batch]) * weight[batch] / len(batch)
            d_act = np.outer(err, p["out"]) * (act > 0)
            rows = which.ravel()
            flat = d_act.ravel()
            fil = np.tile(np.arange(FILTERS), len(batch))
            grad = {k: np.zeros_like(a) for k, a in p.items()}
            grad["out"] = act.T @ err
            grad["out_bias"] = np.array([err.sum()])
            grad["bias"] = d_act.sum(axis=0)
            np.add.at(grad["w"].T, fil, x[rows] * flat[:, None])
            np.add.at(grad["lags"].T, fil, near[rows] * flat[:, None])
            back = (p["w"].T[fil] * flat[:, None]).reshape(-1, DIM)
            np.add.at(grad["embed"], pairs[rows].ravel(), back)
            t += 1
            for k in p:
                g = grad[k] + 1e-4 * p[k] * (k != "bias")
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                fix = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                p[k] = (p[k] - fix * m[k] / (np.sqrt(v2[k]) + 1e-7)).astype(np.float32)
    return Network(
        embed=p["embed"],
        left=np.ascontiguousarray(p["w"][: HALF * DIM]),
        right=np.ascontiguousarray(p["w"][HALF * DIM :]),
        lags=p["lags"],
        bias=p["bias"],
        out=p["out"],
        out_bias=float(p["out_bias"][0] + np.log(share / (1 - share))),
    )


def spread_bytes(text: Column, size: int) -> Column:
    """At most ``size`` bytes of a text: all, or four pieces from evenly spread places."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    piece = size // 4
    parts = [
        F.substring(raw, (F.lit(i) * (n - piece) / 3).cast("int") + 1, F.lit(piece))
        for i in range(4)
    ]
    return F.when(n <= size, raw).otherwise(F.concat(*parts))


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS
) -> Network:
    """Train on at most ``sample_rows`` rows of ``labels`` (doc_id, quality) that
    satisfy ``usable``, a condition on doc_id. Rows with a null label do not count. Of
    documents that share their id the one with the smallest hash of its text counts."""
    known = labels.filter(usable & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    chosen = hashed_sample(known.distinct(), "doc_id", sample_rows)
    rows = (
        docs.select(
            "doc_id",
            F.struct(F.xxhash64("text").alias("hash"), spread_bytes(F.col("text"), TRAIN_BYTES).alias("raw")).alias("of"),
        )
        # At most sample_rows ids and labels.
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min("of")["raw"].alias("raw"))
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    return train([bytes(r["raw"]) for r in rows], np.array([r["quality"] for r in rows]))


def score(net: Network, text: Column) -> Column:
    """Probability of quality 1 for each text, computed in Arrow batches."""
    shared = net

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            if shared.constant is not None:
                yield pa.array(np.full(len(texts), shared.constant))
                continue
            texts = texts.cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[
                texts.offset : texts.offset + len(texts) + 1
            ]
            whole = texts.buffers()[2]
            raw = np.frombuffer(whole, np.uint8) if whole else np.empty(0, np.uint8)
            values = np.empty((len(texts), FILTERS), np.float32)
            for i in range(len(texts)):
                values[i] = pooled(shared, padded(raw[offsets[i] : offsets[i + 1]]))
            yield pa.array(probability(shared, values).astype(np.float64))

    return scored(F.coalesce(text, F.lit("")))
