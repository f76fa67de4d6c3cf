"""Hard negatives, Merkle manifests and the n-gram join against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import jaccard, merkle, negatives, queries
from pageloom.llm.common import table

# ----------------------------------------------------------- hard negatives


def plain_negatives(rows, is_anchor, positives=5, n=3, low=50, high=95):
    """rows: (vec_id, label, components); None marks what takes no part."""
    good = [
        (i, lab, [math.floor(256 * x) for x in v])
        for i, lab, v in rows
        if i is not None and lab is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    ]
    anchors = {}
    for i, lab, v in good:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in good if i != a)
        best = [(-s, i) for s, i, m in scored if m == lab][:positives]
        for top, p in best:
            fit = [(-s, i) for s, i, m in scored if m != lab and low * top <= -100 * s <= high * top][:n]
            out += [(a, p, r, i, top, s) for r, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def test_negatives_with_ties_repeats_and_gaps(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        # Few different values, so that scores tie and windows of score zero occur.
        rows.append((i, rng.randrange(4), [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]))
    rows += [rows[10], rows[10], (10, 3, [0.5, 0.5, 0.5, 0.5]), (20, 1, [0.0] * 4), (-40, 1, [1.0] * 4)]
    rows += [(500, 2, [0.0] * 4), (510, 2, [1.0, 1.0]), (520, 2, [])]
    rows += [(None, 1, [1.0] * 4), (530, None, [1.0] * 4), (540, 1, None), (550, 1, [1.0, None, 1.0, 1.0])]
    rows += [(560, 1, [math.nan, 1.0, 1.0, 1.0]), (570, 1, [math.inf, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    df = df.withColumn("key", F.lit("extra")).withColumn("score", F.lit(1))
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 300
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0).collect())) == want
    for name, value in (("BLOCK_ROWS", 40), ("LEAST_ROWS", 16), ("STEP_SCORES", 100)):
        monkeypatch.setattr(negatives, name, value)
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0).collect())) == want


def test_negatives_without_rows(spark):
    df = spark.createDataFrame([(1, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    for empty in (df.limit(0), df):
        found = negatives.mine(empty, F.col("vec_id") % 50 == 0)
        assert found.count() == 0 and found.columns[:2] == ["anchor_id", "positive_id"]
    alone = spark.createDataFrame([(50, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(alone, F.lit(True)).count() == 0


def test_packed_keys_sort_like_tuples():
    rng = random.Random(5)
    values = [0, 1, -1, 2**62, -(2**62), 77, -77]
    keys = [(rng.choice(values), rng.choice(values), rng.random() < 0.5, rng.choice(values)) for _ in range(300)]
    wanted = sorted(keys, key=lambda k: (k[0], -k[1], k[2], k[3]))
    assert [negatives.unpack(k) for k in sorted(negatives.pack(*k) for k in keys)] == wanted


# ------------------------------------------------------------------- Merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    out = ""
    for v in values:
        text = None if v is None else str(v)
        out += "-" if text is None else f"{len(text.encode())}:{text}"
    return h(out)


def plain_tree(nodes):
    """The top of the nodes, and each one's (left, right) level by level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, p in zip(paths, place):
            start = p - p % 3
            path.append(("".join(nodes[start:p]), "".join(nodes[p + 1 : start + 3])))
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        place = [p // 3 for p in place]
    return nodes[0], paths


def plain_manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0], plain_leaf(row)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, below = [], []
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        top, paths = plain_tree([leaf for _, leaf in groups[name]])
        tops.append(top)
        below.append(paths)
    root, above = plain_tree(tops)
    return [
        (i, leaf, tops[g], root, [tuple(run) for run in path + above[g]])
        for g, name in enumerate(names)
        for (i, leaf), path in zip(groups[name], below[g])
    ]


def manifest_rows(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "a\nb", "ümläut\n" * rng.randrange(4), "x" * rng.randrange(50)])
            rows.append((rng.randrange(5000), source, rng.choice([None, "en"]), rng.choice([None, 7]), text))
    return rows


@pytest.mark.parametrize("stride", [1, 2, 4])
def test_manifest(spark, monkeypatch, stride):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    sizes = {None: 5, "": 1, "a": 27, "b": 28, "hot": 700, "é": 3, "z": 2, **{f"s{i}": 1 + i % 4 for i in range(30)}}
    rows = manifest_rows(1, sizes)
    rows += [rows[200]] * 90 + [(None, "hot", None, None, "no id"), (None, "hot", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    df = df.withColumn("leaf", F.lit(1)).withColumn("grp", F.lit(2))
    got = merkle.manifest(df, twice=F.col("doc_id") * 2).collect()
    want = plain_manifest(rows)
    assert sorted(map(repr, ((r.doc_id, r.leaf, r.subroot, r.root, [tuple(x) for x in r.proof]) for r in got))) == sorted(map(repr, want))
    assert all(r.twice == (None if r.doc_id is None else 2 * r.doc_id) for r in got)


@pytest.mark.parametrize("rows", [[], manifest_rows(2, {"one": 1}), manifest_rows(3, {"one": 1, "two": 1}), manifest_rows(4, {"x": 82})])
def test_small_manifests(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    got = merkle.manifest(df).collect()
    want = plain_manifest(rows) if rows else []
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, [tuple(x) for x in r.proof]) for r in got) == sorted(want)


def test_tampering_is_found(spark, folder):
    docs = {d.doc_id: d for d in table(spark, folder, "documents").collect()}
    plain = {r[0]: r for r in plain_manifest([tuple(d[c] for c in merkle.FIELDS) for d in docs.values()])}
    got = queries.merkle_manifest(spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        _, leaf, subroot, root, path = plain[r.doc_id]
        assert (r.leaf, r.subroot, r.root) == (leaf, subroot, root)
        assert r.proof_sha256 == h(*[a + b for a, b in path])
        d = docs[r.doc_id]
        hit = zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        node = plain_leaf([d.doc_id, d.source, d.lang, d.n_chars, d.text.replace("\n", "") if hit and d.text else d.text])
        for a, b in path:
            node = h(a, node, b)
        assert r.folded_root == node and r.verified == (node == root)
    assert 0 < sum(not r.verified for r in got) < len(got)


def test_manifest_spreads_a_hot_group(spark):
    """A group with nearly all rows, half of them equal, is numbered in even slices."""
    rows = spark.range(4000).select(
        F.when(F.col("id") < 3900, "hot").otherwise("cold").alias("grp"),
        F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"),
    )
    found = merkle.numbered(rows, "grp", ["k"])
    assert found.filter("grp = 'hot'").agg(F.min("pos"), F.max("pos"), F.countDistinct("pos"), F.min("n"), F.max("n")).first()[:] == (0, 3899, 3900, 3900, 3900)
    dealt = rows.withColumn("s", F.monotonically_increasing_id()).repartitionByRange("grp", "k", "s")
    sizes = [n for n in dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert max(sizes) <= 1.5 * 4000 / len(sizes)


# -------------------------------------------------------------- n-gram join


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def plain_join(rows, percent=80):
    """Sorted (doc_id, size, smallest doc_id reached) of (doc_id, text) rows."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)].append(d)
    out = [(d, len(sets[i]), min(low[root(i)], default=None)) for i, (d, _) in enumerate(rows)]
    return sorted(out, key=repr)


def joined(df, **kwargs):
    return sorted((tuple(r) for r in jaccard.cluster(df, **kwargs).collect()), key=repr)


def edited_texts(rng, n, lengths, vocabulary):
    """Texts and edits of them at all similarities around the threshold."""
    rows = []
    for _ in range(n):
        words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice(lengths))]
        rows.append(words)
        for _ in range(rng.randrange(4)):
            other = list(words)
            for _ in range(rng.randrange(1 + max(1, len(words) // 15))):
                at = rng.randrange(len(other))
                other[at : at + rng.randrange(2)] = [f"v{rng.randrange(vocabulary)}"] * rng.randrange(3)
                other = other or ["w0"]
            rows.append(other)
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("limit", [None, 0, 12])
def test_join_of_small_and_large_sets(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda histogram, percent: limit)
    rng = random.Random(8)
    rows = edited_texts(rng, 60, range(1, 24), 30) + [(1000 + i, t) for i, t in edited_texts(rng, 40, (40, 150, 400), 5000)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(3000 + i, f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([10, 40, 200])))) for i in range(60)]
    rows += [(3, "Extra Row of its own, same ID"), (3, rows[0][1]), (None, rows[5][1]), (None, "nobody else has this text at all")]
    rows += [(4000, None), (4001, ""), (4002, " \t\n"), (4003, "ÄÖ"), (4004, "äö"), (4005, "A b"), (4006, "a\x0bB ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumn("c", F.lit("x")).withColumn("n", F.lit(1)).withColumn("key", F.lit(2)).repartition(5)
    want = plain_join(rows)
    assert len({r[2] for r in want}) < 0.8 * len(want)
    assert joined(df) == want


@pytest.mark.parametrize("room", [0, 4, 10**9])
def test_join_of_hot_groups(spark, monkeypatch, room):
    """Very many copies, near copies of one text, chains and texts of common passages, with
    lists that are split and batches that cut through them."""
    for name, value in (("LIST_ROWS", 32), ("KEY_ROWS", 300), ("STEP_DOCS", 5), ("COUNT_ROWS", 2000), ("REMEMBERED", 16), ("FREQUENT", 4), ("ROOM", room)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    texts = [" ".join(words)] * 150
    for _ in range(150):
        other = list(words)
        for at in rng.sample(range(160), rng.choice([1, 2, 3, 4, 6])):
            other[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(other))
    texts += [" ".join(words[k:] + [f"x{i}" for i in range(k)]) for k in range(0, 120, 7)]
    passages = [[f"p{k}-{i}" for i in range(30)] for k in range(6)]
    for _ in range(60):
        texts.append(" ".join(w for p in rng.sample(passages, 4) for w in p))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == plain_join(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_join_of_nothing_and_of_a_long_text(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert joined(df) == []
    assert joined(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")) == [(1, 0, 1), (2, 0, 2)]
    words = [f"w{i % 90001}" for i in range(260_000)]
    longer = words + ["end"] * 20_000
    rows = [(1, " ".join(words)), (2, " ".join(longer)), (3, "w" * 3_000_000), (4, "W" * 3_000_000), (5, "other")]
    want = plain_join(rows)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_subsets_of_all_linking_sizes_meet():
    """Whatever two small sets of linking overlap are, they share a subset under one key."""
    for s in range(1, 16):
        for t in range(s, 20):
            if 100 * s < 80 * t:
                continue
            need = next(k for k in range(s + 1) if 100 * k >= 80 * (s + t - k))
            assert jaccard.overlap(s, t) == need
            assert (s, t, need) in jaccard._partners(s, 80) and (s, t, need) in jaccard._partners(t, 80)
    assert jaccard.boundary({}) == 0
    assert 3 <= jaccard.boundary({n: 1000 for n in range(1, 48)}) <= 12


def test_shared_records():
    rng = random.Random(4)
    rows = []
    for key in range(300):
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            name = rng.randrange(3)
            rows += [(key, (name, 5, name % 2), 9, 0, key % 2)] * rng.choice([1, 1, 3])
    rows += [(999, (7, 7, 7), 9, 0, jaccard._SPLIT)] * 2  # part of a split list
    rng.shuffle(rows)
    classes = defaultdict(set)
    for key, c, *_ in rows:
        classes[key].add(c)
    want = sorted((k, c) for k, cs in classes.items() for c in cs if len(cs) > 1 or k == 999)
    got = jaccard._shared_records(np.array(rows, jaccard._RECORD))
    assert sorted((r["key"], tuple(r["c"])) for r in got) == want
    assert len(jaccard._shared_records(np.array([], jaccard._RECORD))) == 0
