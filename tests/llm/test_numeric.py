"""Packing, top-k, MinHash and the classifiers against brute force and held-out rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageloom.llm import langid, minhash, packing, quality, queries, topk, toxicity
from pageloom.llm.common import table

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text").collect()


def odd_docs(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "no id here at all"),
        (7, "long " * 5000), (8, "x" * 20000), (9, "it's  <|endoftext|> a\n\nb "), (9, "other text"),
    ]
    return spark.createDataFrame(
        [(d, t, None, None, None, "extra", 1) for d, t in rows],
        DOC + ", fingerprint string, piece int",
    )


# ------------------------------------------------------------------ packing


def test_encoder_gives_the_ids_of_the_file(docs):
    path = packing.vocabulary_path()
    exact, ours = Tokenizer.from_file(path), packing.Encoder(path)
    rng = random.Random(3)
    bits = ["a", "b ", "\n", " ", "x1", "'s", "é", "\t", "<|endoftext|>", "!!", "\x1d", " the", "\x85", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 15))) for _ in range(1500)]
    for text in texts + [r.text for r in docs]:
        ids = exact.encode(text, add_special_tokens=False).ids
        assert ours.ids(text) == np.array(ids, "<u4").tobytes(), text


def check_packed(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pack_places_every_piece_once(spark, folder, docs, capacity):
    rows = packing.pack(table(spark, folder, "documents"), capacity).collect()
    ids = Tokenizer.from_file(packing.vocabulary_path())
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len(by_doc) == len(docs)
    for d in docs:
        tokens = ids.encode(d.text, add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert sum(p.length for p in pieces) == len(tokens)
        assert all(p.length == capacity for p in pieces[1:])
        for p in pieces:
            part = np.array(tokens[p.start : p.start + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(part)
    used = check_packed(rows, capacity)
    bound = -(-sum(r.length for r in rows) // capacity)
    assert used <= 1.03 * bound + 2


def test_pack_odd_and_empty_tables(spark):
    odd = odd_docs(spark)
    rows = packing.pack(odd, 64, keep_ids=True).collect()
    assert sum(r.piece == 0 for r in rows) == odd.count()
    check_packed(rows, 64)
    assert all(len(r.ids) == r.length for r in rows)
    assert {(r.length, r.start) for r in rows if r.doc_id in (1, 2)} == {(1, 0)}
    assert packing.pack(odd.limit(0)).count() == 0


def test_plan_is_exact_and_near_the_bound():
    rng = np.random.default_rng(5)
    for scale in (1, 400):
        sizes = {}
        for length in np.minimum(rng.geometric(0.02, 400), 256):
            sizes[int(length)] = sizes.get(int(length), 0) + scale
        plan = packing.make_plan(sizes, 256, rest=200)
        placed = {}
        for items, times in plan.patterns:
            assert sum(v * n for v, n in items) <= 256
            for v, n in items:
                placed[v] = placed.get(v, 0) + n * times
        assert placed == sizes
        assert plan.bound <= plan.sequences() <= 1.01 * plan.bound + 1
    # Items just above half can't be paired: the dual bound sees it, the size bound not.
    plan = packing.make_plan({130: 1000, 10: 50}, 256, rest=10)
    assert plan.sequences() == 1000 and plan.bound > 900


# -------------------------------------------------------------------- top-k


def brute_top(rows, k):
    out = []
    for q, v in rows:
        if q % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in rows if c != q)
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5])
def test_top_k_is_exact(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "PART_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "ROUNDS", (2, 5))
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 0.4, (5, 6))
    vectors = [(i, (centres[i % 5] + rng.normal(0, 0.05, 6)).round(3).tolist()) for i in range(400)]
    vectors += [(400 + i, [0.5] * 6) for i in range(100)]  # ties
    bad = [(600, None), (650, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (700, [float("nan")] * 6),
           (701, [float("inf")] * 6), (None, [9.0] * 6)]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k, pivots=8).collect()
    rows = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows, k)
    few = topk.top_k(df.filter("vec_id IN (0, 3)"), F.col("vec_id") % 50 == 0, k).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 3)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# ------------------------------------------------------------------ MinHash


def shingles(text):
    words = text.encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_probe_matches_plain_python(spark, folder, docs):
    got = {r.doc_id: r for r in minhash.probe_next(table(spark, folder, "documents").repartition(5)).collect()}
    rows = sorted((d.doc_id, d.text) for d in docs)
    assert len(got) == len(rows)
    errors = []
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        r = got[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(new.encode()).digest()
        errors.append(r.near_edited - jaccard(text, new))
        assert abs(r.near_next - jaccard(text, after)) < 0.35
    assert np.abs(errors).mean() < 0.06
    assert abs(np.mean(errors)) < 0.02


def test_fingerprints_do_not_depend_on_batches(docs, monkeypatch):
    texts = [d.text.encode() for d in docs[:40]] + [b"", b"a b", b"  x  "]
    whole = minhash.Hasher().fingerprints(texts)
    alone = [minhash.Hasher().fingerprints([t])[0] for t in texts]
    assert (whole == np.array(alone)).all()
    monkeypatch.setattr(minhash, "STEP_SHINGLES", 37)
    monkeypatch.setattr(minhash, "STEP_BYTES", 300)
    assert (minhash.Hasher().fingerprints(texts) == whole).all()


def test_probe_odd_and_empty_tables(spark):
    odd = odd_docs(spark)
    rows = minhash.probe_next(odd).collect()
    assert len(rows) == odd.count()
    same = {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)}
    assert len(same) == 1
    assert minhash.probe_next(odd.limit(0)).count() == 0
    one = minhash.probe_next(odd.filter("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_similar_pairs_are_found(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    rows = []
    for i, place in enumerate(rng.sample(range(120), 12)):
        words = list(base)
        words[place] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(100, rows[3][1]), (200, " ".join(f"v{rng.randint(0, 999)}" for _ in range(120))), (300, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.similar_pairs(df).collect()
    want = {
        (a, b) for a, s in rows[:12] for b, t in rows[:12] if a < b and s != t and jaccard(s, t) >= 0.8
    }
    assert {(r.a, r.b) for r in got} == want
    monkeypatch.setattr(minhash, "GROUP", 4)
    # Buckets beyond one block lose nothing and name no pair twice.
    split = [(r.a, r.b) for r in minhash.similar_pairs(df).collect()]
    assert set(split) == want and len(split) == len(want)
    same = {r.doc_id: r.class_id for r in minhash.membership(df).collect()}
    assert same == {i: 3 if i == 100 else i for i, _ in rows}


def test_similar_pairs_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, "another text under the same number"), (2, text + " end"), (None, text), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.a, r.b) for r in minhash.similar_pairs(df).collect()] == [(1, 2)]
    assert minhash.similar_pairs(df.limit(0)).count() == 0
    assert minhash.membership(df.limit(0)).count() == 0


# -------------------------------------------------------------- classifiers


def test_quality_on_held_out_rows(spark, folder):
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = queries.quality_scores(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.88


def test_quality_covers_all_chunks():
    net = quality.train([b"good text here " * 9, b"!!## " * 30] * 6, np.array([1, 0] * 6))
    text = b"good text here " * 300
    plain = quality.pooled(net, quality.padded(text))
    marked = quality.pooled(net, quality.padded(text[:-40] + b"!!## " * 8))
    assert (plain != marked).any()
    step, quality.STEP_BYTES = quality.STEP_BYTES, 64
    try:
        assert np.allclose(quality.pooled(net, quality.padded(text)), plain, atol=1e-4)
    finally:
        quality.STEP_BYTES = step


def test_language_on_held_out_rows(spark):
    want = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = queries.languages(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.97


def test_language_mixture_finds_shares():
    model = langid.train([("aa", "abcabd abacab " * 50), ("bb", "xyzyxz zyxzzy " * 50), ("cc", "klmlkm mlkmlm " * 50)])
    lang, share, found = model.judge("abcabd abacab " * 30 + "xyzyxz zyxzzy " * 10)
    assert lang == "aa" and {a for a, _ in found} == {"aa", "bb"} and 0.65 < share < 0.85
    assert model.judge("123 456") == ("und", 0.0, [])
    assert model.judge(None)[0] == "und"


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    rows = queries.toxicity_scores(spark, "/root/testdata/sf0.1").collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97


def test_only_verified_copies_are_dropped():
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(80):  # a shared passage and own words: no copies
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
        rows.append((i, i % 2, " ".join(own + passage)))
    one = rows[5][2].split()
    rows += [(100, 1, " ".join(one[:-1] + ["changed"])), (101, 0, rows[5][2]), (102, 1, rows[5][2])]
    keyed = [(d, y, toxicity.copy_keys(r), r) for d, y, t in rows for r in [toxicity.runs_of(t)]]
    # 101 carries the other label.
    assert toxicity.without_copies(keyed) == [*range(80), 101]


def test_block_max_index_is_exact():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(300):
        ids = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        w = rng.random(len(ids))
        vectors.append((ids, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex(vectors, 40)
    dense = np.zeros((300, 40))
    for row, (ids, w) in zip(dense, vectors):
        row[ids] = w
    for ids, w in vectors[:60]:
        cos = dense[:, ids] @ w
        want = np.lexsort((np.arange(300), -np.round(cos, 12)))[:7]
        doc, got = index.nearest(ids, w, 7)
        assert np.allclose(got, cos[want]) and list(doc) == list(want)


@pytest.mark.parametrize("labelled", [0, 1])
def test_classifiers_take_odd_and_empty_tables(spark, labelled):
    odd = odd_docs(spark)
    labels = spark.createDataFrame(
        [(4, 1, 0), (7, 0, 1), (9, None, None), (None, 1, 1), (99, 1, 1)][: 5 * labelled],
        "doc_id long, quality int, toxic int",
    )
    every = F.lit(True)
    for docs in (odd, odd.limit(0)):
        net = quality.fit(docs, labels, every)
        scores = [r.s for r in docs.select(quality.score(net, F.col("text")).alias("s")).collect()]
        assert all(0 <= s <= 1 for s in scores) and len(scores) == docs.count()
        model = toxicity.fit(docs, labels, every)
        scores = [r.s.score for r in docs.select(toxicity.score(model, F.col("text")).alias("s")).collect()]
        assert all(0 <= s <= 1 for s in scores) and len(scores) == docs.count()
        found = langid.fit(docs, every)
        langs = docs.select(langid.identify(found, F.col("text")).alias("s")).collect()
        assert {r.s.lang_pred for r in langs} <= {"und"}


# ------------------------------------------------- classifiers by brute force


def plain_response(net, text):
    """Largest response of each filter over all chunks, position by position."""
    half, lags = quality.HALF, quality.LAGS
    data = quality.padded(text)
    codes, w = data[lags:], np.vstack([net.left, net.right])
    best = [0.0] * quality.FILTERS
    for start in range(0, len(codes) - 2 * half + 1, half):
        for f in range(quality.FILTERS):
            z = float(net.bias[f])
            for i in range(2 * half):
                for d in range(quality.DIM):
                    z += float(net.embed[codes[start + i], d]) * float(w[i * quality.DIM + d, f])
            for lag in range(1, lags + 1):
                same = sum(data[lags + start + i] == data[lags + start + i - lag] for i in range(2 * half))
                z += same / half * float(net.lags[lag - 1, f])
            best[f] = max(best[f], z)
    return best


def test_quality_equals_a_plain_forward_pass(spark):
    net = quality.train([b"good text here " * 9, b"!!## " * 30] * 6, np.array([1, 0] * 6))
    texts = ["", "short", "aaaa " * 12, "good text, é and !!## " * 5, None]
    want = []
    for t in texts:
        z = sum(float(o) * b for o, b in zip(net.out, plain_response(net, (t or "").encode())))
        want.append(1 / (1 + np.exp(-(z + net.out_bias))))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = df.select("id", quality.score(net, F.col("text")).alias("s")).orderBy("id").collect()
    assert np.allclose([r.s for r in got], want, atol=1e-4)


def plain_mixture(model, text):
    """The same inference, trigram by trigram and language by language."""
    raw = f" {text.lower()} ".encode()
    times = {}
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        code = ((a | b << 8 | c << 16) * 2654435761 % 2**32) >> 17
        times[code] = times.get(code, 0) + 1
    total = sum(times.values())
    active = list(range(len(model.languages)))
    share, best = [1 / len(active)] * len(active), None
    while True:
        for _ in range(langid.ROUNDS):
            new = [0.0] * len(active)
            for code, n in times.items():
                parts = [s * model.chance[code, a] for s, a in zip(share, active)]
                for i, p in enumerate(parts):
                    new[i] += n * p / sum(parts) / total
            moved = max(abs(x - y) for x, y in zip(new, share))
            share = new
            if moved < 1e-3:
                break
        fit = sum(
            n * np.log(sum(s * model.chance[code, a] for s, a in zip(share, active))) for code, n in times.items()
        ) - langid.PENALTY * np.log(total + 1) * len(active)
        if best is None or fit >= best[0]:
            best = (fit, {model.languages[a]: s for a, s in zip(active, share)})
        if len(active) == 1:
            return best[1]
        gone = {i for i, s in enumerate(share) if s < 0.01} or {share.index(min(share))}
        if len(gone) == len(active):
            gone.discard(share.index(max(share)))
        active = [a for i, a in enumerate(active) if i not in gone]
        share = [s for i, s in enumerate(share) if i not in gone]
        share = [s / sum(share) for s in share]


def test_language_equals_plain_expectation_maximisation():
    rng = random.Random(8)
    sets = {"aa": "abcdef", "bb": "defghi", "cc": "xyzuvw", "dd": "uvwklm", "ee": "ghixyz"}

    def words(lang, n):
        return " ".join("".join(rng.choices(sets[lang], k=rng.randint(2, 6))) for _ in range(n))

    model = langid.train([(lang, words(lang, 300)) for lang in sets for _ in range(3)])
    for _ in range(12):
        text = " ".join(words(rng.choice(list(sets)), rng.randint(1, 60)) for _ in range(rng.randint(1, 3)))
        want = plain_mixture(model, text)
        lang, share, found = model.judge(text)
        assert {a for a, _ in found} == set(want) and lang == max(sorted(want), key=lambda a: round(want[a], 9))
        assert all(abs(want[a] - s) < 1e-6 for a, s in found)


def test_every_language_is_learned_from_an_even_share(spark):
    """250 languages, one of which holds most rows, and an id that very many rows share."""
    rows = [(10_000 + i, f"l{i:03d}", f"w{i} q{i}x " * 3) for i in range(250) for _ in range(2)]
    rows += [(i, "l000", f"large {i} text") for i in range(3000)] + [(5, "l001", f"same id {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(6)
    model = langid.fit(df, F.lit(True), 2000)
    assert len(model.languages) == 250
    picked = langid.sample(df.select("lang", "doc_id"), 2000)
    counts = {r["lang"]: r["count"] for r in picked.groupBy("lang").count().collect()}
    assert counts == {f"l{i:03d}": 1 for i in range(2, 250)} | {"l000": 8, "l001": 2}
    want = sorted(
        (r.h, r.doc_id) for r in df.filter("lang = 'l000'").select("doc_id", F.expr("xxhash64('sample', doc_id)").alias("h")).distinct().collect()
    )[:8]
    assert {r.doc_id for r in picked.filter("lang = 'l000'").collect()} == {d for _, d in want}


def test_fits_do_not_depend_on_the_order_of_repeated_ids(spark):
    rng = random.Random(4)
    rows = [(i % 30, f"{'bad worse ' if i % 3 else 'fine text '}{rng.random()} word{i}", "xy"[i % 2]) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(30)], "doc_id long, quality int, toxic int")
    fitted = []
    for seed in (1, 2):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        df = spark.createDataFrame(mixed, "doc_id long, text string, lang string").repartition(3 + seed)
        net, found = quality.fit(df, labels, F.lit(True), 20), langid.fit(df, F.lit(True), 20)
        model = toxicity.fit(df, labels, F.lit(True), 20)
        assert len(model.ids) <= 20
        scores = df.select("text", toxicity.score(model, F.col("text")).alias("s")).collect()
        fitted.append((net.embed.tobytes(), found.chance.tobytes(), sorted((r.text, r.s.score) for r in scores)))
    assert fitted[0] == fitted[1]


def test_top_k_sends_the_index_only_where_it_is_visited(spark, monkeypatch):
    """All queries lie in one cluster of five: far fewer parts than one index a block."""
    monkeypatch.setattr(topk, "PART_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    monkeypatch.setattr(topk, "ROUNDS", (2,))
    sent = []
    write = topk.materialize

    def counted(df, label):
        out = write(df, label)
        if label == "wanted":
            sent.append(out.count())
        return out

    monkeypatch.setattr(topk, "materialize", counted)
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 3, (5, 6))
    centres *= 6 / np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.02, 6)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, pivots=20).collect()
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(ints, 5)
    # 20 blocks, and 20 pivots of 13 annuli each.
    assert 0 < sum(sent) < 0.4 * 20 * 20 * 13
