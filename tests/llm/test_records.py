"""SimHash, PII, mixing, WARC and the pipeline against plain Python."""

import datetime
import hashlib
import io
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pageloom.llm import jaccard, minhash, mixing, pii, queries, simhash, warc
from pageloom.llm.common import table

# ------------------------------------------------------------------ SimHash


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    """prints: (doc_id, fingerprint) pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: low[root(i)] for i, (d, _) in enumerate(prints)}


def test_fingerprints_and_components(spark, folder):
    docs = table(spark, folder, "documents").collect()
    prints = [(d.doc_id, plain_fingerprint(d.text)) for d in docs]
    got = queries.simhash_components(spark, folder).collect()
    assert {(r.doc_id, r.fingerprint) for r in got} == {(d, f"{f:016x}") for d, f in prints}
    assert {r.doc_id: r.component_id for r in got} == plain_components(prints)


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    rng = random.Random(radius)
    for positions in (list(range(64)), list(range(0, 64, 2)), list(range(11)), list(range(16))):
        masks = simhash.masks(positions, radius)
        for _ in range(300):
            flipped = rng.sample(positions, min(radius, len(positions)))
            diff = sum(1 << p for p in flipped)
            assert any((m & diff) == 0 for m in masks)
        if len(positions) > 10:
            assert all(m for m in masks)


def test_links_in_crowded_buckets(spark):
    # Chains and clouds whose buckets exceed the group size by far.
    rng = random.Random(6)
    values = set()
    for centre in (rng.getrandbits(64) for _ in range(3)):
        for _ in range(120):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            values.add(x)
    values |= {rng.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1}
    prints = list(enumerate(sorted(values)))
    signed = [(x - (1 << 64) if x >> 63 else x,) for _, x in prints]
    df = spark.createDataFrame(signed, "fingerprint long")
    name = {s[0]: i for s, (i, _) in zip(signed, prints)}
    want = plain_components(prints)
    for group in (8, 1024):
        edges = simhash.links(df, group=group)
        low = {r.v: r.root for r in simhash.components(edges).collect()}
        groups = {}
        for s, i in name.items():
            groups.setdefault(low.get(s, s), []).append(i)
        got = {i: min(g) for g in groups.values() for i in g}
        assert got == want


def test_simhash_odd_tables(spark):
    rows = [(5, "a b c d e"), (3, "A B c d e"), (9, None), (8, ""), (7, " \n"), (None, "a b c d e"), (5, "a b c d e")]
    df = spark.createDataFrame(
        [(d, t, "en", None, 1, "x") for d, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, component_id string",
    )
    got = {(r.doc_id, r.component_id) for r in simhash.cluster(df).collect()}
    assert got == {(5, 3), (3, 3), (None, 3), (9, 7), (8, 7), (7, 7)}
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 7]
    assert simhash.cluster(df.limit(0)).count() == 0
    assert simhash.keep_first(df.limit(0)).count() == 0
    twins = spark.createDataFrame([(1, "b b b b b"), (1, "b b b b b"), (2, "q")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(twins).collect()) == [1, 2]


def test_near_copy_stage_keeps_unlike_texts_of_one_id(spark):
    a, b, c = ("one two three four five", "quite another text under one id", "six seven eight nine ten")
    rows = [(5, a, 1), (5, b, 2), (6, c, 3), (7, a, 4), (5, a, 5), (2, b, 6), (None, c, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_uid long").withColumn("row_print", F.lit(0))
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert got.columns == df.columns
    kept = [tuple(r)[:3] for r in got.collect()]
    assert sorted((d or 0, t) for d, t, _ in kept) == [(0, c), (2, b), (5, a), (6, c)]
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text in all rows").alias("text"))
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, hot, "").collect()] == [0]


# ---------------------------------------------------------------------- PII


def plain_hash(*parts):
    return int(hashlib.sha256("|".join(map(str, (pii.KEY, *parts))).encode()).hexdigest()[:15], 16)


def plain_feistel(a, b, m, n, label):
    for i in range(1, pii.ROUNDS // 2 + 1):
        a = (a + plain_hash(label, "a", i, b) % m) % m
        b = (b + plain_hash(label, "b", i, a) % n) % n
    return a, b


def plain_digits(d, label):
    out = ""
    for i in range(0, len(d), 18):
        part = d[i : i + 18]
        left = len(part) // 2
        a, b = plain_feistel(
            int(part[:left] or 0), int(part[left:]), 10**left, 10 ** (len(part) - left),
            f"{label}/{i // 18}:{len(part)}",
        )
        out += (str(a).zfill(left) if left else "") + str(b).zfill(len(part) - left)
    return out


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10


def hidden(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = pii.pseudonymise(df, **options).orderBy("doc_id").collect()
    return [(r.text, list(r.pii_found)) for r in rows]


def test_cards_and_addresses_by_plain_python(spark):
    card, other = "4539578763621486", "4539578763621487"
    assert luhn(card) == 0 and luhn(other) != 0
    text = f"pay {card} or 4539 5787 6362 1486, not {other}; host 10.20.30.40 not 10.20.30.400."
    (got, kinds), = hidden(spark, [text])
    body = plain_digits(card[:-1], "card")
    new = next(body + c for c in "0123456789" if luhn(body + c) == 0)
    spaced = " ".join(new[i : i + 4] for i in range(0, 16, 4))
    a, b = plain_feistel(10 * 256 + 20, 30 * 256 + 40, 65536, 65536, "ipv4")
    ip = f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    assert got == f"pay {new} or {spaced}, not {other}; host {ip} not 10.20.30.400."
    assert kinds == ["card", "card", "ipv4"]


def test_formats_stay_valid_and_equal_values_linked(spark):
    texts = [
        "born 1999-12-31, 31.12.1999, 31/12/1999, 1999/12/31; not 1999-02-30 or 99-12-31",
        "ssn 123-45-6789 and 123-45-6789, not 000-12-3456",
        "call +1 (017) 555-7713 or (212) 555-0100 or 212-555-0100",
        "mail Ann.Lee34@mail7.example now; ann.lee34@mail7.example",
        "DE89370400440532013000 and DE89 3704 0044 0532 0130 00, not DE88370400440532013000",
    ]
    out = hidden(spark, texts)
    days = re.findall(r"\d[\d./-]{9}", out[0][0])
    parsed = {
        datetime.datetime.strptime(d, f).date()
        for d, f in zip(days, ["%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%Y/%m/%d"])
    }
    assert len(parsed) == 1 and parsed != {datetime.date(1999, 12, 31)}
    assert out[0][0].endswith("; not 1999-02-30 or 99-12-31")
    one, two = re.findall(r"\d{3}-\d\d-\d{4}", out[1][0])[:2]
    assert one == two != "123-45-6789" and "000-12-3456" in out[1][0]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}", out[2][0])
    assert re.findall(r"\d{3}\D+\d{3}-\d{4}", out[2][0])[1].replace(") ", "-") == out[2][0][-12:]
    first, second = re.findall(r"\S+@\S+\.example", out[3][0])
    assert first != "Ann.Lee34@mail7.example" and first.lower() == second
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\d\d@[a-z]{4}\d\.example", first)
    bare, spaced = re.match(r"(DE\d{20}) and (DE[\d ]+),", out[4][0]).groups()
    assert spaced.replace(" ", "") == bare != "DE89370400440532013000"
    assert int(bare[4:] + "1314" + bare[2:4]) % 97 == 1 and "DE88370400440532013000" in out[4][0]
    assert [len(k) for _, k in out] == [4, 2, 3, 2, 2]


def test_permutations_are_bijections(spark):
    df = spark.range(1000).select(
        pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("k"), F.lit("t")).alias("p"),
        pii.permute_letters(
            F.concat(F.chr(97 + F.col("id") % 26), F.chr(97 + F.floor(F.col("id") / 26) % 26)), F.lit("k"), F.lit("t")
        ).alias("l"),
    )
    rows = df.collect()
    assert len({r.p for r in rows}) == 1000 and all(re.fullmatch(r"\d{3}", r.p) for r in rows)
    assert len({r.l for r in rows[:676]}) == 676


def test_neighbours_do_not_hide_values(spark):
    card, iban = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    texts = [
        card, card.replace(" ", ""), iban, f"{card} 12/25", f"{card.replace(' ', '')} 123", f"order 7 {card}",
        f"{iban} BIC COBADEFF", f"{iban.replace(' ', '')} EUR 500", f"1234 5678 {card}", f"{iban} {card} 123",
        f"{card} 2024-01-01 a.b@c.example", f"{iban} {iban}",
    ]
    out = hidden(spark, texts)
    new, bare, other = out[0][0], out[1][0], out[2][0]
    assert new != card and other != iban and new.replace(" ", "") == bare
    assert [t for t, _ in out[3:9]] == [
        f"{new} 12/25", f"{bare} 123", f"order 7 {new}", f"{other} BIC COBADEFF",
        other.replace(" ", "") + " EUR 500", f"1234 5678 {new}",
    ]
    assert out[9] == (f"{other} {new} 123", ["iban", "card"])
    assert out[10][0].startswith(new + " ") and out[10][1] == ["card", "date", "email"]
    assert out[11] == (f"{other} {other}", ["iban", "iban"])


def test_long_addresses_keep_their_length(spark):
    rng = random.Random(4)
    local = "".join(rng.choice("abcdefghij0123456789") for _ in range(1000))
    digits = "".join(rng.choice("0123456789") for _ in range(1000))
    locals_ = [local, local[:-1] + "z", local[:-1] + "y", digits, digits[:-1] + "x"]
    out = [t for t, _ in hidden(spark, [f"to {x}@host.example now" for x in locals_])]
    assert [len(t) for t in out] == [1000 + len("to @host.example now")] * 5
    assert len(set(out)) == 5 and all(x not in t for x, t in zip(locals_, out))


def test_pii_leaves_clean_texts_and_plan_native(spark, folder):
    docs = table(spark, folder, "documents")
    got = queries.pii_pseudonyms(spark, folder)
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in got.collect():
        assert (r.text == before[r.doc_id]) == (not r.pii_found) or r.text != before[r.doc_id]
        if not r.pii_found:
            assert r.text == before[r.doc_id]
    assert hidden(spark, [None, "", "plain", "token a1b2c3d4e5f60718293a4b5c6d7e8f9001122334"])[:3] == [
        (None, []), ("", []), ("plain", [])
    ]
    odd = spark.createDataFrame([(1, "at 10.0.0.1", "x")], "doc_id long, text string, pii_found string")
    row = pii.pseudonymise(odd).collect()[0]
    assert row.pii_found == "x" and list(row._pii_found) == ["ipv4"]


# ------------------------------------------------------------------- mixing


def plain_poisson(mean, *keys):
    parts = max(1, math.ceil(mean / 16))
    total = 0
    for p in range(1, parts + 1):
        u = int(hashlib.md5("|".join(map(str, (*keys, p))).encode()).hexdigest()[:13], 16) / 2**52
        term = below = math.exp(-mean / parts)
        n = 0
        while below <= u and n < 80:
            n += 1
            term *= mean / parts / n
            below += term
        total += n
    return total


def test_mix_draws_and_shares(spark):
    rows = [(i, f"text {i}", "big" if i % 4 else "small") for i in range(3000)]
    rows += [(9000, None, None), (9001, "", None), (9001, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit("mine"))
    weights = {"big": 1.0, "small": 1.0}
    got = mixing.mix(df, weights, epochs=2.0)
    assert got.columns == ["doc_id", "text", "source", "copy", "_copy", "position_key"]
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t or "") + 1
    total = sum(sizes.values())
    counts = Counter(r.doc_id for r in got.collect())
    for d, t, s in rows[:3000]:
        rate = 0.5 * total * 2.0 / sizes[s]
        assert counts[d] == plain_poisson(rate, "mix", d, hashlib.md5(t.encode()).hexdigest())
    assert counts[9000] == counts[9001] == 0
    chars = Counter()
    for r in got.collect():
        chars[r.source] += len(r.text) + 1
    assert abs(chars["big"] / chars["small"] - 1) < 0.15
    assert mixing.mix(df.limit(0)).count() == 0
    many = mixing.mix(df.filter("doc_id < 40"), epochs=50.0).groupBy("doc_id").count().collect()
    assert 45 < sum(r["count"] for r in many) / 40 < 55


# --------------------------------------------------------------------- WARC


def test_archive_round_trip(spark, tmp_path):
    rows = [(5, "http://a/1", "<p>x</p>" * 300), (2, "http://a/2", "<p>x</p>" * 300), (3, None, None),
            (4, "u\r\nX: y", ""), (2, "http://a/2", "<p>x</p>" * 300), (9, "é", "ü" * 50000), (None, "n", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(df).collect()
    want = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "").encode() == body and p is not None) if page_id else None
        again = first is not None and first != page_id
        want.append((page_id, len(body), warc.digest(body), "revisit" if again else "response", first if again else None))
    key = str
    assert sorted(map(tuple, (( r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)), key=key) == sorted(want, key=key)
    limited = warc.round_trip(df, min_payload=1).filter("payload_bytes = 0").collect()
    assert {r.record_type for r in limited} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0


def archive(records, dictionary=b"", limit=1 << 30):
    out = io.BytesIO()
    warc.write_archive(out, dictionary, iter(records), limit)
    return out.getvalue()


def test_reader_with_dictionary_and_small_reads(monkeypatch):
    samples = [f"<html><body><p>page {i} of many</p></body></html>".encode() * 8 for i in range(200)]
    records = [warc.record(str(i), "http://x/", "response", s, None, "2024-01-01T00:00:00Z") for i, s in enumerate(samples)]
    dictionary = warc.train_dictionary(records)
    assert dictionary
    data = archive(records, dictionary)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and len(data) < len(archive(records)) + len(dictionary)
    for chunk in (7, 1000, 1 << 20):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        assert [b for _, b in warc.read_archive(io.BytesIO(data))] == samples
    monkeypatch.setattr(warc, "CHUNK", 1 << 20)
    assert list(warc.read_archive(io.BytesIO(b""))) == []
    for broken in (data[:-3], data[: len(dictionary) // 2], data + b"junk", data[: 8 + len(dictionary)] + b"\0" + data[9 + len(dictionary) :]):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(io.BytesIO(broken)))


@pytest.mark.parametrize(
    "change",
    [(b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 4", b"Content-Length: 5"), (b"\r\n\r\nbody", b"\r\n\r\nb0dy"),
     (b"WARC-Date:", b"WARC Date:"), (b"WARC-Type: response", b"WARC-Kind: response"), (b"\r\n\r\n", b"\r\n")],
)
def test_parse_refuses_faults(change):
    good = warc.record("1", "http://x/", "response", b"body", None, "2024-01-01T00:00:00Z")
    assert warc.parse(good)[1] == b"body"
    with pytest.raises(warc.ArchiveError):
        warc.parse(good.replace(*change))


# ----------------------------------------------------------------- pipeline


def test_near_copies_at_four_fifths(spark, monkeypatch):
    rng = random.Random(12)

    def text():
        return [f"w{rng.randint(0, 99999)}" for _ in range(200)]

    def runs(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    def similarity(a, b):
        a, b = runs(a), runs(b)
        return len(a & b) / len(a | b)

    rows, planted = [], 0
    for i in range(40):
        words = text()
        changed = list(words)
        for place in rng.sample(range(10, 190), 1 + i % 4):
            changed[place] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
        planted += 0.8 <= similarity(rows[-2][1], rows[-1][1]) <= 0.98
    assert planted >= 30
    base = text()  # a chain whose buckets exceed the group size
    rows += [(1000 + k, " ".join(base[k:] + base[:k])) for k in range(60)]
    parent = {d: d for d, _ in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for n, (a, s) in enumerate(rows):
        for b, t in rows[:n]:
            if similarity(s, t) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = sorted({root(d) for d, _ in rows})
    rows += [(2000, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash.leaders(df).collect()) == want
    named = {r.component_id for r in jaccard.cluster(df).collect()}
    assert sorted(named) == want
    monkeypatch.setattr(minhash, "GROUP", 8)
    assert sorted(r.doc_id for r in minhash.leaders(df).collect()) == want


def test_pipeline_stages(spark, folder):
    docs = table(spark, folder, "documents").withColumn("score", F.lit("kept"))
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "packing"]
    toxic = {r.doc_id for r in table(spark, folder, "labels").filter("toxic = 1").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, folder).cache()
        if name != "packing":
            assert after.columns == columns
        old, new = before.collect(), after.collect()
        if name == "toxicity":
            gone = {r.doc_id for r in old} - {r.doc_id for r in new}
            assert len(gone - toxic) <= 0.02 * len(old)
        if name == "simhash":
            comp = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in old])
            assert sorted(r.doc_id for r in new) == sorted(set(comp.values()))
        if name == "pii":
            assert [r.doc_id for r in new] == [r.doc_id for r in old]
            assert all(r.n_chars == len(r.text) for r in new)
        if name == "mixing":
            assert 0.7 * len(old) < len(new) < 1.3 * len(old)
        if name == "packing":
            assert sum(r.piece == 0 for r in new) == len(old)
        before = after
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_a_payload_of_very_many_pages_is_split(spark, tmp_path):
    """With broadcasting off and small skew bounds, no task writes most of the records."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    old = {k: spark.conf.get(k) for k in settings}
    n = F.col("id")
    pages = spark.range(0, 24_000, 1, 16).select(
        n.alias("page_id"), F.lit("http://x/").alias("url"),
        F.when(n % 5 < 3, F.lit("".join(f"the {i * 7919} page " for i in range(150)))).otherwise(F.concat(F.lit("page "), F.sha2(n.cast("string"), 256))).alias("html"),
    )
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        folder = f"file://{tmp_path}/warc"
        written = warc.write(pages, folder).collect()
        read = warc.read(spark.createDataFrame(written)).groupBy("record_type").count().collect()
        assert {r["record_type"]: r["count"] for r in read} == {"response": 9_601, "revisit": 14_399}
        # 14,400 pages share one payload.
        assert max(r["records"] for r in written) < 6_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
