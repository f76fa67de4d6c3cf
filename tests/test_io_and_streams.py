import csv
import glob
import random
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pageloom.functions import charset, html, nets, sql, urls
from pageloom.operators import chunks, health, reports, sites
from pageloom.session import materialize
from pageloom.sources import pages as sources
from pageloom.sources import sinks
from pageloom.streaming import breaker, jobs, kept

CHUNKS = "url string, chunk_number int, content string"


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    jobs.use_rocksdb(spark)


def test_csv_round_trip(spark, tmp_path):
    rows = [
        ("http://a/1", 1, 'say "hi", a\\b'),
        ("http://a/1", 2, " edges "),
        ("http://a/2", 1, "=sum(1)\nline two"),
        ("-dash", 1, "\ttab"),
        ("http://a/3", 4, "é😀"),
    ]
    path = str(tmp_path / "out")
    sinks.write_chunks_csv(spark.createDataFrame(rows, CHUNKS), path)
    want = {
        ("http://a/1", 'say "hi", a\\b', 1),
        ("http://a/1", " edges ", 2),
        ("http://a/2", "'=sum(1)\nline two", 1),
        ("'-dash", "'\ttab", 1),
        ("http://a/3", "é😀", 4),
    }
    assert {tuple(r) for r in sinks.read_chunks_csv(spark, path).collect()} == want
    plain = set()
    for part in glob.glob(f"{path}/part-*"):
        with open(part, newline="", encoding="utf-8") as f:
            head, *body = list(csv.reader(f))
            assert head == ["URL", "Content", "Chunk Number"]
            plain |= {(u, c, int(n)) for u, c, n in body}
    assert plain == want


def test_empty_export(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_chunks_csv(spark.createDataFrame([], CHUNKS), path)
    assert sinks.read_chunks_csv(spark, path).count() == 0


def test_by_site(spark, tmp_path):
    rows = [("http://a.b:80/x", 1, "t"), ("http://..c/x", 1, "u"), ("http://a.b:80/y", 1, "v")]
    path = str(tmp_path / "out")
    sinks.write_chunks_by_site(spark.createDataFrame(rows, CHUNKS), path)
    assert {d for d in os.listdir(path) if "=" in d} == {"site=a.b_80", "site=c"}


def test_site_buckets_bound_the_files_and_prune(spark, tmp_path):
    """A hundred thousand sites share 16 directories; one site is read from one of them."""
    path = str(tmp_path / "out")
    n = F.col("id")
    url = F.concat(F.lit("http://s"), F.when(n % 3 == 0, 0).otherwise(n).cast("string"), F.lit(".t/x"))
    cut = spark.range(150_000).select(url.alias("url"), n.cast("int").alias("chunk_number"), F.lit("text").alias("content"))
    sinks.write_site_buckets(cut, path, 16)
    files = glob.glob(f"{path}/bucket=*/*.parquet")
    assert len(os.listdir(path)) <= 16 + 3 and len(files) <= 32
    manifest = sinks.site_manifest(spark, path)
    assert manifest.agg(F.count("*"), F.sum("chunks")).first()[:] == (100_001, 150_000)
    for site, rows in (("s0.t", 50_000), ("s7.t", 1), ("s3.t", 0), ("other", 0)):
        read = sinks.read_site(spark, path, site)
        assert read.count() == rows and read.columns == ["url", "chunk_number", "content", "site"]
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "(bucket#" in plan[plan.index("PartitionFilters") :] and "EqualTo(site" in plan
    sinks.write_site_buckets(cut.limit(0), path, 4)
    assert sinks.site_manifest(spark, path).count() == 0
    with pytest.raises(ValueError):
        sinks.write_site_buckets(cut, path, 0)


def test_read_formats(spark, tmp_path):
    df = spark.createDataFrame([("http://a/", '<p class="x">1,\n2</p>')], sources.PAGES)
    for kind in ("parquet", "json", "orc"):
        df.write.format(kind).save(str(tmp_path / kind))
        assert sources.read_pages(spark, str(tmp_path / kind), kind).collect() == df.collect()
    df.write.options(header=True, escape='"').csv(str(tmp_path / "csv"))
    assert sources.read_pages(spark, str(tmp_path / "csv"), "csv").collect() == df.collect()


def test_loose_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.html").write_bytes("<p>é</p>".encode("latin-1"))
    raw = sources.read_page_files(spark, str(tmp_path), "http://s.t")
    assert [tuple(r) for r in sources.decode_pages(raw).collect()] == [("http://s.t/a/x.html", "<p>é</p>")]


def test_scan_reads_only_what_is_needed(spark, folder):
    pages = sources.read_pages(spark, f"{folder}/pages.parquet")
    for parsed in (True, False):
        plan = chunks.chunk_pages(pages, parsed=parsed)._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<url:string,html:string>" in plan
        assert ("Python" in plan) == parsed and "IsNotNull(html)" in plan


def test_dedup_reduces_before_the_shuffle(spark, folder):
    cut = chunks.chunk_pages(sources.read_pages(spark, f"{folder}/pages.parquet"))
    written = materialize(cut.withColumns({"_row": F.monotonically_increasing_id(), "_tie": F.lit(0)}), "cut")
    repeated = chunks._repeated(written, ("url", "chunk_number"))
    plan = repeated._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning") :]
    assert "partial_min" in below and "Window" not in plan
    # No text is shuffled, sorted or held by the reduction.
    assert "content#" not in plan and "content:" not in plan and "Sort" in plan
    df = chunks.dedup_chunks(cut)
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_run_summary_and_audit(spark):
    pages = spark.createDataFrame(
        [("http://a/1", "abab"), ("http://a/2", "ab"), ("http://b/1", "")], sources.PAGES
    )
    urls = pages.select("url").union(spark.createDataFrame([("http://b/2",)], "url string"))
    cut = chunks.chunk_pages(pages, 2)
    out = reports.run_summary(sites.fetch_lookup(urls, pages), cut, chunks.dedup_chunks(cut))
    assert {tuple(r) for r in out.collect()} == {("a", 2, 2, 0, 1, 2), ("b", 2, 0, 2, 0, 0)}
    assert {tuple(r) for r in reports.content_audit(cut).collect()} == {("a", 2, 3, 6)}


def arrive(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drain(stream, out, mark):
    sinks.write_chunks_stream(stream, out, mark).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_page_stream_twice_with_one_checkpoint(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    arrive(spark, source, [("u1", "aabb"), ("u2", "bbcc")], sources.PAGES)

    def run():
        stream = jobs.extract_stream(sources.read_pages_stream(spark, source), 2)
        kept = drain(jobs.dedup_stream(stream), out, mark)
        return sorted(r["content"] for r in kept.collect())

    assert run() == ["aa", "bb", "cc"]
    assert run() == ["aa", "bb", "cc"]
    arrive(spark, source, [("u3", "ccdd"), ("u1", "aabb")], sources.PAGES)
    assert run() == ["aa", "bb", "cc", "dd"]


def test_streamed_text_equals_batch(spark, tmp_path, folder):
    path = f"{folder}/[p]ages.parquet"
    got = drain(
        jobs.extract_stream(sources.read_pages_stream(spark, path), 200),
        str(tmp_path / "out"), str(tmp_path / "mark"),
    )
    want = chunks.chunk_pages(sources.read_pages(spark, f"{folder}/pages.parquet"), 200)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0


def test_progress_reports_the_run(spark, tmp_path):
    source = str(tmp_path / "in")
    arrive(spark, source, [("u1", "aabb"), ("u2", "bbcc")], sources.PAGES)
    stream = jobs.extract_stream(sources.read_pages_stream(spark, source), 2)
    done = sinks.write_chunks_stream(
        jobs.observe_run(stream), str(tmp_path / "out"), str(tmp_path / "mark")
    )
    done.awaitTermination()
    seen = [p["observedMetrics"]["run"] for p in done.recentProgress if p["observedMetrics"]]
    assert sum(m["chunks_written"] for m in seen) == 4


def test_dedup_with_bounded_state(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "content_hash string, fetched_at timestamp"
    day = datetime(2024, 1, 1)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        kept = jobs.dedup_stream(stream, within="1 day")
        return sorted(r[0] for r in drain(kept, out, mark).collect())

    arrive(spark, source, [("x", day), ("x", day), ("y", day)], schema)
    assert run() == ["x", "y"]
    arrive(spark, source, [("x", day + timedelta(hours=5)), ("z", day)], schema)
    assert run() == ["x", "y", "z"]
    for later in (10, 11, 12):
        arrive(spark, source, [(f"t{later}", day + timedelta(days=later))], schema)
        run()
    arrive(spark, source, [("x", day + timedelta(days=12))], schema)
    assert run().count("x") == 2


def test_visited_stream(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    arrive(spark, source, [("a",), ("a",), ("b",)], "url string")
    stream = spark.readStream.schema("url string").parquet(source)
    assert drain(jobs.visited_stream(stream), out, mark).count() == 2
    arrive(spark, source, [("b",), ("c",)], "url string")
    stream = spark.readStream.schema("url string").parquet(source)
    assert drain(jobs.visited_stream(stream), out, mark).count() == 3


def test_visited_state_holds_each_value_once(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("hot",)] * 500 + [(f"u{i % 40}",) for i in range(200)] + [(None,)] * 3
    spark.createDataFrame(rows, "url string").repartition(6).write.parquet(source)
    stream = jobs.visited_stream(spark.readStream.schema("url string").parquet(source))
    done = sinks.write_chunks_stream(stream, str(tmp_path / "out"), str(tmp_path / "mark"))
    done.awaitTermination()
    got = spark.read.schema("url string").parquet(str(tmp_path / "out"))
    assert got.count() == got.distinct().count() == 42
    (state,) = done.recentProgress[-1]["stateOperators"]
    assert state["numRowsTotal"] == 42


def test_of_copies_in_one_batch_one_in_time_passes(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "content_hash string, fetched_at timestamp"
    day = datetime(2024, 1, 1)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        return sorted(r[0] for r in drain(jobs.dedup_stream(stream, "1 day"), out, mark).collect())

    for later in (10, 11):
        arrive(spark, source, [(f"t{later}", day + timedelta(days=later))], schema)
        run()
    arrive(spark, source, [("x", day), ("x", day + timedelta(days=11)), ("late", day)], schema)
    assert run() == ["t10", "t11", "x"]


def test_breaker_stream_reports_rows_without_a_place(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    start = datetime(2024, 1, 1)
    big = 2**60 + 1
    rows = [("h", start, big, True), ("h", None, 3, True), ("h", start, None, False), (None, start, 1, True)]
    schema = "host string, ts timestamp, seq long, bad boolean"
    arrive(spark, source, rows, schema)
    log = spark.readStream.schema(schema).parquet(source)
    breaker.breaker_stream(log, F.col("bad"), "host", "ts", "seq", out, checkpoint=mark).awaitTermination()
    got = breaker.read_breaker(spark, out).collect()
    assert {(r.key, r.ts, r.seq, r.late, r.total) for r in got} == {
        ("h", start, big, False, 1),
        ("h", None, 3, None, None),
        ("h", start, None, None, None),
        (None, start, 1, False, 1),
    }


def test_breaker_stream_equals_replay_and_marks_late_rows(spark, tmp_path):
    schema = "host string, ts timestamp, seq int, bad boolean"
    start = datetime(2024, 1, 1)
    rules = health.BreakerRules(failure_threshold=2, recovery_timeout=30)
    rows = [
        (f"h{i % 3}", start + timedelta(seconds=11 * i), i, (i * 7) % 5 < 2) for i in range(60)
    ]
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def run():
        log = spark.readStream.schema(schema).parquet(source)
        breaker.breaker_stream(log, F.col("bad"), "host", "ts", "seq", out, rules, mark).awaitTermination()
        return breaker.read_breaker(spark, out)

    arrive(spark, source, rows[:25][::-1], schema)
    run()
    arrive(spark, source, rows[25:], schema)
    run()
    late = ("h0", start + timedelta(seconds=1), 99, True)
    arrive(spark, source, [late], schema)
    got = run()
    columns = ["state", "total", "failures", "streak"]
    on_time = got.filter("NOT late").select(F.col("key").alias("host"), F.col("seq").cast("int"), *columns)
    replay = health.breaker_replay(
        spark.createDataFrame(rows, schema), F.col("bad"), ["host"], ["ts", "seq"], rules
    ).select("host", "seq", *columns)
    assert {tuple(r) for r in on_time.collect()} == {tuple(r) for r in replay.collect()}
    assert len({r["state"] for r in replay.collect()}) == 3
    assert [r["seq"] for r in got.filter("late").collect()] == [99]


def test_breaker_stream_over_many_batches_with_a_hot_key(spark, tmp_path, monkeypatch):
    """One key holds more than a third of the rows and is cut into slices; the carried table
    is written whole several times."""
    monkeypatch.setattr(breaker, "COMPACT", 3)
    schema = "host string, ts timestamp, seq int, bad boolean"
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rules = health.BreakerRules(failure_threshold=3, recovery_timeout=40, success_threshold=2, failure_rate=0.6)
    rows = []
    for i in range(480):
        host = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        rows.append((host, start + timedelta(seconds=9 * i + rng.randrange(9)), i, rng.random() < 0.45))
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for at in range(0, 480, 60):
        arrive(spark, source, rows[at : at + 60][::-1], schema)
        log = spark.readStream.schema(schema).parquet(source)
        breaker.breaker_stream(
            log, F.col("bad"), "host", "ts", "seq", out, rules, mark, rows_per_slice=10
        ).awaitTermination()
    columns = ["state", "total", "failures", "streak"]
    got = breaker.read_breaker(spark, out)
    replay = health.breaker_replay(spark.createDataFrame(rows, schema), F.col("bad"), ["host"], ["ts", "seq"], rules)
    want = {tuple(r) for r in replay.select("host", "seq", *columns).collect()}
    assert {tuple(r) for r in got.select("key", "seq", *columns).collect()} == want and len(want) == 480
    assert got.filter("late").count() == 0 and {r[2] for r in want} == {"closed", "open", "half_open"}
    step = breaker._Step(out, f"{mark}/carried", rules, 10)
    parts = {r[0] for r in step.left_before(spark, 8).select("batch").distinct().collect()}
    assert parts == {6, 7}
    # A batch that is run again replaces what it wrote.
    again = spark.createDataFrame(rows[420:], schema).select(
        F.col("host").alias("key"), "ts", F.col("seq").cast("bigint").alias("seq"), F.col("bad").alias("failed")
    )
    step(again, 7)
    assert {tuple(r) for r in breaker.read_breaker(spark, out).select("key", "seq", *columns).collect()} == want
    plan = health.replay_on(
        again.withColumn("_before", F.lit(None).cast(health.CARRIED)), F.col("failed"), ["key"], ["ts", "seq"], rules
    )._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_sql_functions(spark):
    sql.register(spark)
    spark.createDataFrame(
        [("http://a/", '<a href="x">1</a><a href="/y">2</a>')], sources.PAGES
    ).createOrReplaceTempView("some_pages")
    got = spark.sql(
        "SELECT resolve_url(url, href) u, html_to_text(html) t FROM some_pages, LATERAL html_links(html)"
    )
    assert {tuple(r) for r in got.collect()} == {("http://a/x", "1 2"), ("http://a/y", "1 2")}
    row = spark.sql(
        "SELECT is_public_ip('10.0.0.1'), decode_body(X'E9', 'latin-1'), is_public_host('localhost'), "
        "is_public_ip('localhost'), html_to_text(NULL), resolve_url(NULL, 'x'), decode_body(NULL, 'utf-8')"
    ).first()
    assert tuple(row) == (False, "é", False, True, None, None, None)


def test_sql_functions_equal_the_column_forms(spark):
    """On forms of all kinds, nulls included."""
    sql.register(spark)
    bases = [None, "", "http://a.b", "http://a.b/c/d?q=1#f", "https://a.b/c//d/", "mailto:x", "http://[x"]
    hrefs = [None, "", "#", "#t", "?z", "../x", "./y", "/r;p", "//o.com/x", "x y", "HTTP://X.com/", "mailto:x@y",
             "http://h/p?", "a\\b", "javascript:void(0)", "http:x", "p/q.html?a=b#c"]
    table = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "base string, href string")
    both = table.select(urls.resolve_url(F.col("base"), F.col("href")).alias("c"), F.expr("resolve_url(base, href)").alias("s"))
    assert both.filter("NOT c <=> s").count() == 0 and both.filter("c IS NOT NULL").count() > 50
    marked = ["", None, "a&amp;b", "&#146;&#x41;&#0;&#xD800;&#99999999999;", "&notaname;&eacute x&copy", "a & b &&lt;p>",
              "<p>1<nav>2</nav>3<!-- 4", "\x1c x \x85 y\u00a0", "it's <script>'</script>\\n"]
    table = spark.createDataFrame([(m,) for m in marked], "html string")
    both = table.select(html.html_to_text(F.col("html")).alias("c"), F.expr("html_to_text(html)").alias("s"))
    assert both.filter("NOT c <=> s").count() == 0
    plan = table.selectExpr("html_to_text(html)")._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    bodies = [None, b"", b"ab", "é".encode(), b"\xe9", "é".encode("utf-16"), b"<meta charset=koi8-r>\xc1", b"\xff\xfe"]
    names = [None, "", "UTF-8", "latin-1", "no-such"]
    table = spark.createDataFrame([(b, n) for b in bodies for n in names], "body binary, declared string")
    both = table.select(
        charset.decode_body(F.col("body"), F.col("declared")).alias("c"),
        F.expr("decode_body(body, declared)").alias("s"),
        charset.detect_charset(F.col("body")).alias("d"),
        F.expr("detect_charset(body)").alias("e"),
    )
    assert both.filter("NOT c <=> s OR NOT d <=> e").count() == 0
    hosts = [None, "", "localhost", "::1", "8.8.8.8", "192.0.0.9", "192.0.0.8", "256.1.1.1", "01.2.3.4", "2001:4860::1", "fe80::1", "x:y"]
    table = spark.createDataFrame([(h,) for h in hosts], "h string")
    both = table.select(
        nets.is_public_host(F.col("h")).alias("c"), F.expr("is_public_host(h)").alias("s"),
        nets.is_public_ip("h").alias("d"), F.expr("is_public_ip(h)").alias("e"),
    )
    assert both.filter("NOT c <=> s OR NOT d <=> e").count() == 0


CHUNK = "url string, chunk_number int, content string, content_hash string, fetched_at timestamp"


def test_kept_table_says_which_copy_survives(spark, tmp_path, monkeypatch):
    """Of a batch the first by URL and number, ties and nulls included; a batch that is run
    again replaces its rows; a stopped stream goes on from its checkpoint."""
    monkeypatch.setattr(kept, "COMPACT", 2)
    rng = random.Random(3)
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    batches = []
    for _ in range(6):
        batches.append([
            (f"u{rng.randrange(9)}", rng.randrange(4), text, text, None)
            for text in (rng.choice(["hot", "hot", None, *"abcdefghij"]) for _ in range(40))
        ])
    want, seen = [], set()
    for rows in batches:
        arrive(spark, source, rows, CHUNK)
        stream = spark.readStream.schema(CHUNK).parquet(source)
        kept.dedup_table_stream(stream, out, checkpoint=mark).awaitTermination()
        for value in {r[3] for r in rows} - seen:
            want.append(min((r for r in rows if r[3] == value), key=lambda r: r[:2]))
        seen |= {r[3] for r in rows}
    got = [tuple(r) for r in kept.read_kept(stream, out).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == 12
    step = kept._Step(out, f"{mark}/known", "content_hash", ("url", "chunk_number"), None, "fetched_at")
    step(spark.createDataFrame(batches[5], CHUNK), 5)
    assert sorted(map(tuple, kept.read_kept(stream, out).collect()), key=repr) == sorted(want, key=repr)


def test_kept_table_stays_flat_over_repeats(spark, tmp_path, monkeypatch):
    """Ten batches of the same contents, and ten of new ones, of which only those of the
    last two days are remembered."""
    monkeypatch.setattr(kept, "COMPACT", 1)
    day = datetime(2024, 1, 1)
    step = kept._Step(str(tmp_path / "out"), str(tmp_path / "known"), "content_hash", ("url",), "2 days", "fetched_at")
    sizes = []
    for batch in range(20):
        name = "same" if batch < 10 else f"new{batch}"
        at = day + timedelta(hours=batch if batch < 10 else 24 * batch)
        rows = [(f"u{i}", i, f"{name}{i % 50}", f"{name}{i % 50}", at) for i in range(200)]
        step(spark.createDataFrame(rows, CHUNK), batch)
        sizes.append(spark.read.parquet(f"{step.known}/batch={batch}").count())
    assert set(sizes[:10]) == {50} and set(sizes[12:]) == {100}
    out = spark.read.schema(f"{CHUNK}, batch int").parquet(step.path)
    assert {r[0]: r[1] for r in out.groupBy("batch").count().collect()} == {b: 50 for b in (0, *range(10, 20))}
    # Forgotten contents pass again, those remembered do not.
    rows = [("z", 1, n, n, day + timedelta(days=19)) for n in ("same7", "new191")]
    step(spark.createDataFrame(rows, CHUNK), 20)
    again = spark.read.schema(f"{CHUNK}, batch int").parquet(step.path).filter("batch = 20")
    assert [r["content"] for r in again.collect()] == ["same7"]


def test_kept_table_of_an_empty_batch(spark, tmp_path):
    step = kept._Step(str(tmp_path / "out"), str(tmp_path / "known"), "content_hash", ("url",), "1 day", "fetched_at")
    step(spark.createDataFrame([], CHUNK), 0)
    step(spark.createDataFrame([("u", 1, "a", "a", None)], CHUNK), 1)
    step(spark.createDataFrame([], CHUNK), 2)
    assert spark.read.schema(CHUNK).parquet(step.path).count() == 1
