"""One query per operator: name -> callable(spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.catalog import inputs as given
from pageloom.functions import charset, html, nets, retry, sql, text, urls
from pageloom.operators import chunks, graph, health, hosts, links, reports, sites
from pageloom.plans.corpus import crawl_run, crawl_to_chunks, pages_to_chunks
from pageloom.session import materialize, scratch_path
from pageloom.sources import pages as sources
from pageloom.sources import sinks
from pageloom.streaming import breaker, jobs, kept

SITE = "example.com"
WIDTH = 200
POOL = ["proxy-a", "proxy-b", "proxy-c"]
KEY, ORDER = ["user_id"], ["ts", "event_id"]
RULES = health.BreakerRules(failure_threshold=2, recovery_timeout=86400.0)
CALM = health.BreakerRules(failure_threshold=4, failure_rate=0.3)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- sources and sinks -------------------------------------------------------


@query
def read_pages(spark, folder):
    return sources.read_pages(spark, f"{folder}/pages.parquet")


@contextmanager
def _stream_settings(spark):
    """State stores on RocksDB."""
    names = (
        "spark.sql.streaming.stateStore.providerClass",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled",
    )
    old = {n: spark.conf.get(n, None) for n in names}
    jobs.use_rocksdb(spark)
    try:
        yield
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what its source holds and read the written table."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    with _stream_settings(spark):
        sinks.write_chunks_stream(stream, path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _stream_path(folder: str, name: str) -> str:
    """A pattern, since a stream takes a single file only by one."""
    return f"{folder}/[{name[0]}]{name[1:]}.parquet"


def _page_stream(spark, folder):
    return sources.read_pages_stream(spark, _stream_path(folder, "pages"))


@query
def read_pages_stream(spark, folder):
    return _drain(_page_stream(spark, folder), "pages")


def _page_chunks(spark, folder, width=WIDTH):
    return chunks.chunk_pages(given.pages(spark, folder), width)


@query
def write_chunks_csv(spark, folder):
    path = scratch_path(spark, "csv")
    docs = given.table(spark, folder, "documents").select(
        F.concat(F.lit("=doc:"), F.col("doc_id").cast("string")).alias("url"), "text"
    )
    sinks.write_chunks_csv(text.chunk_text(docs, "text", WIDTH), path)
    return sinks.read_chunks_csv(spark, path)


@query
def write_chunks_by_site(spark, folder):
    path = scratch_path(spark, "by-site")
    sinks.write_chunks_by_site(_page_chunks(spark, folder), path)
    written = spark.read.schema(
        "url string, chunk_number int, content string, content_hash string, site string"
    ).parquet(path)
    return written.select("site", "url", "chunk_number", "content")


@query
def write_site_buckets(spark, folder):
    path = scratch_path(spark, "site-buckets")
    sinks.write_site_buckets(_page_chunks(spark, folder), path, 8)
    return sinks.site_manifest(spark, path).groupBy("site").agg(F.sum("chunks").alias("chunks"))


@query
def write_chunks_stream(spark, folder):
    stream = jobs.extract_stream(_page_stream(spark, folder), WIDTH)
    return _drain(stream, "chunks").select("url", "chunk_number", "content")


# --- scalar functions --------------------------------------------------------


@query
def decode_body(spark, folder):
    body = charset.decode_body(F.col("body"), F.col("charset"))
    return given.raw_pages(spark, folder).select("page_id", body.alias("html"))


@query
def detect_charset(spark, folder):
    return given.raw_pages(spark, folder).select(
        "page_id", charset.detect_charset(F.col("body")).alias("detected")
    )


@query
def html_to_text(spark, folder):
    return given.pages(spark, folder).select(
        "url", html.html_to_text(F.col("html")).alias("text")
    )


@query
def html_to_text_parsed(spark, folder):
    return given.pages(spark, folder).select(
        "url", html.html_to_text_parsed("html").alias("text")
    )


def _dressed(spark, folder):
    """Pages with markup that real sites have: custom elements named like dropped ones,
    a dropped element closed by its parent, named and windows-1252 references, and an
    href inside another attribute."""
    before = (
        "<nav-bar>menu</nav-bar><header-x>&eacute;</header-x><p>caf&eacute; &uuml; it&#146;s "
        "1&#150;2</p><div><nav>gone</div>open <a title='my href=/bad > x' href='/good'></a>"
        "<style-guide></style-guide><a href='/caf&eacute;'></a><a class=k href=/kept></a>"
    )
    return given.pages(spark, folder).select("url", F.concat(F.lit(before), "html").alias("html"))


@query
def html_to_text_dressed(spark, folder):
    return _dressed(spark, folder).select("url", html.html_to_text_parsed("html").alias("text"))


@query
def extract_links_dressed(spark, folder):
    return links.extract_links(_dressed(spark, folder))


@query
def strip_elements(spark, folder):
    return given.pages(spark, folder).select(
        "url", html.strip_elements(F.col("html")).alias("rest")
    )


@query
def normalize_ws(spark, folder):
    docs = _documents(spark, folder)
    spaced = F.concat(F.lit("  \x1c"), F.replace("text", F.lit(" "), F.lit("  \x85")))
    return docs.select(
        "doc_id",
        text.normalize_ws(F.col("text")).alias("text"),
        text.normalize_ws(spaced).alias("from_spaced"),
    )


@query
def extract_links(spark, folder):
    return links.extract_links(given.pages(spark, folder), parsed=False)


@query
def extract_links_parsed(spark, folder):
    return links.extract_links(given.pages(spark, folder), parsed=True)


@query
def html_links(spark, folder):
    sql.register(spark)
    return spark.sql(
        "SELECT url, href FROM {pages}, LATERAL html_links(html)",
        pages=given.pages(spark, folder),
    )


def _link_forms():
    word = F.regexp_replace("href", r"[^A-Za-z]", "")
    return {
        "rooted": F.col("href"),
        "plain": F.concat(word, F.lit("x")),
        "query": F.concat(F.lit("?"), word, F.lit("x")),
        "fragment": F.concat(F.lit("#"), word, F.lit("x")),
        "host": F.concat(F.lit("//"), word, F.lit("x.test/a")),
        "absolute": F.concat(F.lit("http://"), word, F.lit("x.test/a")),
        "mail": F.concat(F.lit("mailto:"), word),
        "parent": F.concat(F.lit("../"), word, F.lit("x")),
        "empty": F.lit(""),
    }


@query
def resolve_url(spark, folder):
    found = links.extract_links(given.pages(spark, folder))
    return found.select(
        "url",
        "href",
        *[urls.resolve_url(F.col("url"), form).alias(name) for name, form in _link_forms().items()],
    )


@query
def resolve_url_sql(spark, folder):
    sql.register(spark)
    found = links.extract_links(given.pages(spark, folder))
    written = found.select("url", "href", *[form.alias(f"as_{name}") for name, form in _link_forms().items()])
    resolved = ", ".join(f"resolve_url(url, as_{name}) AS {name}" for name in _link_forms())
    return spark.sql(f"SELECT url, href, {resolved} FROM {{found}}", found=written)


@query
def html_to_text_sql(spark, folder):
    sql.register(spark)
    return spark.sql("SELECT url, html_to_text(html) AS text FROM {pages}", pages=given.pages(spark, folder))


@query
def decode_body_sql(spark, folder):
    sql.register(spark)
    return spark.sql(
        "SELECT page_id, decode_body(body, charset) AS html FROM {raw}", raw=given.raw_pages(spark, folder)
    )


@query
def detect_charset_sql(spark, folder):
    sql.register(spark)
    return spark.sql(
        "SELECT page_id, detect_charset(body) AS detected FROM {raw}", raw=given.raw_pages(spark, folder)
    )


@query
def is_public_ip_sql(spark, folder):
    sql.register(spark)
    return spark.sql(
        "SELECT event_id, is_public_host(host) AS native, is_public_ip(host) AS parsed FROM {targets}",
        targets=given.targets(spark, folder),
    )


@query
def url_parts(spark, folder):
    given_urls = given.pages(spark, folder).select("url")
    dressed = given_urls.select(
        F.explode(
            F.array(
                F.col("url"),
                F.regexp_replace(F.col("url"), "://", "://Me:pw@"),
                F.regexp_replace(F.col("url"), "(//[^/]+)", "$1:8080"),
                F.upper(F.col("url")),
                F.regexp_replace(F.col("url"), "^.*?//[^/]+", ""),
            )
        ).alias("url")
    )
    return dressed.select("url", F.inline(F.array(urls.url_parts(F.col("url")))))


def _documents(spark, folder):
    return given.spread_splits(given.table(spark, folder, "documents")).select("doc_id", "text")


@query
def chunk_text(spark, folder):
    return text.chunk_text(_documents(spark, folder), "text", WIDTH)


@query
def chunk_number(spark, folder):
    cut = text.chunk_text(_documents(spark, folder), "text", 2000)
    return cut.groupBy("doc_id").agg(
        F.min("chunk_number").alias("first_number"),
        F.max("chunk_number").alias("last_number"),
        F.count("*").alias("chunks"),
    )


@query
def content_hash(spark, folder):
    cut = text.chunk_text(_documents(spark, folder), "text", 2000)
    return chunks.hash_chunks(cut).drop("content")


@query
def drop_empty_chunk(spark, folder):
    talks = given.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") != "user", F.col("text")).otherwise("").alias("text")
    )
    return text.chunk_text(talks, "text", WIDTH)


@query
def sanitize_cell(spark, folder):
    starts = F.array(*map(F.lit, ["=", "+", "-", "@", "\t", "\r", "a=", " =", ""]))
    start = F.get(starts, (F.col("doc_id") % 9).cast("int"))
    cell = F.concat(start, "text")
    return given.table(spark, folder, "documents").select(
        "doc_id", text.sanitize_cell(cell).alias("cell")
    )


@query
def safe_dir_name(spark, folder):
    found = given.pages(spark, folder).select(urls.netloc(F.col("url")).alias("netloc")).distinct()
    names = F.col("netloc")
    return found.select(
        "netloc",
        urls.safe_dir_name(names).alias("name"),
        urls.safe_dir_name(F.concat(F.lit("..é "), names, F.lit(":80"))).alias("dressed"),
        urls.safe_dir_name(F.regexp_replace(names, ".", ".")).alias("dots"),
    )


@query
def gateway_url(spark, folder):
    target = F.concat(F.col("url"), F.lit("&x=é ~*"))
    return given.pages(spark, folder).select(
        "url",
        urls.gateway_url(target, "http://gateway.test").alias("plain"),
        urls.gateway_url(
            target, "http://gateway.test", render_js=True, country="us", premium=True
        ).alias("flagged"),
    )


@query
def backoff_delay(spark, folder):
    return given.attempts(spark, folder).select(
        "event_id", retry.backoff_delay(F.col("attempt"), 1.5, jitter=False).alias("delay")
    )


@query
def retry_after_delay(spark, folder):
    return given.attempts(spark, folder).select(
        "event_id", retry.retry_after_delay(F.col("retry_after"), 2.5).alias("delay")
    )


# --- filters -----------------------------------------------------------------


@query
def filter_prefix(spark, folder):
    return given.linked(spark, folder).filter(urls.filter_prefix(F.col("url"), "https://www."))


@query
def filter_exclude(spark, folder):
    return given.linked(spark, folder).filter(urls.filter_exclude(F.col("url"), ["login", "/the"]))


@query
def filter_include(spark, folder):
    return given.linked(spark, folder).filter(urls.filter_include(F.col("url"), ["login", "/th"]))


@query
def filter_protocol(spark, folder):
    return given.linked(spark, folder).filter(urls.filter_protocol(F.col("url")))


@query
def filter_same_site(spark, folder):
    found = given.linked(spark, folder)
    return found.select(
        "url",
        *[
            urls.filter_same_site(F.col("url"), SITE, m).alias(m)
            for m in ("contains", "suffix", "exact")
        ],
    )


RULE_SET = {
    "site": SITE,
    "start_with": "http",
    "include_keywords": ["/t", "login"],
    "exclude_keywords": ["spam", "tion"],
}


@query
def should_follow(spark, folder):
    return sites.follow(given.linked(spark, folder), **RULE_SET)


@query
def filter_valid_target(spark, folder):
    url = F.col("url")
    forms = F.array(
        url,
        F.replace(url, F.lit("://"), F.lit(":///")),
        F.replace(url, F.lit("http"), F.lit("HTTP")),
        F.replace(url, F.lit("http"), F.lit("ftp")),
        F.regexp_replace(url, "^[a-z]+:", ""),
        F.regexp_replace(url, "^([a-z]+://).*$", "$1?q"),
    )
    found = given.linked(spark, folder).select(F.explode(forms).alias("url")).distinct()
    return found.filter(urls.filter_valid_target(url))


@query
def filter_public_host(spark, folder):
    return hosts.filter_public_host(given.targets(spark, folder))


@query
def drop_failed(spark, folder):
    looked_up = sites.fetch_lookup(_all_urls(spark, folder), given.pages(spark, folder))
    return chunks.drop_failed(looked_up).select("url")


# --- joins -------------------------------------------------------------------


def _page_urls(spark, folder):
    return given.pages(spark, folder).select("url")


def _all_urls(spark, folder):
    return graph.urls_union(
        links.distinct_links(given.edges(spark, folder)), _page_urls(spark, folder)
    )


@query
def fetch_lookup(spark, folder):
    pages = given.pages(spark, folder).withColumn("size", F.length("html").cast("bigint"))
    return sites.fetch_lookup(_all_urls(spark, folder), pages, keep=["size"])


@query
def expand_frontier(spark, folder):
    """Links of all pages, and suppliers of all parts: that graph links back, and the
    frontier is one side of it."""
    edges = given.edges(spark, folder).union(given.supply_graph(spark, folder))
    parts = given.table(spark, folder, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("url")
    )
    return graph.expand_frontier(graph.urls_union(_page_urls(spark, folder), parts), edges)


@query
def drop_visited(spark, folder):
    found = links.distinct_links(given.supply_graph(spark, folder))
    suppliers = given.table(spark, folder, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("url")
    )
    return graph.drop_visited(found, suppliers)


@query
def cidr_match(spark, folder):
    found = given.targets(spark, folder).select("event_id", "host")
    return hosts.cidr_match(found, hosts.cidr_blocks(spark))


@query
def resolved_host_check(spark, folder):
    n = F.length("host")
    answers = _page_urls(spark, folder).select(urls.hostname(F.col("url")).alias("host")).distinct()
    ip = (
        F.when(n % 4 == 0, F.concat(F.lit("10.0.0."), n.cast("string")))
        .when(n % 4 == 1, F.concat(F.lit("8.8.8."), n.cast("string")))
        .when(n % 4 == 2, "::1")
    )
    return hosts.resolved_host_check(
        _page_urls(spark, folder), answers.select("host", ip.alias("ip")).filter("ip IS NOT NULL")
    )


def _sites(spark, folder):
    """Every last-two-labels domain and every authority of the pages is a site."""
    where = urls.netloc(F.col("url"))
    return _page_urls(spark, folder).select(
        F.explode(F.array(where, F.regexp_extract(where, r"[^.]+\.[^.]+$", 0))).alias("site")
    ).distinct()


@query
def assign_site(spark, folder):
    return sites.assign_site(_page_urls(spark, folder), _sites(spark, folder))


@query
def follow_by_site(spark, folder):
    none = F.array().cast("array<string>")
    plans = _sites(spark, folder).select(
        "site",
        F.when(F.length("site") % 2 == 0, "https://").alias("start_with"),
        F.when(F.length("site") % 3 == 0, F.array(F.lit("/th"), F.lit("login"))).otherwise(none).alias("include"),
        F.when(F.length("site") % 5 == 0, F.array(F.lit("tion"))).alias("exclude"),
        F.array(*map(F.lit, urls.EXCLUDED_PROTOCOLS)).alias("excluded_protocols"),
    )
    return sites.follow_by_site(given.linked(spark, folder), plans)


# --- aggregations ------------------------------------------------------------


@query
def breaker_stats(spark, folder):
    return health.breaker_stats(given.log(spark, folder), given.failed(), KEY, ORDER, RULES)


@query
def fetch_outcomes(spark, folder):
    return health.fetch_outcomes(given.attempts(spark, folder), max_retries=4, base_delay=1.5)


@query
def status_counts(spark, folder):
    return health.status_counts(given.attempts(spark, folder))


@query
def distinct_links(spark, folder):
    return links.distinct_links(given.edges(spark, folder))


def _document_crawl(spark, folder):
    seeds = spark.createDataFrame([(f"{given.SITE}/doc/0",)], "url string")
    return graph.crawl(
        seeds,
        given.document_site(spark, folder),
        max_depth=None,
        site="docs.example",
        exclude_keywords=["/doc/5"],
    )


@query
def crawl_depth_counts(spark, folder):
    return reports.crawl_depth_counts(_document_crawl(spark, folder))


@query
def run_summary(spark, folder):
    pages = given.pages(spark, folder)
    cut = materialize(chunks.chunk_pages(pages, WIDTH).drop("content"), "chunks")
    looked_up = sites.fetch_lookup(_all_urls(spark, folder), pages, keep=[])
    return reports.run_summary(looked_up, cut, chunks.dedup_chunks(cut))


@query
def content_audit(spark, folder):
    return reports.content_audit(_page_chunks(spark, folder))


# --- windows -----------------------------------------------------------------


@query
def dedup_chunks(spark, folder):
    docs = _documents(spark, folder).select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), "text"
    )
    return chunks.dedup_chunks(chunks.hash_chunks(text.chunk_text(docs, "text", WIDTH)))


@query
def rotate_assign(spark, folder):
    requests = given.targets(spark, folder).select("host", "url")
    return sites.rotate_assign(requests, POOL)


@query
def hash_assign(spark, folder):
    spread = sites.hash_assign(given.targets(spark, folder).select("host", "url"), POOL)
    # The hash is Spark's own, so the twin tells that each URL, though asked for twice, has
    # one proxy of the pool, and that no proxy is left out or takes more than half.
    twice = spread.union(sites.hash_assign(spread.drop("proxy").repartition("host"), POOL))
    one = twice.groupBy("host", "url").agg(
        F.count("*").alias("requests"),
        F.countDistinct("proxy").alias("proxies"),
        F.every(F.col("proxy").isin(POOL)).alias("in_pool"),
        F.min("proxy").alias("proxy"),
    )
    load = materialize(one, "assigned").groupBy("proxy").agg(F.count("*").alias("n"))
    whole = load.agg((F.max("n") * 2 <= F.sum("n")).alias("even"), F.count("*").alias("in_use"))
    # One row.
    return one.drop("proxy").join(F.broadcast(whole))


@query
def failure_streak(spark, folder):
    found = health.failure_streak(given.log(spark, folder), given.failed(), KEY, ORDER)
    return found.select("event_id", "streak")


@query
def failure_rate(spark, folder):
    found = health.failure_rate(given.log(spark, folder), given.failed(), KEY, ORDER)
    return found.select("event_id", "total", "failures", "rate")


@query
def first_trip(spark, folder):
    found = health.first_trip(given.log(spark, folder), given.failed(), KEY, ORDER, CALM)
    return found.drop("ts")


@query
def gate_after_trip(spark, folder):
    log = given.log(spark, folder)
    return health.gate_after_trip(log, given.failed(), KEY, ORDER, CALM).select(
        "user_id", "event_id"
    )


# --- set operations ----------------------------------------------------------


@query
def urls_union(spark, folder):
    return _all_urls(spark, folder)


@query
def urls_except(spark, folder):
    edges = given.supply_graph(spark, folder)
    sources_ = given.table(spark, folder, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("url")
    )
    return graph.urls_except(links.distinct_links(edges), sources_)


# --- graph and whole jobs ----------------------------------------------------


@query
def build_edges(spark, folder):
    return links.build_edges(
        given.pages(spark, folder), site="own", exclude_keywords=["/the"]
    )


@query
def reach(spark, folder):
    edges = materialize(given.supply_graph(spark, folder), "graph")
    seeds = edges.agg(F.min("src").alias("url"))
    return graph.reach(edges, seeds, max_depth=6)


@query
def crawl(spark, folder):
    return _document_crawl(spark, folder)


@query
def crawl_fetch(spark, folder):
    """The same crawl with content from a callable, as a provider would give it."""
    site = given.document_site(spark, folder)
    seeds = spark.createDataFrame([(f"{given.SITE}/doc/0",)], "url string")
    return graph.crawl(
        seeds,
        fetch=lambda asked: site.join(asked, "url", "left_semi"),
        max_depth=None,
        site="docs.example",
    )


@query
def crawl_health(spark, folder):
    """The same site when it starts to fail: the crawl ends where the breaker trips."""
    return graph.crawl(
        spark.createDataFrame([(f"{given.SITE}/doc/0",)], "url string"),
        given.document_fetches(spark, folder),
        max_depth=None,
        breaker=CALM,
        site="docs.example",
    )


def _export(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("URL").alias("record_url"),
        F.col("Content").alias("record_content"),
        F.col("Chunk Number").alias("record_number"),
    )


@query
def crawl_to_chunks(spark, folder, job=crawl_to_chunks):
    records = job(
        spark,
        f"{given.SITE}/doc/0",
        given.document_site(spark, folder),
        max_depth=None,
        exclude_keywords=["/doc/5"],
        split_length=WIDTH,
    )
    return _export(records)


@query
def crawl_totals(spark, folder):
    """Totals of the whole job, from what one crawl wrote."""
    answers = spark.createDataFrame([("docs.example", "93.184.216.34"), ("elsewhere.test", "10.0.0.1")], "host string, ip string")
    run = crawl_run(
        spark,
        f"{given.SITE}/doc/0",
        given.document_site(spark, folder),
        max_depth=None,
        exclude_keywords=["/doc/5"],
        split_length=WIDTH,
        dns=answers,
    )
    return run.totals()


@query
def pages_export(spark, folder):
    return _export(pages_to_chunks(given.pages(spark, folder), 2000))


@query
def breaker_replay(spark, folder):
    found = health.breaker_replay(
        given.log(spark, folder), given.failed(), KEY, ORDER, RULES
    )
    return found.select("user_id", "event_id", "state", "total", "failures", "streak")


# --- streams -----------------------------------------------------------------


@query
def breaker_stream(spark, folder):
    events = given.events(spark, folder)
    log = spark.readStream.schema(events.schema).parquet(_stream_path(folder, "events"))
    path = scratch_path(spark, "breaker-events")
    breaker.breaker_stream(log, given.failed(), "user_id", "ts", "event_id", path, RULES).awaitTermination()
    return breaker.read_breaker(spark, path).select(
        F.col("key").cast("bigint").alias("user_id"),
        F.col("seq").alias("event_id"),
        "late", "state", "total", "failures", "streak",
    )


@query
def extract_stream(spark, folder):
    return _drain(jobs.extract_stream(_page_stream(spark, folder), None), "extracted")


@query
def dedup_stream(spark, folder):
    stream = jobs.extract_stream(_page_stream(spark, folder), WIDTH)
    return _drain(jobs.dedup_stream(stream), "deduped").select("content_hash", "content")


@query
def dedup_table_stream(spark, folder):
    stream = jobs.extract_stream(_page_stream(spark, folder), WIDTH)
    path = scratch_path(spark, "kept-chunks")
    kept.dedup_table_stream(stream, path).awaitTermination()
    return kept.read_kept(stream, path)


@query
def visited_stream(spark, folder):
    stream = links.resolve_links(links.extract_links(_page_stream(spark, folder)))
    targets = stream.select(F.col("dst").alias("url"))
    return _drain(jobs.visited_stream(targets), "visited")


@query
def is_public_ip(spark, folder):
    return given.targets(spark, folder).select(
        "event_id",
        nets.is_public_host(F.col("host")).alias("native"),
        nets.is_public_ip("host").alias("parsed"),
    )
