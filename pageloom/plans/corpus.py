"""From seeds and page snapshots to an exported chunk table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.nets import LOCAL_NAMES, is_public_host, public_literal
from pageloom.functions.text import chunk_text
from pageloom.functions.urls import EXCLUDED_PROTOCOLS, WEB_SCHEMES, netloc
from pageloom.operators.chunks import (
    chunk_pages,
    dedup_chunks,
    export_chunks,
    hash_chunks,
    page_contents,
    page_texts,
)
from pageloom.operators.graph import crawl, drop_visited, reach, visitable
from pageloom.operators.hosts import resolved_host_check
from pageloom.operators.links import followed
from pageloom.operators.reports import run_summary
from pageloom.session import materialize, scratch_path
from pageloom.sources.pages import PAGES


def pages_to_chunks(
    pages: DataFrame, split_length: int | None = 2000, parsed: bool = True
) -> DataFrame:
    """Export records of a page table, without crawling."""
    return export_chunks(dedup_chunks(chunk_pages(pages, split_length, parsed)))


class _Fetched:
    """A fetch callable that asks for each URL once and keeps what came back."""

    def __init__(self, spark: SparkSession, fetch: Callable[[DataFrame], DataFrame]):
        self.spark, self.fetch = spark, fetch
        self.asked, self.pages = scratch_path(spark, "asked"), scratch_path(spark, "fetched")
        self.calls = 0

    def __call__(self, urls: DataFrame) -> DataFrame:
        asked, pages = f"{self.asked}/call={self.calls}", f"{self.pages}/call={self.calls}"
        self.calls += 1
        urls.select("url").write.parquet(asked)
        wanted = self.spark.read.schema("url string").parquet(asked)
        self.fetch(wanted).select("url", "html").write.parquet(pages)
        return self.spark.read.schema(PAGES).parquet(pages)

    def all_pages(self, urls: DataFrame) -> DataFrame:
        """Pages of ``urls`` and of all URLs asked for before."""
        before = self.spark.read.schema("url string").parquet(self.asked)
        self(drop_visited(urls.select("url"), before))
        return self.spark.read.schema(PAGES).parquet(self.pages)


@dataclass(frozen=True)
class CrawlRun:
    """What one crawl left, read from written tables: ``found`` (url, depth), ``texts`` (url,
    text) of the pages that came back, ``chunks`` with all copies and ``kept`` with each
    content once."""

    found: DataFrame
    texts: DataFrame
    chunks: DataFrame
    kept: DataFrame

    def records(self) -> DataFrame:
        """The export records."""
        return export_chunks(self.kept)

    def totals(self) -> DataFrame:
        """Per site and over all (site NULL): URLs found, processed and failed, chunks
        written, duplicates dropped and the deepest level. Counts the written tables; nothing
        is crawled or read again."""
        done = self.texts.select("url").distinct().withColumn("outcome", F.lit("processed"))
        looked_up = self.found.join(done, "url", "left").withColumn("outcome", F.coalesce("outcome", F.lit("failed")))
        per_site = run_summary(looked_up, self.chunks, self.kept)
        deepest = self.found.groupBy(netloc(F.col("url")).alias("site")).agg(F.max("depth").alias("deepest"))
        sums = [c for c in per_site.columns if c != "site"]
        return (
            per_site.join(deepest, "site", "left")
            .rollup("site")
            .agg(*[F.sum(c).alias(c) for c in sums], F.max("deepest").alias("deepest"))
        )


def _private(host: str, dns: DataFrame | None) -> bool:
    """Whether the table resolves this one host to an address that is not public."""
    if dns is None:
        return False
    answers = dns.filter(F.lower("host") == host.lower())
    return not answers.filter(~is_public_host(F.col("ip"))).isEmpty()


def crawl_run(
    spark: SparkSession,
    domain: str,
    pages: DataFrame | None = None,
    fetch: Callable[[DataFrame], DataFrame] | None = None,
    max_depth: int | None = 3,
    include_keywords: Sequence[str] | None = None,
    exclude_keywords: Sequence[str] | None = None,
    start_with: str | None = None,
    split_length: int | None = 2000,
    excluded_protocols: Sequence[str] | None = EXCLUDED_PROTOCOLS,
    site_match: str = "contains",
    include_seed: bool = False,
    check_host: bool = True,
    parsed: bool = True,
    max_levels: int | None = None,
    dns: DataFrame | None = None,
) -> CrawlRun:
    """Crawl one site from ``domain``: text of every found page, cut, hashed, deduplicated. A
    ``fetch`` callable is asked for each URL once.

    ``dns`` (host, ip) is a table of resolved names. A domain that resolves to a private
    address is refused, and links to hosts that do are not followed. A host it does not know
    passes, as one that can't be resolved does.
    """
    if split_length is not None and split_length < 1:
        raise ValueError("a chunk needs at least one character")
    parts = urlsplit(domain)
    if parts.scheme not in WEB_SCHEMES or not parts.netloc:
        raise ValueError("domain must be an http or https URL with a host")
    host = parts.hostname or ""
    if check_host and (host in LOCAL_NAMES or not public_literal(host) or _private(host, dns)):
        raise ValueError("domain is a local, private or reserved host")
    seeds = spark.createDataFrame([(domain,)], "url string")
    filters = dict(
        site=parts.netloc,
        start_with=start_with,
        include_keywords=include_keywords,
        exclude_keywords=exclude_keywords,
        excluded_protocols=excluded_protocols,
        site_match=site_match,
    )
    if (pages is None) == (fetch is None):
        raise ValueError("give either pages or fetch")

    def resolvable(edges: DataFrame) -> DataFrame:
        if dns is None or not check_host:
            return edges
        return resolved_host_check(edges, dns, "dst").select("src", "dst")

    if fetch:
        fetch = _Fetched(spark, fetch)
        found = crawl(
            seeds, None, fetch, max_depth, max_levels, include_seed, parsed, keep=resolvable, **filters
        )
        texts = materialize(page_texts(fetch.all_pages(found), parsed), "texts")
    else:
        # HTML is read and parsed once: links and text come from the same pass.
        read = materialize(page_contents(visitable(pages, seeds, **filters), parsed), "contents")
        hrefs = read.select("url", F.explode("hrefs").alias("href"))
        edges = materialize(resolvable(followed(hrefs, **filters)), "edges")
        found = reach(edges, seeds, max_depth, max_levels, include_seed)
        texts = read.select("url", "text")
    texts = texts.join(found.select("url"), "url", "left_semi")
    chunks = hash_chunks(chunk_text(texts, "text", split_length))
    return CrawlRun(found, texts, chunks, dedup_chunks(chunks))


def crawl_to_chunks(spark: SparkSession, domain: str, *args, **options) -> DataFrame:
    """The export records of ``crawl_run``, which takes the same arguments: text of every
    found page, cut, deduplicated and sanitised."""
    return crawl_run(spark, domain, *args, **options).records()
