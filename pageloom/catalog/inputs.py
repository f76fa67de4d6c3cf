"""Inputs of the registered queries: the given tables, whole, and tables that
Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators.links import build_edges
from pageloom.sources.pages import read_pages, spread_splits


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pages(spark, folder) -> DataFrame:
    return spread_splits(read_pages(spark, f"{folder}/pages.parquet"))


def edges(spark, folder) -> DataFrame:
    return build_edges(pages(spark, folder))


def linked(spark, folder) -> DataFrame:
    """(url) of every link target, with the variants filters look at."""
    dst = F.col("dst")
    variants = F.array(
        dst,
        F.replace(dst, F.lit("/a"), F.lit("/login/a")),
        F.concat(F.lit("mailto:"), dst),
        F.concat(F.lit("tel:"), dst),
    )
    found = edges(spark, folder)
    return found.select(F.explode(variants).alias("url")).distinct()


def events(spark, folder) -> DataFrame:
    return table(spark, folder, "events")


def log(spark, folder) -> DataFrame:
    """The events as a log of requests per user, no more columns than needed."""
    return events(spark, folder).select("user_id", "event_id", "ts", "event_type")


def failed() -> Column:
    return F.col("event_type") == "error"


def attempts(spark, folder) -> DataFrame:
    """The events read as a fetch log: five in a row are the attempts of one URL."""
    fetch = F.expr("event_id div 5")
    kind, number = F.col("event_type"), F.col("event_id")
    return (
        events(spark, folder)
        .withColumn("host", F.concat(F.lit("h"), (fetch % 150).cast("string"), F.lit(".example")))
        .select(
            "host",
            F.concat(F.lit("http://"), F.col("host"), F.lit("/"), fetch.cast("string")).alias("url"),
            (number % 5).cast("int").alias("attempt"),
            "ts",
            F.when(kind == "signup", 429)
            .when(kind == "error", 500)
            .when(kind != "view", 200)
            .alias("status"),
            F.when(
                kind == "view", F.when(number % 7 == 0, "unexpected").otherwise("timeout")
            ).alias("error_kind"),
            F.when(
                kind == "signup",
                F.when(number % 3 == 0, F.get_json_object("props", "$.k")).when(
                    number % 11 == 1, "1.5"
                ),
            ).alias("retry_after"),
            "event_id",
        )
    )


def targets(spark, folder) -> DataFrame:
    """(event_id, host, url): hosts of many kinds derived from the events."""
    n, u = F.col("event_id"), F.col("user_id")

    def dotted(*parts) -> Column:
        return F.concat_ws(".", *[(F.lit(p) if isinstance(p, int) else p).cast("string") for p in parts])

    host = (
        F.when(n % 8 == 0, dotted(10, u % 256, n % 256, 1))
        .when(n % 8 == 1, dotted(192, 0, 0, n % 256))
        .when(n % 8 == 2, dotted(172, u % 64, n % 256, 9))
        .when(n % 8 == 3, dotted(n % 256, u % 256, n % 199, u % 99))
        .when(n % 8 == 4, dotted(198, 16 + u % 8, n % 256, 7))
        .when(n % 8 == 5, F.concat(F.lit("h"), u.cast("string"), F.lit(".example")))
        .when(n % 8 == 6, F.concat(F.lit("fe80::"), F.lower(F.hex(n % 65536))))
        .otherwise(F.concat(F.lit("2001:4860::"), F.lower(F.hex(n % 65536))))
    )
    shown = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    return events(spark, folder).select(
        "event_id",
        host.alias("host"),
        F.concat(F.lit("http://"), shown, F.lit("/"), n.cast("string")).alias("url"),
    )


def escape(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


SITE = "https://docs.example"


def document_site(spark, folder) -> DataFrame:
    """The documents as one web site: page k links to pages 2k+1 and 2k+2, home,
    another site and a mail address."""
    k = F.col("doc_id")

    def anchor(href: Column) -> Column:
        return F.concat(F.lit('<a href="'), href, F.lit('">x</a>'))

    nav = F.concat(
        anchor(F.concat(F.lit("/doc/"), (2 * k + 1).cast("string"))),
        anchor(F.concat(F.lit("../doc/"), (2 * k + 2).cast("string"))),
        anchor(F.lit("/doc/0")),
        anchor(F.concat(F.lit("https://elsewhere.test/"), k.cast("string"))),
        anchor(F.lit("mailto:docs@docs.example")),
    )
    return spread_splits(table(spark, folder, "documents")).select(
        F.concat(F.lit(f"{SITE}/doc/"), k.cast("string")).alias("url"),
        F.concat(
            F.lit("<html><head><title>"), "source", F.lit("</title></head><body><nav>"),
            nav, F.lit("</nav><p>"), escape(F.col("text")), F.lit("</p></body></html>"),
        ).alias("html"),
    )


def document_fetches(spark, folder) -> DataFrame:
    """The document site as outcomes of fetches: from page 300 on, four of five fail."""
    k = F.regexp_extract("url", r"([0-9]+)$", 1).cast("bigint")
    failing = (k > 300) & (k % 5 != 0)
    return document_site(spark, folder).select("url", "html", failing.alias("failed"), (k * 7919 % 1000).alias("ts"))


def supply_graph(spark, folder) -> DataFrame:
    """Parts and suppliers of all line items, linked both ways."""
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    supplier = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    one = table(spark, folder, "lineitem").select(part.alias("src"), supplier.alias("dst")).distinct()
    return one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def raw_pages(spark, folder) -> DataFrame:
    """Page bodies in several encodings, declared or not."""
    n = F.col("page_id")
    html = F.col("html")
    latin = F.regexp_replace(html, r"[^\x00-\x7F]", "é")
    body = (
        F.when(n % 4 == 0, F.encode(html, "UTF-8"))
        .when(n % 4 == 1, F.encode(html, "UTF-16"))
        .when(n % 4 == 2, F.encode(html, "UTF-16LE"))
        .otherwise(F.encode(latin, "ISO-8859-1"))
    )
    charset = F.when(n % 4 == 2, "utf-16-le").when(n % 8 == 3, "windows-1252").when(
        n % 8 == 4, "no-such-charset"
    )
    return spread_splits(table(spark, folder, "pages")).select(
        "page_id", "url", body.alias("body"), charset.alias("charset"), F.lit(200).alias("status")
    )
