"""Screening of hosts that are not on the public Internet."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.nets import (
    PUBLIC_V4,
    RESERVED_V4,
    ipv4_number,
    is_private_ip,
    is_public_host,
    is_reserved_v4,
)
from pageloom.functions.urls import hostname
from pageloom.session import once


def cidr_blocks(spark, blocks: list[tuple[str, str]] | None = None) -> DataFrame:
    """(cidr, lo, hi, kind) of IPv4 blocks given as (cidr, kind)."""
    if blocks is None:
        blocks = [(b, "reserved") for b in RESERVED_V4] + [(b, "public") for b in PUBLIC_V4]
    rows = []
    for text, kind in blocks:
        net = ipaddress.IPv4Network(text)
        rows.append((text, int(net.network_address), int(net.broadcast_address), kind))
    return spark.createDataFrame(rows, "cidr string, lo bigint, hi bigint, kind string")


def cidr_match(hosts: DataFrame, blocks: DataFrame, ip: str = "host") -> DataFrame:
    """Left join: each row with the narrowest block that holds its IPv4 literal.

    A CIDR block is the set of addresses with one prefix, so the range test is an
    equality on (size, prefix): each distinct address is looked up once per block
    size in use, at most 33. This needs no broadcast and no pairwise comparison.
    ``blocks`` must be whole CIDR blocks (cidr, lo, hi, kind): other ranges are refused,
    so there are at most 33 sizes.
    """
    size = F.col("hi") - F.col("lo") + 1
    whole = (F.bit_count(size) == 1) & (F.col("lo") % size == 0) & (size <= 1 << 32)
    if not blocks.filter(~F.coalesce(whole & (size > 0), F.lit(False))).isEmpty():
        raise ValueError("blocks must be whole CIDR blocks, aligned to their size")
    sized = blocks.select("cidr", "kind", "lo", (F.col("hi") - F.col("lo") + 1).alias("n"))
    sizes = [r["n"] for r in sized.select("n").distinct().collect()]  # at most 33
    address = ipv4_number(F.col(ip))
    numbers = hosts.select(address.alias("_addr")).filter("_addr IS NOT NULL").distinct()
    tried = numbers.withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes])))
    best = (
        tried.withColumn("lo", F.col("_addr") - F.col("_addr") % F.col("n"))
        .join(sized, ["n", "lo"])
        .groupBy("_addr")
        .agg(F.min(F.struct("n", "cidr", "kind")).alias("_best"))
        .select("_addr", F.col("_best.cidr").alias("cidr"), F.col("_best.kind").alias("kind"))
        if sizes
        else numbers.select(
            "_addr", F.lit(None).cast("string").alias("cidr"), F.lit(None).cast("string").alias("kind")
        )
    )
    # Names have no address. Negative stand-ins match no block and keep these
    # rows spread over all tasks.
    spread = -1 - F.pmod(F.xxhash64(F.col(ip)), F.lit(1 << 31))
    return (
        hosts.withColumn("_addr", F.coalesce(address, spread))
        .join(best, "_addr", "left")
        .drop("_addr")
    )


def filter_public_host(urls: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL names no local, private, loopback or reserved host."""
    hosted = once(urls, "_host", hostname(F.col(url)))
    return hosted.filter(is_public_host(F.col("_host"))).drop("_host")


def resolved_host_check(urls: DataFrame, dns: DataFrame, url: str = "url") -> DataFrame:
    """Drop URLs that a DNS snapshot (host, ip) resolves to a private or loopback
    address. Literals are judged as they are; a host without answer passes."""
    v6 = F.col("ip").contains(":")
    address = ipv4_number(F.col("ip"))
    # Private and loopback only: every reserved IPv4 address is private as well,
    # so the same ranges serve.
    inside = F.when(v6, is_private_ip(F.when(v6, F.col("ip")))).otherwise(
        F.coalesce(is_reserved_v4(address), F.lit(False))
    )
    bad = dns.filter(inside).select(F.col("host").alias("_host")).distinct()
    public = filter_public_host(urls, url).withColumn("_host", hostname(F.col(url)))
    return public.join(bad, "_host", "left_anti").drop("_host")

