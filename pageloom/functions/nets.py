"""IP address literals."""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Names and IPv4 ranges that are not on the public Internet, and
# the two addresses inside one of them that are.
LOCAL_NAMES = ("localhost", "127.0.0.1", "0.0.0.0", "::1")
RESERVED_V4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.0.170/31",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
    "255.255.255.255/32",
)
PUBLIC_V4 = ("192.0.0.9/32", "192.0.0.10/32")
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"^{OCTET}(\.{OCTET}){{3}}$"


def bounds(blocks: tuple[str, ...]) -> list[tuple[int, int]]:
    """First and last address of each block as numbers."""
    nets = [ipaddress.ip_network(b) for b in blocks]
    return [(int(n.network_address), int(n.broadcast_address)) for n in nets]


def ipv4_number(ip: Column) -> Column:
    """Dotted address as bigint; NULL for anything else (leading zeros included)."""
    number = F.aggregate(
        F.split(ip, r"\."),
        F.lit(0).cast("bigint"),
        lambda so_far, octet: so_far * 256 + octet.cast("bigint"),
    )
    return F.when(ip.rlike(DOTTED), number)


def _within(number: Column, blocks: tuple[str, ...]) -> Column:
    return reduce(or_, [number.between(lo, hi) for lo, hi in bounds(blocks)])


def is_reserved_v4(number: Column) -> Column:
    """The address lies in a private, loopback or reserved range. The ranges are
    constants of the expression, so no join is needed; ``exists`` over one element
    names the number, which would else be worked out anew for every range."""
    return F.exists(
        F.array(number), lambda n: _within(n, RESERVED_V4) & ~_within(n, PUBLIC_V4)
    )


def public_literal(text: str) -> bool:
    """False for private, loopback and reserved address literals."""
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return True
    return not (address.is_private or address.is_loopback or address.is_reserved)


@F.pandas_udf(BooleanType())
def is_public_ip(ip: pd.Series) -> pd.Series:
    """False for private, loopback and reserved literals; True for the rest,
    including text that is no address."""
    return ip.map(public_literal, na_action="ignore")


@F.pandas_udf(BooleanType())
def is_private_ip(ip: pd.Series) -> pd.Series:
    """True for private and loopback literals, False for text that is no address."""

    def private(text):
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return False
        return address.is_private or address.is_loopback

    return ip.map(private, na_action="ignore")


def is_public_host(host: Column) -> Column:
    """Host names and public addresses. Only hosts with a colon (IPv6) reach the
    Python worker; all else sends NULL."""
    v6 = host.contains(":")
    return (
        F.when(host.isNull(), F.lit(True))
        .when(host.isin(*LOCAL_NAMES), F.lit(False))
        .when(v6, is_public_ip(F.when(v6, host)))
        .otherwise(~F.coalesce(is_reserved_v4(ipv4_number(host)), F.lit(False)))
    )
