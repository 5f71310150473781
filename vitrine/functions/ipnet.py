"""Blocked-network predicate on IP text: pure expressions for IPv4 and IPv6."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, functions as F

from .ladders import let

# Networks that are never fetched.
BLOCKED_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32",
]
BLOCKED_V6 = ["::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8"]
# IPv6 space that the IANA registries mark private or reserved.
RESERVED_V6 = [
    "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20",
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3",
    "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9",
]
# Parts of 2001::/23 that are globally reachable.
GLOBAL_V6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as a long; NULL when the text is not one."""
    part = lambda q, i: F.get(q, F.lit(i)).cast("long")
    number = lambda q: ((part(q, 0) * 256 + part(q, 1)) * 256 + part(q, 2)) * 256 + part(q, 3)
    return F.when(ip.rlike(_V4), let(F.split(ip, r"\."), number))


def _v4_blocked(number: Column) -> Column:
    hit = F.lit(False)
    for net in map(ipaddress.ip_network, BLOCKED_V4):
        hit = hit | number.between(int(net.network_address), int(net.broadcast_address))
    return hit


def ipv6_hex(ip: Column) -> Column:
    """IPv6 text as 32 hex digits (``::`` expanded, IPv4 tail converted); NULL if malformed."""
    bare = F.lower(F.regexp_replace(ip, r"%[^%]+$", ""))
    tail = F.regexp_extract(bare, r":([0-9.]+\.[0-9.]+)$", 1)
    v4 = ipv4_number(tail)
    as_groups = F.concat(
        F.lower(F.hex(F.floor(v4 / F.lit(65536)).cast("long"))), F.lit(":"), F.lower(F.hex(v4 % F.lit(65536)))
    )
    flat = F.when(tail == "", bare).otherwise(F.concat(F.regexp_extract(bare, r"^(.*:)[^:]*$", 1), as_groups))
    halves = F.split(flat, "::", -1)
    groups = lambda s: F.filter(F.split(s, ":", -1), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    missing = F.lit(8) - F.size(left) - F.size(right)
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), missing)), right)
    group = "[0-9a-f]{1,4}"
    side = f"(?:{group}(?::{group})*)?"
    valid = flat.rlike(rf"^(?:{group}(?::{group}){{7}}|{side}::{side})$") & (
        F.when(flat.contains("::"), missing >= 1).otherwise(missing == 0)
    )
    return F.when(valid, F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), ""))


def _v6_in(hex32: Column, networks: list[str]) -> Column:
    hit = F.lit(False)
    for net in map(ipaddress.ip_network, networks):
        low, high = (format(int(a), "032x") for a in (net.network_address, net.broadcast_address))
        hit = hit | hex32.between(low, high)
    return hit


def add_ip_blocked(df: DataFrame, ip: str, flag: str) -> DataFrame:
    """B14. ``flag`` is true for every non-public address and for text that is no address.

    The parsed number and hex form are columns of their own, so each address is
    parsed once however many ranges it is compared with.
    """
    parsed = df.withColumn("_v4", ipv4_number(F.col(ip))).withColumn(
        "_hex", F.when(F.col(ip).contains(":"), ipv6_hex(F.col(ip)))
    )
    mapped = F.when(F.col("_hex").startswith("0" * 20 + "ffff"), F.conv(F.substring("_hex", 25, 8), 16, 10).cast("long"))
    numbered = parsed.withColumn("_num", F.coalesce("_v4", mapped))
    v6 = _v6_in(F.col("_hex"), BLOCKED_V6) | (_v6_in(F.col("_hex"), RESERVED_V6) & ~_v6_in(F.col("_hex"), GLOBAL_V6))
    verdict = F.when(F.col("_num").isNotNull(), _v4_blocked(F.col("_num"))).otherwise(v6)
    return numbered.withColumn(flag, F.coalesce(verdict, F.lit(True))).drop("_v4", "_hex", "_num")


# ---- lists of networks of any length ----------------------------------------------------


def _prefix(version: Column, number: Column, hex32: Column, bits: Column) -> Column:
    """The first ``bits`` bits of an address as text: a number of IPv4, hex digits and a rest of IPv6."""
    nibbles, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    last = F.conv(F.substr(hex32, nibbles + 1, F.lit(1)), 16, 10).cast("int")
    tail = F.when(rest > 0, F.concat(F.lit("."), F.floor(last / F.pow(F.lit(2), F.lit(4) - rest)).cast("string"))).otherwise("")
    v4 = F.floor(number / F.pow(F.lit(2.0), F.lit(32) - bits)).cast("long").cast("string")
    return F.when(version == 4, v4).otherwise(F.concat(F.substr(hex32, F.lit(1), nibbles), tail))


def _parsed(df: DataFrame, ip: Column) -> DataFrame:
    """``_version``, ``_num`` and ``_hex`` of address texts; IPv4 inside IPv6 counts as IPv4, no address has no version."""
    out = df.withColumn("_v4", ipv4_number(ip)).withColumn("_hex", F.when(ip.contains(":"), ipv6_hex(ip)))
    mapped = F.when(F.col("_hex").startswith("0" * 20 + "ffff"), F.conv(F.substring("_hex", 25, 8), 16, 10).cast("long"))
    out = out.withColumn("_num", F.coalesce("_v4", mapped)).drop("_v4")
    return out.withColumn("_version", F.when(F.col("_num").isNotNull(), 4).when(F.col("_hex").isNotNull(), 6))


def add_ip_listed(df: DataFrame, ip: str, flag: str, networks: DataFrame) -> DataFrame:
    """B14 for a table of networks (``cidr``, ``is_blocked``) of any length: the longest network that holds an address decides.

    Each distinct address is cut to the prefix lengths that occur in the list, of which there are 162 at most, and joined
    with the networks on equal prefixes, so no address is compared with every network. An address in no network is not
    blocked, text that is no address is; networks that are malformed are left out, of equal ones a blocking one counts.
    """
    base, bits = F.substring_index("cidr", "/", 1), F.substring_index("cidr", "/", -1).try_cast("int")
    nets = _parsed(networks.withColumn("_base", base), F.col("_base")).withColumn("_bits", bits)
    nets = nets.withColumn("_version", F.when(F.col("_base").contains(":"), F.when(F.col("_hex").isNotNull(), 6)).otherwise(F.col("_version")))
    limit = F.when(F.col("_version") == 4, 32).otherwise(128)
    nets = nets.filter(F.col("_version").isNotNull() & F.col("_bits").between(0, limit) & F.col("cidr").contains("/"))
    nets = nets.groupBy("_version", "_bits", _prefix(F.col("_version"), F.col("_num"), F.col("_hex"), F.col("_bits")).alias("_key")).agg(F.bool_or("is_blocked").alias("_listed"))
    lengths = {4: [], 6: []}
    for r in nets.select("_version", "_bits").distinct().collect():  # 33 + 129 at most
        lengths[r[0]].append(r[1])
    array = lambda v: F.array(*[F.lit(b) for b in sorted(lengths[v])]).cast("array<int>")
    asked = _parsed(df.select(ip).filter(F.col(ip).isNotNull()).distinct(), F.col(ip))
    cut = asked.withColumn("_bits", F.explode_outer(F.when(F.col("_version") == 4, array(4)).when(F.col("_version") == 6, array(6))))
    keyed = cut.withColumn("_key", _prefix(F.col("_version"), F.col("_num"), F.col("_hex"), F.col("_bits")))
    met = keyed.join(nets, ["_version", "_bits", "_key"], "left")
    verdict = met.groupBy(ip).agg(
        F.when(F.any_value("_version").isNull(), True).otherwise(F.coalesce(F.max_by("_listed", F.when(F.col("_listed").isNotNull(), F.col("_bits"))), F.lit(False))).alias(flag)
    )
    return df.join(verdict, ip, "left").withColumn(flag, F.coalesce(flag, F.lit(True)))
