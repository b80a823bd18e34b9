"""IP addresses as numbers, their location and network containment."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake import catalog
from threatlake.functions import text

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = r"^" + _OCTET + r"(?:\." + _OCTET + r"){3}$"

# IPv4 blocks that are not globally reachable (IANA registry):
# 0/8, 10/8, 127/8, 169.254/16, 172.16/12, 192.0.0/24 but .9 and .10,
# 192.0.2/24, 192.168/16, 198.18/15, 198.51.100/24, 203.0.113/24, 240/4.
_PRIVATE_V4 = (
    r"^(?:(?:0|10|127)\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.0\.0\.(?!(?:9|10)$)"
    r"|192\.0\.2\.|192\.168\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|2[45][0-9]\.)"
)
# Fixed value: shared address space 100.64/10.
_SHARED_V4 = r"^100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\."
# The IPv6 blocks, on the 32 hex digits of an address:
# ::/127, 64:ff9b:1::/48, 100::/64, 2001::/23, 2001:db8::/32, 2002::/16,
# fc00::/7, fe80::/10.
_PRIVATE_V6 = (
    r"^(?:0{31}[01]$|0064ff9b0001|0100000000000000|20010[01]|20010db8|2002|f[cd]|fe[89ab])"
)
# Carve-outs 2001:1::1, 2001:1::2, 2001:3::/32, 2001:4:112::/48,
# 2001:20::/28, 2001:30::/28.
_GLOBAL_V6 = r"^(?:200100010{23}[12]$|20010003|200100040112|2001002|2001003)"
_MAPPED_V6 = r"^0{20}ffff"


def ipv4_number(ip: Column) -> Column:
    """IPv4 text as a bigint; NULL when it is not four octets without leading zeros."""
    part = F.split(ip, r"\.")
    octets = [part[i].cast("bigint") for i in range(4)]
    number = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(ip.rlike(_IPV4), number)


def cidr_bounds(network: str) -> tuple[int, int]:
    net = ipaddress.ip_network(network)
    return int(net.network_address), int(net.broadcast_address)


def in_networks(number: Column, networks: tuple[str, ...]) -> Column:
    """Whether an IPv4 number lies in one of a few fixed networks."""
    cond = F.lit(False)
    for network in networks:
        lo, hi = cidr_bounds(network)
        cond = cond | number.between(lo, hi)
    return F.coalesce(cond, F.lit(False))


def _number_text(number: Column) -> Column:
    shifts = [F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *shifts)


def _location_v4(ip: Column) -> Column:
    return F.when(ip.rlike(_PRIVATE_V4), "internal").when(
        ip.rlike(_SHARED_V4), "special").otherwise("external")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _ipv6_digits(ip: Column) -> Column:
    """The 32 hex digits of an IPv6 address, or NULL; text without a colon costs no more than that test."""
    malformed = r":::|::.*::|[0-9a-f]{5}|^:[^:]|[^:]:$"

    def hex_tail(quad: Column) -> Column:
        return F.lower(F.concat(F.hex(F.shiftright(quad, 16)), F.lit(":"), F.hex(quad.bitwiseAND(65535))))

    def without_quad(bare: Column) -> Column:
        # A dotted-quad tail stands for the last two groups.
        return F.when(bare.contains("."), _let(ipv4_number(F.substring_index(bare, ":", -1)), lambda quad: F.concat(
            F.regexp_extract(bare, r"^(.*:)[^:]*$", 1), hex_tail(quad)))).otherwise(bare)

    def padded(written: Column, groups: Column) -> Column:
        complete = F.when(written.contains("::"), groups <= 7).otherwise(groups == 8)
        ok = written.rlike(r"^[0-9a-f:]+$") & ~written.rlike(malformed) & complete
        zeros = F.concat(F.lit(":"), F.repeat(F.lit("0:"), 8 - groups))
        full = F.regexp_replace(F.replace(written, F.lit("::"), zeros), r"([0-9a-f]+)", "000$1")
        return F.when(ok, F.regexp_replace(full, r":?[0-9a-f]*([0-9a-f]{4})(?=:|$):?", "$1"))

    def digits(written: Column) -> Column:
        groups = F.size(F.regexp_extract_all(written, F.lit(r"([0-9a-f]+)"), F.lit(1)))
        return _let(groups, lambda n: padded(written, n))

    bare = F.lower(F.regexp_replace(ip, r"%[^%]+$", ""))
    return F.when(ip.contains(":"), _let(bare, lambda b: _let(without_quad(b), digits)))


def with_location(df: DataFrame, ip: str, out: str) -> DataFrame:
    """Adds where an address is: localhost, internal, external, special or unknown (F1).

    Documentation and benchmark ranges count as internal, multicast as external.
    NULL stays NULL.
    """
    return with_locations(df, {ip: out})


def with_locations(df: DataFrame, outs: dict[str, str]) -> DataFrame:
    """`with_location` of several addresses, a column for each, in the same steps.

    The other columns go through the steps as one value: each step copies its rows,
    which would cost more than the steps themselves.
    """
    c, columns, ips = F.col, df.columns, list(outs)
    # Keys stay as they are, so that their partitioning is known behind this.
    keys = [name for name in ("source_file", "line_number", "event_time") if name in columns and name not in ips]
    rest = [name for name in columns if name not in (*keys, *ips, *outs.values())]
    if rest:
        df = df.select(*keys, *ips, F.struct(*rest).alias("_rest"))
    df = df.withColumns({f"_digits{i}": _ipv6_digits(c(ip)) for i, ip in enumerate(ips)})

    def location6(digits: Column) -> Column:
        mapped = F.when(digits.rlike(_MAPPED_V6), _number_text(F.conv(F.right(digits, F.lit(8)), 16, 10).cast("bigint")))
        return _let(mapped, lambda quad: (
            F.when(quad.isNotNull(), F.when(quad.rlike(_PRIVATE_V4), "internal").otherwise("external"))
            .when(digits.rlike(_PRIVATE_V6) & ~digits.rlike(_GLOBAL_V6), "internal")
            .otherwise("external")))

    def location(i: int, ip: str) -> Column:
        return (
            F.when(c(ip).isNull(), F.lit(None).cast("string"))
            .when(c(ip).isin("127.0.0.1", "::1"), "localhost")
            .when(c(ip).rlike(_IPV4), _location_v4(c(ip)))
            .when(c(f"_digits{i}").isNotNull(), location6(c(f"_digits{i}")))
            .otherwise("unknown"))

    values = {name: c("_rest")[name].alias(name) for name in rest}
    return df.select(*[values.get(name, c(name)) for name in columns if name not in outs.values()],
                     *[location(i, ip).alias(outs[ip]) for i, ip in enumerate(ips)])


def with_address_bits(df: DataFrame, ip: str, out: str = "_address") -> DataFrame:
    """Adds an address of either family as a text of 32 or 128 binary digits, or NULL."""
    c = F.col

    def binary(number: Column, width: int) -> Column:
        return F.lpad(F.bin(number.cast("bigint")), width, "0")

    # Eight groups are cut from the digits: without this step each would parse the address anew.
    df = text.computed_once(df, "_digits", _ipv6_digits(c(ip)))
    groups = [binary(F.conv(F.substring("_digits", 1 + 4 * i, 4), 16, 10), 16) for i in range(8)]
    return df.withColumn(out, F.when(c("_digits").isNotNull(), F.concat(*groups)).otherwise(
        binary(ipv4_number(c(ip)), 32))).drop("_digits")


def protocol_name(number: Column) -> Column:
    """IP protocol number (text) to its name; other numbers stay as they are."""
    out = number
    for code, name in catalog.PROTOCOL_NAMES.items():
        out = F.when(number == code, name).otherwise(out)
    return out
