"""Joins with the catalogue and baseline.

The reference side is a constant table of the catalogue (tens of rows), hence
the unconditional broadcasts.  `exclude` and `retain` take a user's list of
unknown size and leave the strategy to the optimizer's size estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake import catalog, schemas
from threatlake.functions import net, scoring, text
from threatlake.sources import reference


def with_trusted(events: DataFrame) -> DataFrame:
    """Adds `trusted`, the known-process entry of the event's process or NULL."""
    table = reference.trusted_processes(events.sparkSession)
    entry = F.struct(*[c for c in table.columns if c not in ("process_name", "paths")]).alias("trusted")
    table = table.select(F.col("process_name").alias("_name"), entry)
    joined = events.join(F.broadcast(table), F.lower("process_name") == F.col("_name"), "left")
    return joined.drop("_name")


def with_service(events: DataFrame) -> DataFrame:
    """Adds `service`, the known service of (dest_port, protocol) or NULL."""
    table = reference.services(events.sparkSession)
    entry = F.struct("service", "internal_only", "per_minute_limit", "risk_factor").alias("service")
    table = table.select(F.col("port").alias("_port"), F.col("protocol").alias("_protocol"), entry)
    joined = events.join(F.broadcast(table), (F.col("dest_port") == F.col("_port")) & (
        F.upper("protocol") == F.col("_protocol")), "left")
    return joined.drop("_port", "_protocol")


def with_network(events: DataFrame, column: str, networks: tuple[str, ...] = catalog.BASELINE_NETWORKS,
                 out: str = "network") -> DataFrame:
    """Adds the fixed network that holds the IPv4 address, or NULL (J9); networks do not overlap.

    The networks are constants, so they are unrolled into one CASE.
    """
    staged = events.withColumn("_n", net.ipv4_number(F.col(column)))
    found = F.lit(None).cast("string")
    for network in networks:
        found = F.when(net.in_networks(F.col("_n"), (network,)), network).otherwise(found)
    return staged.withColumn(out, found).drop("_n")


def with_longest_network(events: DataFrame, column: str, networks: DataFrame, out: str = "network") -> DataFrame:
    """Adds the narrowest block of a CIDR table (network) that holds the address, or NULL.

    Blocks and addresses are IPv4 or IPv6; the families do not meet, nor do an address and a block
    that cannot be read.  A block is keyed by its length and its leading binary digits, a distinct
    address by as many leading digits for every length that the table has for its family: at most
    162 rows, broadcast.  Equality joins only, for tables of any size.
    """
    c = F.col
    parts = networks.select(c("network"), F.substring_index("network", "/", 1).alias("_at"), F.when(
        c("network").contains("/"), F.substring_index("network", "/", -1).try_cast("int")).alias("_length"), c("network").contains("/").alias("_cut"))
    blocks = net.with_address_bits(parts, "_at").withColumn("_width", F.length("_address")).withColumn(
        "_length", F.when(c("_cut"), c("_length")).otherwise(c("_width"))).filter("_length between 0 and _width")
    blocks = blocks.select("_width", "_length", F.expr("left(_address, _length)").alias("_prefix"), "network")
    blocks = blocks.groupBy("_width", "_length", "_prefix").agg(F.min("network").alias("_network"))
    addresses = net.with_address_bits(events.select(c(column).alias("_ip")).distinct(), "_ip").filter("_address is not null")
    levels = blocks.select("_width", "_length").distinct()
    keys = addresses.withColumn("_width", F.length("_address")).join(F.broadcast(levels), "_width").select(
        "_ip", "_width", "_length", F.expr("left(_address, _length)").alias("_prefix"))
    found = keys.join(blocks, ["_width", "_length", "_prefix"]).groupBy("_ip").agg(F.max_by("_network", "_length").alias(out))
    return events.drop(out).join(found, c(column) == c("_ip"), "left").drop("_ip")


def with_network_of_table(events: DataFrame, column: str, networks: DataFrame) -> DataFrame:
    """As `with_network` for a table of CIDR blocks (network, lo, hi) of any size: one row per match.

    A block of 2^k addresses is keyed by (k, lo / 2^k), and each distinct address
    by its 33 possible keys: equality joins only, no range test.
    """
    bits = F.length(F.bin(F.col("hi") - F.col("lo") + 1)) - 1
    keyed = networks.select("network", bits.alias("_bits"), "lo").select(
        "network", "_bits", F.expr("shiftright(lo, _bits)").alias("_prefix"))
    addresses = events.select(F.col(column).alias("_ip")).distinct()
    addresses = addresses.withColumn("_n", net.ipv4_number(F.col("_ip"))).filter("_n is not null")
    candidates = addresses.select("_ip", "_n", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("_bits")).select(
        "_ip", "_bits", F.expr("shiftright(_n, _bits)").alias("_prefix"))
    found = candidates.join(keyed, ["_bits", "_prefix"]).select("_ip", "network")
    return events.join(found, F.col(column) == F.col("_ip"), "left").drop("_ip")


def exclude(events: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """Rows whose value is not listed."""
    name = listed.columns[0]
    table = listed.select(F.col(name).alias("_listed"))
    return events.join(table, F.col(column) == F.col("_listed"), "left_anti")


def retain(events: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """Rows whose value is listed."""
    name = listed.columns[0]
    table = listed.select(F.col(name).alias("_listed"))
    return events.join(table, F.col(column) == F.col("_listed"), "left_semi")


def port_flags(events: DataFrame) -> DataFrame:
    """Network events with `high_risk` and `unlisted` destination-port flags (Q12)."""
    listed = F.lit(False)
    for protocol, ports in catalog.BASELINE_PORTS.items():
        listed = listed | ((F.upper("protocol") == protocol) & F.col("dest_port").isin(*ports))
    return events.filter(F.col("kind") == schemas.NETWORK).withColumns({
        "high_risk": F.coalesce(F.col("dest_port").isin(*catalog.HIGH_RISK_PORTS), F.lit(False)),
        "unlisted": ~F.coalesce(listed, F.lit(False)),
    })


def suspicious_process(name: Column) -> Column:
    """Process-name patterns of the network rule set (Q13)."""
    cond = F.lit(False)
    for pattern in catalog.SUSPICIOUS_PROCESS_PATTERNS:
        cond = cond | text.matches(name, pattern)
    return F.coalesce(cond, F.lit(False))


def is_known_dns_server(address: Column) -> Column:
    """The address is one of the baseline's DNS servers (Q14)."""
    return F.coalesce(address.isin(*catalog.BASELINE_DNS_SERVERS), F.lit(False))


def is_whitelisted_domain(domain: Column) -> Column:
    """The domain or a parent of it is whitelisted (Q14)."""
    d = F.lower(domain)
    cond = d.isin(*catalog.BASELINE_DOMAINS)
    for name in catalog.BASELINE_DOMAINS:
        cond = cond | d.endswith("." + name)
    return F.coalesce(cond, F.lit(False))


def with_listed_domain(rows: DataFrame, column: str, domains: DataFrame) -> DataFrame:
    """Adds `listed_domain`, the longest listed parent, for a domain table of any size (Q14).

    A name has one candidate per label, so it is an equality join on suffixes.
    """
    labels = F.split(F.lower(F.col(column)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    names = rows.select(column).distinct()
    candidates = names.withColumn("_suffix", F.explode(suffixes))
    table = domains.select(F.lower(F.col(domains.columns[0])).alias("_suffix"))
    found = candidates.join(table, "_suffix").groupBy(column).agg(
        F.max_by("_suffix", F.length("_suffix")).alias("listed_domain"))
    return rows.join(found, column, "left")


def with_trust(events: DataFrame) -> DataFrame:
    """Adds trust and trust_reasons to events that carry `trusted`.

    Network events are checked for their ports, process events for path and
    user.  A network event without a process name has full trust.
    """
    c = F.col
    is_net = c("kind") == schemas.NETWORK
    base = c("trusted")["base_trust"]
    path_given = ~is_net & (c("path") != "")
    user_given = ~is_net & (c("user") != "")
    ports_given = is_net & (c("source_port") != 0) & (c("dest_port") != 0)
    path_ok = None
    for p in catalog.TRUSTED_PROCESSES:
        cond = F.lower("process_name") == p.process_name
        value = scoring.path_matches(c("path"), p.paths)
        path_ok = F.when(cond, value) if path_ok is None else path_ok.when(cond, value)
    users = c("trusted")["users"]
    user_ok = F.array_contains(users, "*") | F.array_contains(users, c("user"))
    unexpected = F.array_except(F.array("source_port", "dest_port"), c("trusted")["allowed_ports"])
    staged = events.withColumns({
        "_path_ok": F.when(path_given, path_ok), "_user_ok": F.when(user_given, user_ok),
        "_unexpected": F.when(F.coalesce(ports_given, F.lit(False)), unexpected)})
    no = F.lit(False)
    trust = scoring.trust_score(
        base, F.coalesce(c("_path_ok") == no, no), F.coalesce(c("_user_ok") == no, no),
        F.coalesce(F.size("_unexpected") > 0, no))
    reasons = scoring.trust_reasons(base, c("trusted")["description"], c("path"), c("_path_ok"), c("user"),
                                    c("_user_ok"), c("_unexpected"))
    unnamed = is_net & (c("process_name") == "")
    return staged.withColumns({
        "trust": F.when(unnamed, 1.0).otherwise(trust),
        "trust_reasons": F.when(unnamed, F.array(F.lit("Process info N/A"))).otherwise(reasons),
    }).drop("_path_ok", "_user_ok", "_unexpected")
