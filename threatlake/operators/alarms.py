"""Baselines and threshold alarms.

Counts are pre-aggregated on the map side; distinct counts run over values of
bounded range (ports) or in two grouping levels, so no key gathers its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake import catalog, schemas
from threatlake.functions import scoring
from threatlake.operators import lookups, running


def event_type(events: DataFrame) -> DataFrame:
    """Adds `event_type` and `event_source`, the baseline's key and source."""
    c = F.col
    is_net = c("kind") == schemas.NETWORK
    port = F.coalesce(c("dest_port").cast("string"), F.lit("None"))
    known = events.filter(c("kind").isin(schemas.NETWORK, schemas.PROCESS))
    return known.withColumns({
        "event_type": F.when(is_net, F.concat(F.lit("network_"), c("protocol"), F.lit("_"), port)).otherwise(
            F.concat(F.lit("process_"), c("process_name"))),
        "event_source": F.when(is_net, c("source_ip")).otherwise(c("user")),
    })


def source_counts(events: DataFrame, *scope: str) -> DataFrame:
    return event_type(events).groupBy(*scope, "event_type", "event_source").agg(
        F.count(F.lit(1)).alias("events"))


def event_baseline(events: DataFrame, *scope: str) -> DataFrame:
    """Events per source for each event type."""
    return source_counts(events, *scope).groupBy(*scope, "event_type").agg(
        (F.sum("events") / F.count(F.lit(1))).alias("baseline"))


def key_frequency(events: DataFrame) -> DataFrame:
    """Events per frequency key and source, over all files."""
    keyed = running.with_frequency_key(events)
    return keyed.groupBy("freq_key", "freq_source").agg(F.count(F.lit(1)).alias("frequency"))


def frequency_deviation(events: DataFrame) -> DataFrame:
    """Deviation score of each source from its type's baseline.

    The baseline side has one row per event type; adaptive execution decides on
    the join by its measured size.
    """
    counts, baseline = source_counts(events), event_baseline(events)
    joined = counts.join(baseline, "event_type", "left")
    return joined.withColumn("score", scoring.deviation_score(F.col("baseline"), F.col("events")))


def connection_rate(events: DataFrame, limit: int = catalog.MAX_CONNECTIONS_PER_MINUTE) -> DataFrame:
    """Connections of the pair in the trailing minute, and whether over the limit (A10)."""
    counted = running.pair_count(events, 60, "connections")
    return counted.withColumn("over_limit", F.col("connections") > limit)


def _windowed(*windows: str) -> Column:
    return F.window("event_time", *windows)


def _start(window: str = "w") -> Column:
    return F.col(window)["start"].alias("window_start")


def port_scans(connections: DataFrame, window: str = "5 minutes",
               limit: int = catalog.LIMIT_SCANNED_PORTS) -> DataFrame:
    """Sources that reach at least `limit` distinct ports in a window."""
    ports = connections.filter(F.col("event_time").isNotNull()).groupBy(
        "source_ip", _windowed(window).alias("w"), "dest_port").agg(F.count(F.lit(1)).alias("n"))
    return ports.groupBy("source_ip", "w").agg(
        F.count("dest_port").alias("ports"), F.sum("n").alias("connections")).filter(
        F.col("ports") >= limit).select("source_ip", _start(), "ports", "connections")


def failed_logins(events: DataFrame, window: str = "5 minutes",
                  limit: int = catalog.LIMIT_FAILED_LOGINS) -> DataFrame:
    """Sources with more than `limit` failed logins in a window."""
    failed = events.filter((F.col("status") == "Failed") & F.col("event_time").isNotNull())
    return failed.groupBy("source_ip", _windowed(window).alias("w")).agg(
        F.count(F.lit(1)).alias("failures")).filter(F.col("failures") > limit).select(
        "source_ip", _start(), "failures")


def large_transfers(events: DataFrame, limit_mb: int = catalog.LIMIT_TRANSFER_MB) -> DataFrame:
    """Connections (address and port pairs) that moved more than the limit."""
    keys = ["source_ip", "source_port", "dest_ip", "dest_port", "protocol"]
    moved = events.filter(F.col("kind") == schemas.NETWORK).groupBy(*keys).agg(
        F.sum("bytes_transferred").alias("bytes"))
    return moved.filter(F.col("bytes") > limit_mb * 1024 * 1024)


def packet_events(packets: DataFrame) -> DataFrame:
    """Rows of a packet export as network events, so that A13 and A14 read them too."""
    return packets.withColumns({
        "kind": F.lit(schemas.NETWORK), "process_name": F.lit(""),
        "bytes_transferred": F.coalesce("length", F.lit(0).cast("bigint"))})


def per_minute_rates(events: DataFrame, limit: int = catalog.LIMIT_CONNECTIONS_PER_MINUTE) -> DataFrame:
    """Sources with more connections per minute than allowed."""
    known = events.filter((F.col("kind") == schemas.NETWORK) & F.col("event_time").isNotNull())
    return known.groupBy("source_ip", _windowed("1 minute").alias("w")).agg(
        F.count(F.lit(1)).alias("connections")).filter(F.col("connections") > limit).select(
        "source_ip", _start(), "connections")


def service_rates(events: DataFrame) -> DataFrame:
    """Services used more often per minute than their own limit."""
    known = events.filter((F.col("kind") == schemas.NETWORK) & F.col("event_time").isNotNull())
    named = lookups.with_service(known).filter(F.col("service").isNotNull())
    counted = named.groupBy(F.col("service")["service"].alias("service"),
                            F.col("service")["per_minute_limit"].alias("per_minute_limit"),
                            _windowed("1 minute").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.filter(F.col("requests") > F.col("per_minute_limit")).select(
        "service", "per_minute_limit", _start(), "requests")


def is_dns_query() -> Column:
    """Whether a connection goes to the DNS service."""
    return (F.col("dest_port") == 53) & (F.upper("protocol") == "UDP")


def dns_rates(events: DataFrame, limit: int = catalog.LIMIT_DNS_PER_MINUTE) -> DataFrame:
    """Sources with more DNS queries (port 53 over UDP, as the service table has it) per minute than allowed."""
    known = events.filter(is_dns_query() & F.col("event_time").isNotNull())
    return known.groupBy("source_ip", _windowed("1 minute").alias("w")).agg(
        F.count(F.lit(1)).alias("queries")).filter(F.col("queries") > limit).select(
        "source_ip", _start(), "queries")


def process_connections(events: DataFrame) -> DataFrame:
    """Connections per known process against its maximum."""
    counted = events.filter((F.col("kind") == schemas.NETWORK) & (F.col("process_name") != "")).groupBy(
        F.lower("process_name").alias("process_name")).agg(F.count(F.lit(1)).alias("connections"))
    known = lookups.with_trusted(counted).filter(F.col("trusted").isNotNull())
    limit = F.col("trusted")["max_connections"]
    return known.select("process_name", "connections", limit.alias("max_connections"),
                        (F.col("connections") > limit).alias("over_limit"))
