"""The simple event scorer and declared weights over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake import catalog, schemas
from threatlake.functions import net, scoring, text, times
from threatlake.operators import lookups, running
from threatlake.plans.scan import LINE_KEY


def assess_events(events: DataFrame) -> DataFrame:
    """Assessment of network and process events.

    The rate is the pair's trailing minute and the hour is the event's own.
    """
    c = F.col
    known = events.filter(c("kind").isin(schemas.NETWORK, schemas.PROCESS))
    rate = running.pair_count(events, 60, "rate")
    df = known.join(rate, LINE_KEY, "left")
    is_net = c("kind") == schemas.NETWORK
    named = c("process_name") != ""
    df = df.withColumns({
        "uncommon_port": is_net & scoring.is_uncommon_port(c("dest_port"), c("protocol")),
        "high_rate": is_net & (F.coalesce("rate", F.lit(0)) > catalog.MAX_CONNECTIONS_PER_MINUTE),
        "after_hours": is_net & ~F.coalesce(times.is_business_hours(c("event_time")), F.lit(True)),
        "process_risk": F.when(named | ~is_net, scoring.simple_process_risk(c("process_name"), c("command_line"))),
        "_benign": F.lower("process_name").isin(*catalog.BENIGN_PROCESSES),
    })
    df = df.withColumns({
        "network_risk": F.when(is_net, scoring.simple_network_risk(
            c("uncommon_port"), c("high_rate"), c("after_hours"))),
        "_odd_name": ~c("_benign") & text.matches(c("process_name"), catalog.SUSPICIOUS_NAME),
        "_odd_args": ~c("_benign") & text.matches(F.coalesce("command_line", F.lit("")), catalog.SUSPICIOUS_ARGS),
    })
    df = df.withColumn("total", F.coalesce("process_risk", F.lit(0.0)) + F.coalesce("network_risk", F.lit(0.0)))

    def notes(*pairs):
        # A note is only there when it is true.
        entries = text.collect_when([(cond, F.struct(F.lit(name).alias("key"), F.lit("True").alias("value")))
                                     for cond, name in pairs], "array<struct<key:string,value:string>>")
        return F.map_from_entries(entries)

    def factor(name, category, description, score, context):
        return F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"),
                        description.alias("description"), score.alias("score"), context.alias("context"))

    process = factor("process_risk", "PROCESS", F.concat(F.lit("Process risk score for "), c("process_name")),
                     c("process_risk"), notes((c("_benign"), "is_benign"), (c("_odd_name"), "suspicious_name"),
                                              (c("_odd_args"), "suspicious_args")))
    network = factor("network_risk", "NETWORK", F.concat(
        F.lit("Network risk score for "), c("source_ip"), F.lit(":"), c("dest_port").cast("string")),
        c("network_risk"), notes((c("uncommon_port"), "unusual_port"), (c("high_rate"), "high_frequency"),
                                 (c("after_hours"), "after_hours")))
    df = df.withColumns({
        "severity": scoring.simple_severity(c("total")),
        "confidence": scoring.simple_confidence(c("total")),
        "risk_factors": text.collect_when([(c("process_risk").isNotNull(), process),
                                           (c("network_risk").isNotNull(), network)], schemas.RISK_FACTORS),
    })
    return df.withColumns({
        "explanation": scoring.explanation(c("risk_factors")),
        "actions": scoring.suggested_actions(
            c("process_risk"), c("process_name"), c("_odd_args"), c("network_risk"), c("uncommon_port"),
            c("high_rate"), c("after_hours"), c("severity")),
    }).drop("_benign", "_odd_name", "_odd_args", "rate")


def severity_multipliers(events: DataFrame) -> DataFrame:
    """Declared multipliers of network events (F23): repeated key, port, process, external peer."""
    c = F.col
    frequency = running.running_frequency(events)
    df = events.filter(c("kind") == schemas.NETWORK).join(frequency, LINE_KEY)
    df = net.with_location(df, "dest_ip", "dest_location")
    unusual = ~c("dest_port").isin(*catalog.ALLOWED_PORTS)
    suspicious = lookups.suspicious_process(c("process_name"))
    external = c("dest_location") == "external"
    both = unusual & external
    return df.withColumn("multiplier", scoring.severity_multiplier(
        c("frequency") > 1, both, unusual, suspicious, external))


def weights(events: DataFrame) -> DataFrame:
    """Declared process, network and time weights per event (F24); 1.0 where none applies."""
    c = F.col
    p, n, t = catalog.PROCESS_WEIGHTS, catalog.NETWORK_WEIGHTS, catalog.TIME_WEIGHTS
    known = events.filter(c("kind").isin(schemas.NETWORK, schemas.PROCESS))
    known = net.with_location(known, "dest_ip", "dest_location")
    is_net = c("kind") == schemas.NETWORK
    trusted = F.lower("process_name").isin(*[x.process_name for x in catalog.TRUSTED_PROCESSES[:2]])
    process = F.when(c("process_name") == "", 1.0).when(trusted, p["system_critical"]).when(
        F.lower("process_name").isin(*catalog.BENIGN_PROCESSES), p["user_space"]).otherwise(p["unknown_process"])
    unusual = scoring.is_uncommon_port(c("dest_port"), c("protocol"))
    network = F.when(is_net, F.when(c("dest_location") == "external", n["external_connection"]).otherwise(1.0)
                     * F.when(unusual, n["unusual_port"]).otherwise(1.0)).otherwise(1.0)
    moment = F.when(c("event_time").isNull(), 1.0).when(F.weekday("event_time") >= 5, t["weekend"]).when(
        times.is_business_hours(c("event_time")), t["business_hours"]).otherwise(t["after_hours"])
    return known.withColumns({"process_weight": process, "network_weight": network, "time_weight": moment})
