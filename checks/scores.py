"""Scoring functions (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.oracle_base import LOCATION, rx, sql, steps
from checks.registry import query
from checks.tables import Tables
from threatlake import catalog
from threatlake.functions import net, scoring, times
from threatlake.operators import alarms, lookups, running
from threatlake.plans import scan, scorer

c = F.col
KEY = "source_file, line_number"


@query("f1_ip_location", sql("ev", f"""
WITH ips AS (SELECT DISTINCT CASE event_id % 16 WHEN 0 THEN '100.64.0.' || (event_id % 200) WHEN 1 THEN '203.0.113.' || (event_id % 256)
    WHEN 2 THEN '224.0.0.' || (event_id % 256) WHEN 3 THEN (event_id % 256) || '.1.2.3' WHEN 4 THEN '10.0.0.' || (event_id % 400)
    WHEN 5 THEN '198.' || (event_id % 256) || '.0.1' WHEN 6 THEN '172.' || (event_id % 256) || '.9.9' WHEN 7 THEN 'not an ip'
    WHEN 8 THEN '127.0.0.' || (event_id % 3) WHEN 9 THEN '169.254.1.1' WHEN 10 THEN '100.' || (event_id % 256) || '.0.1' ELSE coalesce(source_ip, dest_ip, 'none') END AS ip FROM ev)
SELECT ip, CASE WHEN EXISTS (SELECT 1 FROM (SELECT unnest(string_split(ip, '.')) AS o) WHERE TRY_CAST(o AS INTEGER) > 255) THEN 'unknown'
    ELSE {LOCATION.format(ip='ip')} END AS location FROM ips"""))
def _(t: Tables) -> DataFrame:
    e = c("line_number") - 1

    def dotted(*parts) -> F.Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    made = (dotted("100.64.0.", e % 200), dotted("203.0.113.", e % 256), dotted("224.0.0.", e % 256), dotted(e % 256, ".1.2.3"),
            dotted("10.0.0.", e % 400), dotted("198.", e % 256, ".0.1"), dotted("172.", e % 256, ".9.9"), F.lit("not an ip"),
            dotted("127.0.0.", e % 3), F.lit("169.254.1.1"), dotted("100.", e % 256, ".0.1"))
    ip = F.coalesce("source_ip", "dest_ip", F.lit("none"))
    for i, value in enumerate(made):
        ip = F.when(e % 16 == i, value).otherwise(ip)
    return net.with_location(t.parsed.select(ip.alias("ip")).distinct(), "ip", "location")


@query("f2_time_multiplier", sql("scored", f"SELECT {KEY}, time_factor FROM scored"))
def _(t: Tables) -> DataFrame:
    known = t.parsed.filter("kind != 'GENERIC'")
    return known.select("source_file", "line_number", times.time_multiplier(c("event_time")).alias("time_factor"))


@query("f3_business_hours", sql("raw", """
SELECT line_number, isodow(log_ts) <= 5 AND CAST(log_ts AS TIME) BETWEEN TIME '09:00:00' AND TIME '17:00:00' AS business FROM raw"""))
def _(t: Tables) -> DataFrame:
    return t.derived.select("line_number", times.is_business_hours(c("log_ts")).alias("business"))


@query("f4_connection_risk", sql("dynf", f"""
SELECT {KEY}, round(connection_risk, 6) AS connection_risk, array_to_string(conn_reasons, '; ') AS reasons FROM noted WHERE kind = 'NETWORK'"""))
def _(t: Tables) -> DataFrame:
    return t.scored.filter("kind = 'NETWORK'").select(
        "source_file", "line_number", F.round("connection_risk", 6).alias("connection_risk"),
        F.array_join("connection_reasons", "; ").alias("reasons"))


@query("f5_process_trust", sql("dynf", f"SELECT {KEY}, round(trust, 6) AS trust, array_to_string(trust_reasons, '; ') AS reasons FROM noted"))
def _(t: Tables) -> DataFrame:
    known = lookups.with_trust(lookups.with_trusted(t.parsed.filter("kind != 'GENERIC'")))
    return known.select("source_file", "line_number", F.round("trust", 6).alias("trust"),
                        F.array_join("trust_reasons", "; ").alias("reasons"))


@query("f6_command_line_risk", sql("scored", f"""
SELECT {KEY}, round(command_risk, 6) AS command_risk, array_to_string(c_reasons, '; ') AS reasons FROM scored WHERE kind = 'PROCESS'"""))
def _(t: Tables) -> DataFrame:
    hits = t.parsed.filter("kind = 'PROCESS'").withColumn("_hits", scoring.command_hits(c("command_line")))
    return hits.select("source_file", "line_number", F.round(scoring.command_risk(c("_hits")), 6).alias("command_risk"),
                       F.array_join(scoring.command_reasons(c("_hits")), "; ").alias("reasons"))


@query("f7_correlation_factor", sql("scored", f"SELECT {KEY}, correlated, correlation_factor FROM scored"))
def _(t: Tables) -> DataFrame:
    return t.scored.select("source_file", "line_number", "correlated", scoring.correlation_factor(c("correlated")).alias("correlation_factor"))


@query("f8_frequency_factor", sql("scored", f"SELECT {KEY}, frequency, frequency_factor FROM scored"))
def _(t: Tables) -> DataFrame:
    return t.scored.select("source_file", "line_number", "frequency", scoring.frequency_factor(
        c("kind"), c("source_location"), c("frequency")).alias("frequency_factor"))


def _risk(kind: str) -> str:
    return sql("scored", f"SELECT {KEY}, round(unmitigated_risk, 6) AS unmitigated, round(risk, 6) AS risk, mitigated FROM scored WHERE kind = '{kind}'")


def _risk_of(t: Tables, kind: str) -> DataFrame:
    return scan.score_events(t.parsed).filter(c("kind") == kind).select(
        "source_file", "line_number", F.round("unmitigated_risk", 6).alias("unmitigated"), F.round("risk", 6).alias("risk"), "mitigated")


@query("f9_network_risk", _risk("NETWORK"))
def _(t: Tables) -> DataFrame:
    return _risk_of(t, "NETWORK")


@query("f11_process_risk", _risk("PROCESS"))
def _(t: Tables) -> DataFrame:
    return _risk_of(t, "PROCESS")


def _severity(name: str, kind: str, cutoffs: tuple) -> None:
    query(name, sql("scored", f"SELECT {KEY}, dynamic_severity AS severity FROM scored WHERE kind = '{kind}'"))(
        lambda t: t.scored.filter(c("kind") == kind).select(
            "source_file", "line_number", scoring.severity(c("risk"), cutoffs).alias("severity")))


_severity("f10_network_severity", "NETWORK", catalog.NETWORK_CUTOFFS)
_severity("f12_process_severity", "PROCESS", catalog.PROCESS_CUTOFFS)

_TYPED = """
typed_events AS (SELECT CASE kind WHEN 'NETWORK' THEN 'network_' || protocol || '_' || dest_port ELSE 'process_' || process_name END AS event_type,
    CASE kind WHEN 'NETWORK' THEN source_ip ELSE "user" END AS event_source, event_time FROM ev WHERE kind <> 'GENERIC'),
counts AS (SELECT event_type, event_source, count(*) AS events FROM typed_events GROUP BY ALL),
baselines AS (SELECT event_type, sum(events) / count(*) AS baseline FROM counts GROUP BY ALL)"""


@query("f13_frequency_deviation", sql("ev", f"""WITH {_TYPED}
SELECT event_type, event_source, events, {steps('(events - baseline) / baseline', (0.1, 0.5, 1.0, 2.0), (0.0, 2.0, 3.0, 4.0, 5.0))} AS score
FROM counts JOIN baselines USING (event_type)"""))
def _(t: Tables) -> DataFrame:
    return alarms.frequency_deviation(t.parsed).select("event_type", "event_source", "events", "score")


_BENIGN = catalog.BENIGN_PROCESSES
_COMMON = " OR ".join(f"(lower(protocol) = '{p}' AND dest_port IN {ports})" for p, ports in catalog.COMMON_PORTS.items())
_SIMPLE = f"""
rated AS (SELECT *, kind = 'NETWORK' AS is_net, count(*) OVER (PARTITION BY kind, source_ip, dest_ip ORDER BY event_time
    RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) > 100 AS fast FROM ev WHERE kind <> 'GENERIC'),
judged AS (SELECT *, is_net AND NOT ({_COMMON}) AS uncommon, is_net AND fast AS high_rate,
    is_net AND NOT (isodow(event_time) <= 5 AND CAST(event_time AS TIME) BETWEEN TIME '09:00:00' AND TIME '17:00:00') AS late,
    lower(process_name) IN {_BENIGN} AS benign, {rx(catalog.SUSPICIOUS_NAME, 'process_name')} AS odd_name,
    {rx(catalog.SUSPICIOUS_ARGS, "coalesce(command_line, '')")} AS odd_args FROM rated),
simple1 AS (SELECT *, CASE WHEN process_name <> '' OR NOT is_net THEN CASE WHEN benign THEN CAST(0.2 AS DOUBLE)
        ELSE CASE WHEN odd_name THEN CAST(2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN odd_args THEN CAST(1.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END END AS p_risk,
    CASE WHEN is_net THEN (CASE WHEN uncommon THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN high_rate THEN CAST(1.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)
        * CASE WHEN late THEN CAST(1.2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END END AS n_risk FROM judged),
simple2 AS (SELECT *, coalesce(p_risk, 0) + coalesce(n_risk, 0) AS total,
    CAST(least(5, greatest(1, trunc(coalesce(p_risk, 0) + coalesce(n_risk, 0)))) AS INTEGER) AS severity,
    least(CAST(1 AS DOUBLE), (coalesce(p_risk, 0) + coalesce(n_risk, 0)) / 5) AS confidence FROM simple1)"""


def _assessed(fields: str) -> str:
    return sql("ev", f"WITH {_SIMPLE} SELECT {KEY}, {fields} FROM simple2")


@query("f14_simple_process_risk", _assessed("round(p_risk, 6) AS process_risk"))
def _(t: Tables) -> DataFrame:
    return scorer.assess_events(t.parsed).select("source_file", "line_number", F.round("process_risk", 6).alias("process_risk"))


@query("f15_simple_network_risk", _assessed("round(n_risk, 6) AS network_risk, uncommon, high_rate, late AS after_hours"))
def _(t: Tables) -> DataFrame:
    return scorer.assess_events(t.parsed).select(
        "source_file", "line_number", F.round("network_risk", 6).alias("network_risk"), c("uncommon_port").alias("uncommon"),
        "high_rate", "after_hours")


@query("f16_event_assessment", _assessed("severity, round(confidence, 6) AS confidence"))
def _(t: Tables) -> DataFrame:
    return scorer.assess_events(t.parsed).select("source_file", "line_number", "severity", F.round("confidence", 6).alias("confidence"))


@query("f17_explanation", _assessed("""coalesce(nullif(concat_ws(chr(10),
    CASE WHEN p_risk > 0 THEN 'PROCESS: Process risk score for ' || process_name || ' (Score: ' || printf('%.1f', p_risk) ||
        CASE WHEN benign THEN ' - is_benign: True' WHEN odd_name AND odd_args THEN ' - suspicious_name: True, suspicious_args: True'
            WHEN odd_name THEN ' - suspicious_name: True' WHEN odd_args THEN ' - suspicious_args: True' ELSE '' END || ')' END,
    CASE WHEN n_risk > 0 THEN 'NETWORK: Network risk score for ' || source_ip || ':' || dest_port || ' (Score: ' || printf('%.1f', n_risk) || ' - ' ||
        concat_ws(', ', CASE WHEN uncommon THEN 'unusual_port: True' END, CASE WHEN high_rate THEN 'high_frequency: True' END,
            CASE WHEN late THEN 'after_hours: True' END) || ')' END), ''), 'No significant risk factors identified.') AS explanation"""))
def _(t: Tables) -> DataFrame:
    return scorer.assess_events(t.parsed).select("source_file", "line_number", "explanation")


@query("f18_suggested_actions", _assessed("""coalesce(nullif(concat_ws(' | ',
    CASE WHEN p_risk > 1.5 THEN 'Investigate process ' || process_name END,
    CASE WHEN p_risk > 1.5 AND NOT benign AND odd_args THEN 'Review process command line arguments' END,
    CASE WHEN n_risk > 1 AND uncommon THEN 'Review network connections on non-standard ports' END,
    CASE WHEN n_risk > 1 AND high_rate THEN 'Investigate high-frequency connections' END,
    CASE WHEN n_risk > 1 AND late THEN 'Review after-hours network activity' END,
    CASE WHEN severity >= 4 THEN 'Escalate to security team for immediate review' WHEN severity = 3 THEN 'Monitor system for additional suspicious activity' END),
    ''), 'No immediate action required') AS actions"""))
def _(t: Tables) -> DataFrame:
    return scorer.assess_events(t.parsed).select("source_file", "line_number", F.array_join("actions", " | ").alias("actions"))


@query("f19_severity_band", sql("findings", f"""
SELECT {KEY}, CASE WHEN severity >= 4 THEN 'high' WHEN severity >= 2 THEN 'medium' ELSE 'low' END AS band FROM findings"""))
def _(t: Tables) -> DataFrame:
    return t.findings.select("source_file", "line_number", scoring.severity_band(c("severity")).alias("band"))


@query("f20_indicators_of_reasons", sql("findings", f"SELECT {KEY}, type, category, description FROM indicators"))
def _(t: Tables) -> DataFrame:
    return t.findings.select("source_file", "line_number", F.inline("indicators")).drop("severity")


@query("f21_risk_factors", sql("findings", f"SELECT {KEY}, string_agg(factor, ' | ' ORDER BY factor) AS factors FROM factor_rows GROUP BY ALL"))
def _(t: Tables) -> DataFrame:
    f = c("risk_factors")
    names = F.array_sort(F.transform(f, lambda x: F.concat(x["category"], F.lit(":"), x["name"])))
    return t.findings.select("source_file", "line_number", F.array_join(names, " | ").alias("factors"))


def _context_sql() -> str:
    head_n = ("'Network Event Analysis (Severity: ' || dynamic_severity || ', Risk Score: ' || printf('%.2f', risk) || '):' || chr(10) || 'Source IP: ' || source_ip || "
              "' (' || source_location || ')' || chr(10) || 'Destination IP: ' || dest_ip || ' (' || dest_location || ')' || chr(10) || 'Protocol: ' || protocol || "
              "chr(10) || 'Ports: ' || source_port || ' -> ' || dest_port")
    head_p = ("'Process Event Analysis (Severity: ' || dynamic_severity || ', Risk Score: ' || printf('%.2f', risk) || '):' || chr(10) || 'Process: ' || process_name || "
              "chr(10) || 'PID: ' || pid || chr(10) || 'User: ' || \"user\" || chr(10) || 'Path: ' || path || chr(10) || 'Command Line: ' || command_line")
    details = ("CASE WHEN b.kind = 'PROCESS' THEN '{''process_name'': ''' || b.process_name || ''', ''pid'': ' || b.pid || ', ''user'': ''' || b.\"user\" || '''}' "
               "ELSE '{''source_ip'': ''' || b.source_ip || ''', ''dest_ip'': ''' || b.dest_ip || ''', ''protocol'': ''' || b.protocol || ''', ''bytes'': ' || b.bytes_transferred || '}' END")
    return sql("dynf", f"""
WITH rel AS (SELECT a.source_file, a.line_number, lower(b.kind) AS type, b.event_time AS t, {details} AS details, row_number() OVER (
        PARTITION BY a.source_file, a.line_number ORDER BY b.event_time, b.kind DESC, b.line_number) AS p
    FROM known a JOIN known b ON a.source_file = b.source_file AND b.event_time BETWEEN a.event_time - INTERVAL 300 SECONDS AND a.event_time
    AND (CASE WHEN a.kind = 'NETWORK' AND b.kind = 'NETWORK' THEN a.source_ip = b.source_ip AND a.dest_ip = b.dest_ip
         ELSE a.process_name = b.process_name AND a.process_name <> '' END)),
tops AS (SELECT source_file, line_number, string_agg(p || '. ' || type || ' at ' || strftime(t, '%Y-%m-%d %H:%M:%S') || ' - Details: ' || details, chr(10) ORDER BY p) AS related
    FROM rel WHERE p <= 5 GROUP BY ALL)
SELECT d.source_file, d.line_number, CASE WHEN kind = 'NETWORK' THEN {head_n} ELSE {head_p} END || chr(10) || 'Frequency: ' || frequency || ' occurrences' || chr(10) || chr(10) ||
    'Analysis Reasons:' || chr(10) || '- ' || array_to_string(reasons, chr(10) || '- ') || chr(10) || chr(10) || 'Related Events (' || correlated || '):' || chr(10) || related AS context
FROM dynf d JOIN tops ON d.source_file = tops.source_file AND d.line_number = tops.line_number""")


@query("f22_context_text", _context_sql())
def _(t: Tables) -> DataFrame:
    found = scan.dynamic_findings(t.scored, related=running.earliest_correlated(t.parsed))
    return found.select("source_file", "line_number", "context")


@query("f23_severity_multipliers", sql("scored", f"""
SELECT {KEY}, round(CASE WHEN frequency > 1 THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
    * CASE WHEN dest_port NOT IN {catalog.ALLOWED_PORTS} AND dest_location = 'external' THEN CAST(1.3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
    * CASE WHEN dest_port NOT IN {catalog.ALLOWED_PORTS} THEN CAST(1.2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
    * CASE WHEN {' OR '.join(rx(p, 'process_name') for p in catalog.SUSPICIOUS_PROCESS_PATTERNS)} THEN CAST(1.4 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
    * CASE WHEN dest_location = 'external' THEN CAST(1.2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, 6) AS multiplier
FROM scored WHERE kind = 'NETWORK'"""))
def _(t: Tables) -> DataFrame:
    return scorer.severity_multipliers(t.parsed).select("source_file", "line_number", F.round("multiplier", 6).alias("multiplier"))


@query("f24_declared_weights", sql("scored", f"""
SELECT {KEY}, CAST(CASE WHEN process_name = '' THEN 1 WHEN lower(process_name) IN ('svchost.exe','lsass.exe') THEN 1.5
    WHEN lower(process_name) IN {_BENIGN} THEN 1 ELSE 2 END AS DOUBLE) AS process_weight,
    round(CASE WHEN kind = 'NETWORK' THEN CASE WHEN dest_location = 'external' THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
        * CASE WHEN NOT ({_COMMON}) THEN CAST(1.2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END ELSE CAST(1 AS DOUBLE) END, 6) AS network_weight,
    CAST(CASE WHEN isodow(event_time) >= 6 THEN 1.1 WHEN CAST(event_time AS TIME) BETWEEN TIME '09:00:00' AND TIME '17:00:00' THEN 0.8 ELSE 1.2 END AS DOUBLE) AS time_weight
FROM scored"""))
def _(t: Tables) -> DataFrame:
    return scorer.weights(t.parsed).select("source_file", "line_number", "process_weight",
                                           F.round("network_weight", 6).alias("network_weight"), "time_weight")


@query("f25_after_hours", sql("raw", "SELECT line_number, hour(log_ts) >= 23 OR hour(log_ts) < 5 AS after_hours FROM raw"))
def _(t: Tables) -> DataFrame:
    return t.derived.select("line_number", times.is_after_hours(c("log_ts")).alias("after_hours"))
