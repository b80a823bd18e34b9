"""Aggregations, windows, ranking and set operations (A, W, T, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.oracle_base import benign_case, q, sql, values
from checks.registry import query
from checks.scores import _TYPED
from checks.sources_events import NUMBERED, chunk_of, written_lines
from checks.streams import DNS_EVENTS, dns_line
from checks.tables import YEAR, Tables
from threatlake import catalog, session
from threatlake.operators import alarms, extract, lookups, matching, report, running
from threatlake.sources import logs, reference

c = F.col
KEY = "source_file, line_number"


@query("a1_findings_per_severity", sql("findings", "SELECT severity, count(*) AS findings FROM findings GROUP BY severity"))
def _(t: Tables) -> DataFrame:
    return report.by_severity(t.findings)


@query("a2_first_category", sql("findings", "SELECT category, count(*) AS findings FROM first_category GROUP BY ALL"))
def _(t: Tables) -> DataFrame:
    return report.by_first_category(t.findings)


@query("a3_indicator_categories", sql("findings", "SELECT category, count(*) AS indicators FROM indicators GROUP BY ALL"))
def _(t: Tables) -> DataFrame:
    return report.by_indicator_category(t.findings)


@query("a4_risk_factor_frequency", sql("findings", "SELECT factor, count(*) AS findings FROM factor_rows GROUP BY ALL"))
def _(t: Tables) -> DataFrame:
    return report.by_risk_factor(t.findings)


@query("a5_mitigated_count", sql("findings", "SELECT count(*) FILTER (wins AND mitigated) AS mitigated FROM findings"))
def _(t: Tables) -> DataFrame:
    return report.mitigated_count(t.findings)


@query("a6_scan_totals", sql("findings", """
SELECT (SELECT count(DISTINCT source_file) FROM raw) AS files_scanned, count(*) AS threats_found, max(event_time) AS last_event FROM findings"""))
def _(t: Tables) -> DataFrame:
    return report.scan_totals(t.findings, t.lines)


@query("a7_executive_summary", sql("findings", f"""
WITH totals AS (SELECT count(*) AS total, count(*) FILTER (wins AND mitigated) AS mitigated, count(*) FILTER (severity >= 4) AS severe,
    count(*) FILTER (severity = 3) AS medium, bool_or((NOT wins AND r_description = 'Failed authentication - external') OR (wins AND command_risk >= 4)) AS urgent FROM findings),
cats AS (SELECT category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, category) AS p FROM first_category GROUP BY category),
facs AS (SELECT factor, n, row_number() OVER (ORDER BY n DESC, factor) AS p FROM (
    SELECT * FROM (SELECT factor, count(*) AS n FROM factor_rows GROUP BY factor ORDER BY n DESC, factor LIMIT 5) WHERE factor NOT LIKE '%RiskMitigation%')),
ex AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY source_file, line_number) AS p FROM findings WHERE severity >= 4)
SELECT CAST(1 AS INTEGER) AS section, CAST(1 AS INTEGER) AS position, 'Executive Summary: Processed file. Found ' || total || ' notable findings (Severity >= 2).' AS text FROM totals
UNION ALL SELECT 2, 1, 'NOTE: ' || mitigated || ' finding(s) had their risk score reduced due to baseline/whitelisting factors.' FROM totals WHERE mitigated > 0
UNION ALL SELECT 3, CAST(10 - severity AS INTEGER), '- Severity ' || severity || ': ' || count(*) || ' findings' FROM findings GROUP BY severity
UNION ALL SELECT 4, CAST((10 - severity) * 10 + p AS INTEGER), '- Sev ' || severity || ': ' || left(content, 120) || '...' FROM ex WHERE p <= 3
UNION ALL SELECT 5, CAST(p AS INTEGER), '- ' || category || ': ' || n || ' findings' FROM cats WHERE p <= 5
UNION ALL SELECT 6, CAST(p AS INTEGER), '- ' || factor || ': Contributed to ' || n || ' findings' FROM facs
UNION ALL SELECT 7, 1, concat_ws(chr(10),
    CASE WHEN severe > 0 AND NOT urgent THEN {q(report.HIGH)} WHEN severe > 0 THEN {q(report.HIGH + report.HIGH_ALSO)} WHEN urgent THEN {q(report.HIGH_FACTORS)} END,
    CASE WHEN medium > 0 THEN {q(report.MEDIUM)} END,
    CASE WHEN mitigated > 5 OR (mitigated > 0 AND severe = 0 AND NOT urgent AND medium = 0) THEN {q(report.LOW)}
        WHEN severe = 0 AND NOT urgent AND medium = 0 THEN {q(report.NONE)} END) FROM totals"""))
def _(t: Tables) -> DataFrame:
    return report.summarize(t.findings)


@query("a8_event_baseline", sql("ev", f"WITH {_TYPED} SELECT event_type, round(baseline, 6) AS baseline FROM baselines"))
def _(t: Tables) -> DataFrame:
    return alarms.event_baseline(t.parsed).select("event_type", F.round("baseline", 6).alias("baseline"))


@query("a9_key_frequency", sql("scored", "SELECT freq_key, freq_source, count(*) AS frequency FROM known GROUP BY ALL"))
def _(t: Tables) -> DataFrame:
    return alarms.key_frequency(t.parsed)


@query("a10_connection_rate", sql("ev", f"""
SELECT {KEY}, count(*) OVER (PARTITION BY source_ip, dest_ip ORDER BY event_time RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS connections,
    count(*) OVER (PARTITION BY source_ip, dest_ip ORDER BY event_time RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) > 5 AS over_limit
FROM ev WHERE kind = 'NETWORK'"""))
def _(t: Tables) -> DataFrame:
    return alarms.connection_rate(t.parsed, 5)


def bucket(minutes: int) -> str:
    return f"time_bucket(INTERVAL {minutes} MINUTES, event_time, TIMESTAMP '1970-01-01')"


@query("a11_port_scans", sql("packets", f"""
SELECT source_ip, {bucket(60)} AS window_start, count(DISTINCT dest_port) AS ports, count(*) AS connections FROM packets
GROUP BY ALL HAVING count(DISTINCT dest_port) >= 3"""))
def _(t: Tables) -> DataFrame:
    return alarms.port_scans(t.packets, "60 minutes", 3)


@query("a11_scorer_port_scans", sql("packets", f"""
SELECT source_ip, {bucket(600)} AS window_start, count(DISTINCT dest_port) AS ports, count(*) AS connections
FROM (SELECT source_file, event_time, source_ip, CAST(dest_port + line_number % 5 AS INTEGER) AS dest_port FROM packets) GROUP BY ALL HAVING count(DISTINCT dest_port) >= 10"""))
def _(t: Tables) -> DataFrame:
    spread = t.packets.withColumn("dest_port", (c("dest_port") + c("line_number") % 5).cast("int"))
    return alarms.port_scans(spread, "600 minutes", catalog.SCORER_PORT_SCAN_LIMIT)


@query("a12_failed_logins", sql("ev", f"""
SELECT source_ip, {bucket(60)} AS window_start, count(*) AS failures FROM ev WHERE status = 'Failed' GROUP BY ALL HAVING count(*) > 5"""))
def _(t: Tables) -> DataFrame:
    return alarms.failed_logins(t.parsed, "60 minutes")


@query("a13_large_transfers", sql("ev", """
SELECT source_ip, source_port, dest_ip, dest_port, protocol, CAST(sum(bytes_transferred) AS BIGINT) AS bytes FROM ev WHERE kind = 'NETWORK'
GROUP BY ALL HAVING sum(bytes_transferred) > 100 * 1024 * 1024"""))
def _(t: Tables) -> DataFrame:
    return alarms.large_transfers(t.parsed)


def packet_events(t: Tables) -> DataFrame:
    """A packet line for every event, parsed."""
    lines = t.places.select("event_id", "user_id", "source_file", "line_number", "log_type", "log_ts")
    parts = [F.date_format("log_ts", "yyyy-MM-dd HH:mm:ss"), ".5 192.168.7.", c("user_id") % 4, ":50123 -> 10.0.0.", c("event_id") % 3,
             ":80 [ACK] Seq=0 Win=1024 Len=", (c("user_id") % 50) * 1_000_000]
    line = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return alarms.packet_events(extract.parse_packets(lines.withColumn("line", line)))


@query("a13_packet_transfers", sql("raw", """
SELECT '192.168.7.' || user_id % 4 AS source_ip, 50123 AS source_port, '10.0.0.' || event_id % 3 AS dest_ip, 80 AS dest_port, 'TCP' AS protocol,
    CAST(sum((user_id % 50) * 1000000) AS BIGINT) AS bytes FROM raw GROUP BY ALL HAVING sum((user_id % 50) * 1000000) > 100 * 1024 * 1024"""))
def _(t: Tables) -> DataFrame:
    return alarms.large_transfers(packet_events(t))


@query("a14_packet_rates", sql("raw", """
SELECT '192.168.7.' || user_id % 4 AS source_ip, date_trunc('minute', log_ts) AS window_start, count(*) AS connections
FROM raw GROUP BY ALL HAVING count(*) > 10"""))
def _(t: Tables) -> DataFrame:
    return alarms.per_minute_rates(packet_events(t))


@query("a14_request_rates", sql("ev", f"""
SELECT source_ip, {bucket(1)} AS window_start, count(*) AS connections FROM ev WHERE kind = 'NETWORK' GROUP BY ALL HAVING count(*) > 10"""))
def _(t: Tables) -> DataFrame:
    return alarms.per_minute_rates(t.parsed)


@query("a14_service_rates", sql("ev", f"""
SELECT service, lim AS per_minute_limit, {bucket(1)} AS window_start, count(*) AS requests FROM ev e
JOIN {values([(s.service, p, s.protocol, s.per_minute_limit) for s in catalog.SERVICES for p in s.ports])} s(service, port, proto, lim)
ON e.dest_port = s.port AND upper(e.protocol) = s.proto WHERE kind = 'NETWORK' GROUP BY ALL HAVING count(*) > lim"""))
def _(t: Tables) -> DataFrame:
    return alarms.service_rates(t.parsed)


@query("a14_dns_rates", sql("raw", f"""
WITH {DNS_EVENTS}
SELECT source_ip, date_trunc('minute', event_time) AS window_start, count(*) AS queries FROM dns WHERE dest_port = 53 AND protocol = 'UDP'
GROUP BY ALL HAVING count(*) > 3"""))
def _(t: Tables) -> DataFrame:
    lines = t.derived.withColumn("line", dns_line(c("event_id"), c("log_ts")))
    return alarms.dns_rates(extract.parse_events(lines, YEAR), 3)


@query("a15_process_connections", sql("ev", f"""
SELECT name AS process_name, count(*) AS connections, m AS max_connections, count(*) > any_value(m) AS over_limit FROM ev
JOIN {values([(p.process_name, p.max_connections) for p in catalog.TRUSTED_PROCESSES])} t(name, m) ON lower(process_name) = name
WHERE kind = 'NETWORK' GROUP BY name, m"""))
def _(t: Tables) -> DataFrame:
    return alarms.process_connections(t.parsed)


# -- windows and ranking -----------------------------------------------------------

@query("w1_raw_context", sql("findings", f"""
WITH before AS (SELECT source_file, line_number, array_to_string(list(line) OVER (PARTITION BY source_file ORDER BY line_number
    ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), chr(10)) AS prev FROM raw)
SELECT f.source_file, f.line_number, CASE WHEN prev IS NULL OR prev = '' THEN 'No recent raw log context available.'
    ELSE 'Raw Log Context (Lines around ' || f.line_number || '):' || chr(10) || prev END AS context
FROM findings f JOIN before b ON f.source_file = b.source_file AND f.line_number = b.line_number WHERE NOT wins"""))
def _(t: Tables) -> DataFrame:
    needs = t.parsed.select("source_file", "line_number", "line", c("rule").isNotNull().alias("ruled"))
    before = running.preceding_lines(needs, c("ruled")).select(
        "source_file", "line_number", running.raw_context(c("line_number"), c("previous")).alias("context"))
    ruled = t.findings.filter("verdict_source = 'rule'").select("source_file", "line_number")
    # A hash join on the keys, so that the texts are not sorted.
    return before.join(ruled.hint("shuffle_hash"), ["source_file", "line_number"])


@query("w1_split_context", sql("root_hits", f"""
WITH n AS ({NUMBERED}), b AS (SELECT chunk, line_number, event_id, coalesce(array_to_string(list(line) OVER (PARTITION BY chunk ORDER BY line_number
    ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), chr(10)), '') AS previous FROM n)
SELECT chunk, line_number, previous FROM b WHERE event_id + 1 IN (SELECT line_number FROM root_hits)"""))
def _(t: Tables) -> DataFrame:
    # Text files in several splits each: their lines stay where they are read.
    spark, path = session.prepare(t.spark.newSession()), written_lines(t)
    with session.setting(spark, "spark.sql.files.maxPartitionBytes", "16k"):
        # The small splits share tasks, or each would be a task and a file.
        lines = logs.clean_lines(logs.read_text(spark, path, most_tasks=4 * spark.sparkContext.defaultParallelism))
        ruled = session.land(matching.best_rule(lines), "ruled")
    found = running.preceding_lines(ruled, c("rule").isNotNull())
    return found.select(chunk_of(c("source_file")), "line_number", F.array_join("previous", "\n").alias("previous"))


@query("w2_running_frequency", sql("scored", f"SELECT {KEY}, frequency FROM dyn"))
def _(t: Tables) -> DataFrame:
    return running.running_frequency(t.parsed)


@query("w3_trailing_correlation", sql("scored", f"SELECT {KEY}, CAST(w_pair AS BIGINT) AS in_window FROM dyn WHERE kind = 'NETWORK'"))
def _(t: Tables) -> DataFrame:
    points = t.parsed.filter("kind = 'NETWORK'").select(
        "source_file", "line_number", "event_time", "source_ip", "dest_ip", F.lit(1).cast("bigint").alias("in_window"))
    counted = running.trailing_count(points, ["source_file", "source_ip", "dest_ip"], ["in_window"], 300)
    return points.drop("in_window").join(counted, ["source_file", "source_ip", "dest_ip", "event_time"]).select(
        "source_file", "line_number", "in_window")


@query("w4_severity_examples", sql("findings", """
SELECT severity, CAST(p AS INTEGER) AS position, source_file, line_number, '- Sev ' || severity || ': ' || left(content, 120) || '...' AS example
FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY source_file, line_number) AS p FROM findings WHERE severity >= 4) WHERE p <= 3"""))
def _(t: Tables) -> DataFrame:
    return report.examples(t.findings)


@query("w5_finding_ordinal", sql("findings", f"""
SELECT {KEY}, row_number() OVER (PARTITION BY source_file ORDER BY line_number) AS ordinal FROM findings"""))
def _(t: Tables) -> DataFrame:
    return report.numbered(t.findings.select("source_file", "line_number"))


@query("t1_highest_first", sql("findings", f"SELECT {KEY}, severity, content FROM findings ORDER BY severity DESC, source_file, line_number"))
def _(t: Tables) -> DataFrame:
    return report.highest_first(t.findings).select("source_file", "line_number", "severity", "content")


@query("t2_top_categories", sql("findings", """
SELECT 'category' AS kind, category AS name, findings FROM (SELECT category, count(*) AS findings FROM first_category GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 5)
UNION ALL SELECT 'factor', factor, findings FROM (SELECT factor, count(*) AS findings FROM factor_rows GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 5)
WHERE factor NOT LIKE '%RiskMitigation%'"""))
def _(t: Tables) -> DataFrame:
    tops = report.top_categories(t.findings).select(F.lit("category").alias("kind"), c("category").alias("name"), "findings")
    factors = report.top_risk_factors(t.findings).select(F.lit("factor").alias("kind"), c("factor").alias("name"), "findings")
    return tops.unionByName(factors)


@query("t4_next_page", sql("findings", f"""
SELECT {KEY}, severity FROM findings WHERE source_file > 'day1.log' OR (source_file = 'day1.log' AND line_number > 500)
ORDER BY source_file, line_number LIMIT 50"""))
def _(t: Tables) -> DataFrame:
    return report.next_page(t.findings, "day1.log", 500).select("source_file", "line_number", "severity")


@query("t4_findings_page", sql("findings", f"SELECT {KEY}, severity FROM findings ORDER BY source_file, line_number LIMIT 50 OFFSET 100"))
def _(t: Tables) -> DataFrame:
    return report.page(t.findings, 3).select("source_file", "line_number", "severity")


# Phrases of several benign rules at once, set behind every line.
_OVERLAPS = (" dns query db.internal dns response NXDOMAIN", " dns query google.com db.local", " tcp syn ack 10.0.0.7",
             " http GET /a 10.0.0.7 smb negotiate 10.0.0.8", " https POST /b 10.0.0.9", " dhcp offer discover ntp client",
             " arp who-has 10.0.0.1 arp reply 10.0.0.1")


@query("t5_longest_rule_first", sql("raw", f"""
WITH both_lines AS (SELECT line FROM raw UNION ALL SELECT line || [{','.join(q(o) for o in _OVERLAPS)}][line_number % {len(_OVERLAPS)} + 1] FROM raw)
SELECT description, count(*) AS n_lines FROM (SELECT {benign_case('description')} AS description FROM both_lines) WHERE description IS NOT NULL GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    more = F.array(*map(F.lit, _OVERLAPS))[(c("line_number") % len(_OVERLAPS)).cast("int")]
    lines = t.lines.select("line").unionByName(t.lines.select(F.concat("line", more).alias("line")))
    tagged = matching.benign_rule(lines).filter("benign is not null")
    return tagged.groupBy(c("benign")["description"].alias("description")).agg(F.count(F.lit(1)).alias("n_lines"))


_FAMILIES = values([(r.rule_id, k, r.source) for r, k in zip(catalog.THREAT_RULES, catalog.THREAT_KEYS, strict=True)])


@query("u1_rule_family_union", sql("threat_hits", f"""
SELECT f.key AS rule_key, f.family, h.severity, count(*) AS hits FROM threat_hits h JOIN {_FAMILIES} f(rule_id, key, family) USING (rule_id) GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    rules = matching.merged_families()
    hits = matching.rule_hits(t.lines, tuple(r for _, r in rules)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    names = reference.inline_table(t.spark, [(r.rule_id, key, r.source, r.severity) for key, r in rules],
                                   "rule_id:int,rule_key:string,family:string,severity:int")
    return names.join(hits, "rule_id").select("rule_key", "family", "severity", "hits")


@query("u4_unexpected_ports", sql("scored", f"""
SELECT {KEY}, array_to_string(unexpected, ',') AS unexpected FROM checked WHERE kind = 'NETWORK' AND t_base IS NOT NULL"""))
def _(t: Tables) -> DataFrame:
    known = lookups.with_trusted(t.parsed.filter("kind = 'NETWORK'")).filter("trusted is not null")
    ports = F.array_sort(F.array_except(F.array("source_port", "dest_port"), c("trusted")["allowed_ports"]))
    return known.select("source_file", "line_number", F.array_join(ports.cast("array<string>"), ",").alias("unexpected"))


@query("u5_distinct_categories", sql("findings", "SELECT DISTINCT category FROM indicators ORDER BY 1"))
def _(t: Tables) -> DataFrame:
    return report.categories(t.findings)
