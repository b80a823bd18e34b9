"""Streaming (R): each query reads the events table as a stream and runs it to the end of the input.

The input is closed at its end, so the windows that were still open are written too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.oracle_base import sql, values
from checks.registry import query
from checks.sources_events import chunk_of, written_lines
from checks.tables import YEAR, Tables
from threatlake import catalog, session
from threatlake.operators import running, triage
from threatlake.sources import carrier
from threatlake.streaming import streams

c = F.col


LINE = ("source_file", "line_number", "line", "log_type")


#: Events of a state partition of the counters; a log of fewer than twice as many has two.
STATE_ROWS = 50_000


def derived_stream(t: Tables, rocksdb: bool = False) -> DataFrame:
    """The events table as a stream of lines, in a session of its own."""
    cores = t.spark.sparkContext.defaultParallelism
    # The counters keep seven stores in each state partition, so a small log has few partitions there.
    partitions = min(cores, max(2, t.table("events").count() // STATE_ROWS)) if rocksdb else None
    own = streams.own_session(t.spark, partitions, rocksdb)
    rows = own.readStream.schema(t.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    # The table is one file, so one task would read it all: spread it over the cores.
    return carrier.derive_lines(rows.repartition(cores))


def alarm_lines(rows: DataFrame) -> DataFrame:
    """The line of each event and a DNS line, both from one row: the table is read and dealt out once."""
    dns = F.struct(F.lit("dns.log").alias("source_file"), "line_number", dns_line(c("event_id"), c("log_ts")).alias("line"), "log_type")
    return rows.select(F.inline(F.array(F.struct(*LINE), dns)))


def line_stream(t: Tables, rocksdb: bool = False) -> DataFrame:
    return derived_stream(t, rocksdb).select(*LINE)


def run_closed(t: Tables, label: str, make, lines: DataFrame | None = None) -> DataFrame:
    """Runs `make` of the events to the end of the input and closes it."""
    lines, close_lines = streams.closable(line_stream(t) if lines is None else lines)
    events, feed = streams.landed_events(lines, YEAR)

    def close() -> None:
        close_lines()
        feed()

    return streams.run_available(make(events), label, close=close)


def _stateless_sql() -> str:
    return sql("best scored", """
WITH alone AS (SELECT *, CASE WHEN kind = 'NETWORK' THEN connection_risk * trust_multiplier * CAST(benign_factor AS DOUBLE)
    ELSE greatest(trust_multiplier, command_risk) * CASE WHEN time_factor > 1.01 THEN time_factor ELSE CAST(1 AS DOUBLE) END END AS u FROM risk2),
a2 AS (SELECT *, CASE WHEN kind = 'NETWORK' AND (connection_risk < 0.5 OR trust >= 0.9) AND u > 1
        THEN greatest(CAST(0.5 AS DOUBLE), least(connection_risk * trust_multiplier * CAST(benign_factor AS DOUBLE), u * CAST(0.3 AS DOUBLE)))
    WHEN kind = 'PROCESS' AND trust >= 0.9 AND command_risk < 2.5 AND u > 1
        THEN greatest(CAST(0.5 AS DOUBLE), least(greatest(CAST(1 AS DOUBLE), command_risk) * (1 + (time_factor - 1) * CAST(0.1 AS DOUBLE)), u * CAST(0.25 AS DOUBLE)))
    ELSE u END AS r FROM alone),
a3 AS (SELECT *, CASE WHEN kind = 'NETWORK' THEN CASE WHEN r < 1 THEN 1 WHEN r < 2 THEN 2 WHEN r < 4 THEN 3 WHEN r < 6 THEN 4 ELSE 5 END
    ELSE CASE WHEN r < 1.2 THEN 1 WHEN r < 2.2 THEN 2 WHEN r < 4.5 THEN 3 WHEN r < 7 THEN 4 ELSE 5 END END AS s FROM a2),
a4 AS (SELECT * FROM a3 WHERE s >= 2 AND NOT suppressed),
both_sides AS (SELECT coalesce(a.source_file, b.source_file) AS source_file, coalesce(a.line_number, b.line_number) AS line_number, a.s, b.severity AS rs,
    a.s IS NOT NULL AND (b.severity IS NULL OR a.s >= b.severity OR (b.category IN ('AUTH','NETWORK','BASELINE') AND b.severity <= 2)) AS wins
    FROM a4 a FULL OUTER JOIN best b ON a.source_file = b.source_file AND a.line_number = b.line_number)
SELECT source_file, line_number, CAST(CASE WHEN wins THEN s ELSE rs END AS INTEGER) AS severity, CASE WHEN wins THEN 'dynamic' ELSE 'rule' END AS verdict_source FROM both_sides""")


@query("r1_streaming_findings", _stateless_sql())
def _(t: Tables) -> DataFrame:
    found = streams.findings(line_stream(t), YEAR).select("source_file", "line_number", "severity", "verdict_source")
    return streams.run_available(found, "r1")


def _sliding(width: str, step: int) -> str:
    """Each event with the end of every sliding window that holds it."""
    seconds = {"300": 300, "60": 60}[width]
    return f"""
slid AS (SELECT *, TIMESTAMP '1970-01-01' + to_seconds((CAST(floor(epoch(event_time)) AS BIGINT) // {step} - g.i) * {step}) AS w_start
    FROM ev, range({seconds // step}) g(i) WHERE kind <> 'GENERIC'),
windows AS (SELECT *, w_start + INTERVAL {seconds} SECONDS AS w_end FROM slid)"""


@query("r2_event_retention", sql("ev", f"""
WITH {_sliding('300', 60)}
SELECT w_end AS window_end, source_file, CASE kind WHEN 'NETWORK' THEN 'pair:' || source_ip || ':' || dest_ip ELSE 'name:' || process_name END AS key,
    count(*) AS events FROM windows GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    return run_closed(t, "r2", streams.retained)


@query("r2_retained_events", sql("ev", """
WITH k AS (SELECT source_file, coalesce(CASE kind WHEN 'NETWORK' THEN 'pair:' || source_ip || ':' || dest_ip ELSE 'name:' || process_name END, '') AS key,
    event_time, count(*) AS events FROM ev WHERE kind <> 'GENERIC' AND event_time IS NOT NULL GROUP BY ALL)
SELECT source_file, key, event_time, events, CAST(sum(events) OVER w AS BIGINT) AS retained, min(event_time) OVER w AS oldest FROM k
WINDOW w AS (PARTITION BY source_file, key ORDER BY event_time RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND CURRENT ROW)"""))
def _(t: Tables) -> DataFrame:
    return run_closed(t, "r2e", streams.retained_events, line_stream(t, rocksdb=True))


@query("r3_expiring_counters", sql("scored", """
WITH gaps AS (SELECT *, CASE WHEN event_time - lag(event_time) OVER (PARTITION BY source_file, freq_key, freq_source ORDER BY event_time, line_number)
    > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS anew FROM known),
spans AS (SELECT *, sum(anew) OVER (PARTITION BY source_file, freq_key, freq_source ORDER BY event_time, line_number) AS span FROM gaps)
SELECT source_file, line_number, row_number() OVER (PARTITION BY source_file, freq_key, freq_source, span ORDER BY event_time, line_number) AS frequency FROM spans"""))
def _(t: Tables) -> DataFrame:
    counted = run_closed(t, "r3", streams.running_counters, line_stream(t, rocksdb=True))
    return counted.select("source_file", "line_number", "frequency")


@query("r4_hourly_baseline", sql("ev", f"""
WITH c AS (SELECT date_trunc('hour', event_time) AS hour, CASE kind WHEN 'NETWORK' THEN 'network_' || protocol || '_' || dest_port ELSE 'process_' || process_name END AS event_type,
    CASE kind WHEN 'NETWORK' THEN source_ip ELSE "user" END AS src, count(*) AS n FROM ev WHERE kind <> 'GENERIC' GROUP BY ALL)
SELECT hour, event_type, round(sum(n) / count(*), 6) AS baseline FROM c GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    out = run_closed(t, "r4", streams.hourly_baseline)
    return out.withColumn("baseline", F.round("baseline", 6))


@query("r5_rate_alarms", sql("ev", f"""
WITH {_sliding('60', 10)}
SELECT w_start AS window_start, source_ip, dest_ip, count(*) AS connections FROM windows WHERE kind = 'NETWORK'
GROUP BY ALL HAVING count(*) > 5"""))
def _(t: Tables) -> DataFrame:
    return run_closed(t, "r5", lambda events: streams.rate_alarms(events, 5))


@query("r6_network_with_process", sql("ev", f"""
WITH p AS (SELECT source_file, process_name, date_trunc('second', event_time) AS second, count(*) AS process_events FROM ev
    WHERE kind = 'PROCESS' GROUP BY ALL)
SELECT n.source_file, n.line_number, n.process_name, n.event_time, second, process_events FROM ev n JOIN p ON n.source_file = p.source_file
    AND n.process_name = p.process_name AND p.second BETWEEN n.event_time - INTERVAL 300 SECONDS AND n.event_time
WHERE n.kind = 'NETWORK'"""))
def _(t: Tables) -> DataFrame:
    return run_closed(t, "r6", streams.network_with_process)


@query("r4_stream_deviation", sql("ev", """
WITH n AS (SELECT date_trunc('hour', event_time) AS hour, CASE kind WHEN 'NETWORK' THEN 'network_' || protocol || '_' || dest_port ELSE 'process_' || process_name END AS event_type,
    CASE kind WHEN 'NETWORK' THEN source_ip ELSE "user" END AS event_source, count(*) AS events FROM ev WHERE kind <> 'GENERIC' GROUP BY ALL),
b AS (SELECT hour + INTERVAL 1 HOUR AS hour, event_type, sum(events) / count(*) AS baseline FROM n GROUP BY ALL),
d AS (SELECT n.*, baseline, (events - baseline) / baseline AS deviation FROM n LEFT JOIN b ON n.hour = b.hour AND n.event_type = b.event_type)
SELECT hour, event_type, event_source, events, round(baseline, 6) AS baseline, CAST(CASE WHEN baseline IS NULL THEN CASE WHEN events > 10 THEN 5 ELSE 0 END
    WHEN deviation <= 0.1 THEN 0 WHEN deviation <= 0.5 THEN 2 WHEN deviation <= 1 THEN 3 WHEN deviation <= 2 THEN 4 ELSE 5 END AS DOUBLE) AS score FROM d"""))
def _(t: Tables) -> DataFrame:
    return run_closed(t, "r4d", streams.stream_deviation).withColumn("baseline", F.round("baseline", 6))


#: Connections to a name server, a third of them over TCP and a third to another port.
DNS_EVENTS = """
dns AS (SELECT log_ts AS event_time, 'NETWORK' AS kind, '192.168.7.' || event_id % 4 AS source_ip, 50123 AS source_port, '8.8.8.8' AS dest_ip,
    CASE WHEN event_id % 3 = 2 THEN 443 ELSE 53 END AS dest_port, CASE WHEN event_id % 3 = 1 THEN 'TCP' ELSE 'UDP' END AS protocol,
    CAST(0 AS BIGINT) AS bytes_transferred, 'Allowed' AS status FROM raw)"""


def dns_line(event_id: F.Column, time: F.Column) -> F.Column:
    parts = [F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.lit(" EventID=5156 Application Name: C:\\Windows\\System32\\svchost.exe Source Address: 192.168.7."),
             (event_id % 4).cast("string"), F.lit(" Source Port: 50123 Dest Address: 8.8.8.8 Dest Port: "),
             F.when(event_id % 3 == 2, "443").otherwise("53"), F.lit(" Protocol: "), F.when(event_id % 3 == 1, "6").otherwise("17")]
    return F.concat(*parts)


def _grouped(alarm: str, source: str, detail: str, width: str, value: str, least: str, where: str, rows: str = "net") -> str:
    return (f"SELECT '{alarm}' AS alarm, {source} AS source_ip, {detail} AS detail, time_bucket(INTERVAL {width}, event_time, TIMESTAMP '1970-01-01') AS window_start, "
            f"CAST({value} AS BIGINT) AS value FROM {rows} WHERE {where} GROUP BY ALL HAVING {value} >= {least}")


_SERVICES = values([(s.service, p, s.protocol, s.per_minute_limit) for s in catalog.SERVICES for p in s.ports])
_LIMITS = streams.AlarmLimits(scanned_ports=3, transfer_mb=20, dns_queries=3)


@query("r7_threshold_alarms", sql("ev", f"""
WITH {DNS_EVENTS},
net AS (SELECT event_time, kind, source_ip, source_port, dest_ip, dest_port, protocol, bytes_transferred, status FROM ev WHERE kind = 'NETWORK'
    UNION ALL BY NAME SELECT * FROM dns),
served AS (SELECT * FROM net JOIN {_SERVICES} s(service, port, proto, lim) ON dest_port = port AND upper(protocol) = proto)
""" + " UNION ALL ".join([
    _grouped("failed_logins", "source_ip", "NULL", "5 MINUTES", "count(*)", "6", "status = 'Failed'"),
    _grouped("port_scan", "source_ip", "NULL", "5 MINUTES", "count(DISTINCT dest_port)", "3", "true"),
    _grouped("connection_rate", "source_ip", "NULL", "1 MINUTE", "count(*)", "11", "true"),
    _grouped("dns_rate", "source_ip", "NULL", "1 MINUTE", "count(*)", "4", "dest_port = 53 AND upper(protocol) = 'UDP'"),
    _grouped("service_rate", "NULL", "service", "1 MINUTE", "count(*)", "any_value(lim) + 1", "true", "served"),
    _grouped("large_transfer", "source_ip", "source_ip || ':' || source_port || ' -> ' || dest_ip || ':' || dest_port || ' ' || protocol", "1 HOUR",
             "sum(bytes_transferred)", "20 * 1024 * 1024 + 1", "true")])))
def _(t: Tables) -> DataFrame:
    return run_closed(t, "r7", lambda events: streams.threshold_alarms(events, _LIMITS), alarm_lines(derived_stream(t)))


@query("r1_stream_bundles", _stateless_sql().replace("SELECT source_file, line_number, CAST(CASE WHEN wins", """, numbered AS (
    SELECT (line_number - 1) // 1000 AS chunk, row_number() OVER (PARTITION BY (line_number - 1) // 1000 ORDER BY line_number) AS ordinal, """
    "CAST(CASE WHEN wins", 1).replace("'rule' END AS verdict_source FROM both_sides", """'rule' END AS verdict_source FROM both_sides)
SELECT 'bundle' AS kind, chunk, (ordinal - 1) // 50 AS position, count(*) AS value FROM numbered GROUP BY ALL
UNION ALL SELECT 'finding', chunk, ordinal, severity FROM numbered
UNION ALL SELECT 'refined', chunk, ordinal, ordinal % 6 FROM numbered WHERE ordinal % 3 <> 0"""))
def _(t: Tables) -> DataFrame:
    own, path = streams.own_session(t.spark), written_lines(t)
    with session.setting(own, "spark.sql.files.maxPartitionBytes", "8k"):  # so that each file has several splits
        found = streams.run_available(streams.findings(
            streams.read_text_stream(own, path, most_tasks=4 * t.spark.sparkContext.defaultParallelism), YEAR), "r1b")
    placed = session.land(running.ordinal(found.select("source_file", "line_number", "severity"), "position"), "r1b-ordinals")
    says = F.concat(F.lit("IS_FALSE_POSITIVE: "), F.when(c("position") % 3 == 0, "true").otherwise("false"),
                    F.lit("\nCONFIDENCE: 0.9\nREVISED_SEVERITY: "), (c("position") % 6).cast("string"))
    verdicts = placed.select("source_file", "line_number", F.lit("false_positive").alias("kind"), says.alias("text"))
    # Ordinals are as many as findings: they are not sent through the driver, however small their file is.
    refined = triage.refine(found, verdicts).join(placed.drop("severity").hint("merge"), ["source_file", "line_number"])

    def rows(kind: str, df: DataFrame, position: str, value: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), chunk_of(c("source_file")), c(position).cast("bigint").alias("position"),
                         c(value).cast("bigint").alias("value"))

    return rows("bundle", triage.evidence_bundles(found), "bundle", "findings").unionByName(
        rows("finding", placed, "position", "severity")).unionByName(rows("refined", refined, "position", "revised_severity"))
