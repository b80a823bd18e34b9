"""Sources and event extraction (S, P)."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.oracle_base import q, sql, values
from checks.registry import query
from checks.tables import YEAR, Tables
from threatlake import catalog, session
from threatlake.functions import events as ev
from threatlake.functions import net, text, times
from threatlake.operators import extract, matching, report, triage
from threatlake.sources import carrier, json_arrays, logs, reference, sinks
from threatlake.streaming import streams

CHUNK = 1000
c = F.col


def written_lines(t: Tables) -> str:
    """The derived lines as text files of up to CHUNK lines, in order."""
    path = session.new_folder(t.spark, "text")
    rows = t.derived.select(F.floor(c("event_id") / CHUNK).alias("chunk"), "event_id", "line")
    rows.repartition("chunk").sortWithinPartitions("chunk", "event_id").drop("event_id").write.partitionBy(
        "chunk").text(path)
    return path


def chunk_of(path) -> F.Column:
    return F.regexp_extract(path, r"chunk=(\d+)", 1).cast("bigint").alias("chunk")


NUMBERED = f"SELECT event_id // {CHUNK} AS chunk, row_number() OVER (PARTITION BY event_id // {CHUNK} ORDER BY event_id) AS line_number, * EXCLUDE (line_number) FROM raw"


@query("s1_text_scan", sql("raw", f"SELECT chunk, line_number, line FROM ({NUMBERED})"))
def _(t: Tables) -> DataFrame:
    return logs.read_text(t.spark, written_lines(t)).select(chunk_of(c("source_file")), "line_number", "line")


@query("s2_line_hygiene", sql("doc_lines", f"""
SELECT lang, count(*) AS kept, CAST(sum(length(l)) AS BIGINT) AS chars FROM (
    SELECT lang, trim(replace(line, chr(0), ''), {q(logs.WHITE_SPACE)}) AS l FROM doc_lines WHERE length(line) + 1 <= 2048)
WHERE l <> '' GROUP BY lang"""))
def _(t: Tables) -> DataFrame:
    return logs.clean_lines(t.document_lines, catalog.MAX_LINE_LENGTH).groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum(F.length("line")).alias("chars"))


@query("s3_undecodable_bytes", sql("raw", "SELECT line_number, line FROM raw"))
def _(t: Tables) -> DataFrame:
    broken = F.concat(F.unhex(F.lit("FF")), F.encode("line", "utf-8"), F.unhex(F.lit("C3"))).cast("string")
    return t.derived.select("line_number", logs.drop_bad_bytes(broken).alias("line"))


def json_documents(t: Tables) -> DataFrame:
    """All lines as JSON documents: an array for each even block, an object for each line of an odd one."""
    item = F.to_json(F.struct("event_id", "line"))
    rows = t.derived.select("event_id", F.floor(c("event_id") / 200).alias("block"), item.alias("item"))
    arrays = rows.filter("block % 2 = 0").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "item")))["item"].alias("items"))
    arrays = arrays.select((c("block") * 200).alias("document"), F.concat(
        F.lit(" [ "), F.array_join("items", " ,\n "), F.lit("]")).alias("text"))
    return arrays.unionByName(rows.filter("block % 2 = 1").select(c("event_id").alias("document"), c("item").alias("text")))


@query("s4_json_documents", sql("raw", """
SELECT CASE WHEN block % 2 = 0 THEN block * 200 ELSE event_id END AS document, CASE WHEN block % 2 = 0 THEN event_id % 200 + 1 ELSE 1 END AS item_number,
    event_id, line FROM raw"""))
def _(t: Tables) -> DataFrame:
    docs = json_documents(t)
    scalars = docs.select("document", F.lit("5").alias("text"))
    items = logs.explode_documents(docs.unionByName(scalars))
    parsed = F.from_json("item", "event_id bigint, line string")
    return items.select("document", "item_number", parsed.alias("v")).select("document", "item_number", "v.*")


@query("s4_split_arrays", sql("raw", f"SELECT event_id // {2 * CHUNK} AS document, event_id % {2 * CHUNK} + 1 AS item_number, event_id, line FROM raw"))
def _(t: Tables) -> DataFrame:
    path = session.new_folder(t.spark, "json")
    rows = t.derived.select("event_id", F.floor(c("event_id") / (2 * CHUNK)).alias("document"),
                            F.to_json(F.struct("event_id", "line")).alias("item"))
    arrays = rows.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("event_id", "item")))["item"].alias("items"))
    arrays.select("document", F.concat(F.lit("["), F.array_join("items", ",\n  "), F.lit("]")).alias("text")).write.partitionBy(
        "document").text(path)
    own = streams.own_session(t.spark)
    own.conf.set("spark.sql.files.maxPartitionBytes", "32k")  # so that each document has several splits
    parsed = F.from_json("line", "event_id bigint, line string")
    items = json_arrays.read_json_arrays(own, path, most_tasks=4 * t.spark.sparkContext.defaultParallelism).select(
        F.regexp_extract("source_file", r"document=(\d+)", 1).cast("bigint").alias("document"), c("line_number").alias("item_number"), parsed.alias("v"))
    return items.select("document", "item_number", "v.*")


@query("s5_json_lines", sql("raw", "SELECT line_number, json_valid(line) AS is_json FROM raw"))
def _(t: Tables) -> DataFrame:
    return t.lines.select("line_number", F.try_parse_json("line").isNotNull().alias("is_json"))


def _file_scan_sql() -> str:
    return sql("raw", f"""WITH numbered AS (SELECT event_id // {CHUNK} AS chunk,
    row_number() OVER (PARTITION BY event_id // {CHUNK} ORDER BY event_id) AS n, * FROM raw),
""" + _hits("numbered") + """
SELECT chunk, line_number, max(severity) AS severity, string_agg(description, ' | ' ORDER BY rule_id) AS descriptions
FROM scan2 GROUP BY chunk, line_number""")


def _hits(source: str) -> str:
    from checks.oracle_base import hits_cte
    body = hits_cte("scan2", catalog.SCAN_RULES, f"(SELECT chunk AS source_file, n AS line_number, line FROM {source})")
    return body.replace("scan2 AS (SELECT h.*,", "scan2 AS (SELECT h.*, h.source_file AS chunk,")


def _file_scan(t: Tables, log_type: str) -> DataFrame:
    found = matching.file_findings(logs.strip_lines(logs.read_text(t.spark, written_lines(t), log_type)))
    return found.select(chunk_of(c("source_file")), "line_number", "severity",
                        F.array_join(c("indicators")["description"], " | ").alias("descriptions"))


@query("s6_memory_text_scan", _file_scan_sql())
def _(t: Tables) -> DataFrame:
    return _file_scan(t, "volatility_text")


@query("s7_packet_text_scan", _file_scan_sql())
def _(t: Tables) -> DataFrame:
    return _file_scan(t, "wireshark")


@query("s8_generic_text_scan", _file_scan_sql())
def _(t: Tables) -> DataFrame:
    return _file_scan(t, "generic")


@query("s9_format_dispatch", sql("raw", """
SELECT 'generic' AS log_type, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM raw
UNION ALL SELECT 'volatility_json', count(DISTINCT event_id // 1000), CAST(sum(length('{"event_id":' || event_id || ',"line_number":' || line_number || '},'))
    + count(DISTINCT event_id // 1000) * (length('{"items":[]}') - 1) AS BIGINT) FROM raw"""))
def _(t: Tables) -> DataFrame:
    parent = session.new_folder(t.spark, "mixed")
    rows = t.derived.withColumn("chunk", F.floor(c("event_id") / CHUNK))
    # As many tasks as cores write the many small files, however few bytes they are.
    tasks = t.spark.sparkContext.defaultParallelism
    rows.repartition(tasks, "chunk").sortWithinPartitions("chunk", "event_id").select("chunk", "line").write.partitionBy(
        "chunk").text(f"{parent}/kind=text")
    # One document for each chunk, an object that lists its lines.
    places = t.places.select("event_id", "line_number", F.floor(c("event_id") / CHUNK).alias("chunk"))
    documents = places.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("event_id", "line_number"))).alias("items"))
    documents.repartition(tasks, "chunk").write.partitionBy("chunk").json(f"{parent}/kind=json")
    return logs.read_logs(t.spark, parent).groupBy("log_type").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))


@query("s10_rule_catalogue", sql("root_hits", f"""
SELECT r.*, CAST(count(h.rule_id) AS BIGINT) AS hits FROM {values([(r.rule_id, r.description, r.category, r.severity, r.source) for r in catalog.ROOT_RULES])}
r(rule_id, description, category, severity, source) LEFT JOIN root_hits h ON r.rule_id = h.rule_id GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    hits = matching.rule_hits(t.lines, catalog.ROOT_RULES).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    rules = reference.rules(t.spark, catalog.ROOT_RULES).select("rule_id", "description", "category", "severity", "source")
    return rules.join(hits, "rule_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("bigint")))


# The exported file, written out by hand.
_EXPORTED = r"""
{"pattern":"(?i)(scan|probe|discover).*port|(?:\\b\\d{1,5}\\b.*){5,}","description":"Port scan detected","severity":4,"category":"RECON"}
{"pattern":"(?i)(failed|invalid|wrong).*(?:login|password|authentication)|authentication\\s+failure","description":"Potential brute force attempt","severity":4,"category":"ATTACK"}
{"pattern":"(?i)(?:outbound|external).*(?:connection|traffic).*(?:unknown|suspicious|malicious)","description":"Suspicious outbound connection","severity":3,"category":"MALWARE"}
{"pattern":"(?i)dns.*(?:query|lookup).*(?:malicious|suspicious|blocked)","description":"DNS query to known malicious domain","severity":5,"category":"C2"}
{"pattern":"(?i)(?:GET|POST|PUT).*(?:eval|exec|system|cmd|shell|script|wget|curl)","description":"HTTP request with malicious payload","severity":5,"category":"EXPLOIT"}
{"pattern":"(?i)(?:failed|invalid|error).*(?:login|auth|password)","description":"Failed authentication attempt","severity":2,"category":"AUTH"}
{"pattern":"(?i)(?:unusual|abnormal|unexpected).*(?:protocol|behavior|traffic)","description":"Unusual protocol behavior","severity":3,"category":"ANOMALY"}
{"pattern":"(?i)(?:upload|transfer|copy).*(?:large|multiple|suspicious).*(?:file|data)","description":"Data exfiltration attempt","severity":5,"category":"EXFIL"}
{"pattern":"(?i)(?:sudo|su|runas|privilege|admin).*(?:escalation|elevation)","description":"Privilege escalation attempt","severity":5,"category":"PRIVESC"}
{"pattern":"(?i)(?:access|read|write).*(?:denied|unauthorized|suspicious)","description":"Suspicious file access","severity":3,"category":"ACCESS"}
{"pattern":"(?i)(?:syn|ack|fin|rst).*flood|(?:ddos|dos).*attack","description":"Suspicious network traffic pattern","severity":4,"category":"NETWORK"}
{"pattern":"(?i)(?:beacon|callback|c2|command.*control)","description":"Malware communication pattern","severity":5,"category":"MALWARE"}
{"pattern":"(?i)(?:cmd\\.exe|powershell|bash).*(?:execute|spawn|run)","description":"Suspicious process execution","severity":4,"category":"PROCESS"}
{"pattern":"(?i)(?:create|modify|delete).*(?:system32|windows|etc)","description":"Suspicious file operation","severity":3,"category":"FILE"}
""".split("\n")[1:-1]


@query("s11_rule_export", sql("scan_hits", f"""
SELECT r.rule_json, count(*) AS hits FROM {values(list(enumerate(_EXPORTED, 1)))} r(rule_id, rule_json)
JOIN scan_hits h ON r.rule_id = h.rule_id GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    path = session.new_folder(t.spark, "rules")
    sinks.export_rules(t.spark, path)
    exported = t.spark.read.text(path).select(
        c("value").alias("rule_json"), F.get_json_object("value", "$.description").alias("description"))
    hits = matching.all_indicators(t.lines, only_hits=True).select(
        F.explode(c("indicators")["description"]).alias("description"))
    hits = hits.groupBy("description").agg(F.count(F.lit(1)).alias("hits"))
    return exported.join(hits, "description").select("rule_json", "hits")


@query("s12_baseline_tables", sql("ev", f"""
SELECT v.name AS process_name, CAST(count(e.line_number) AS BIGINT) AS events FROM {values([(p,) for p in catalog.BASELINE_PROCESSES])} v(name)
LEFT JOIN ev e ON lower(e.process_name) = v.name GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    listed = reference.values(t.spark, "process_name", catalog.BASELINE_PROCESSES)
    counts = t.parsed.groupBy(F.lower("process_name").alias("process_name")).agg(F.count(F.lit(1)).alias("events"))
    return listed.join(counts, "process_name", "left").withColumn("events", F.coalesce("events", F.lit(0).cast("bigint")))


@query("s13_findings_report", sql("ff", """
SELECT source_file, line_number, severity, 'Severity: ' || severity || chr(10) || 'Content: ' || content || chr(10) ||
    'Indicators:' || chr(10) || '- ' || replace(descriptions, ' | ', chr(10) || '- ') || chr(10) AS report FROM ff"""))
def _(t: Tables) -> DataFrame:
    path = session.new_folder(t.spark, "report")
    sinks.write_findings(t.file_findings, path)
    return t.spark.read.parquet(path).select(
        "source_file", "line_number", "severity",
        report.report_text(c("content"), c("severity"), c("indicators")).alias("report"))


# -- extraction ---------------------------------------------------------------

NETWORK_FIELDS = ("source_file", "line_number", "event_time", "source_ip", "dest_ip", "source_port", "dest_port",
                  "protocol", "process_name", "bytes_transferred", "status")
PROCESS_FIELDS = ("source_file", "line_number", "event_time", "process_name", "pid", "user", "command_line", "path", "status")


def _one_parser(t: Tables, key: str, parser, fields: tuple[str, ...]) -> DataFrame:
    staged = t.lines.withColumn("_c", ev.captures(c("line"))[key])
    staged = staged.withColumn("_t", ev.json_texts(c("_c"))) if key == "json" else staged.withColumn("_c", ev.complete(c("_c"), key))
    staged = staged.select("source_file", "line_number", F.explode(F.array(parser(c("_c")))).alias("e")).filter("e is not null")
    return staged.select("source_file", "line_number", *[c("e")[f].alias(f) for f in fields[2:]])


def _columns(fields: tuple[str, ...]) -> str:
    return ", ".join('"user"' if f == "user" else f for f in fields)


@query("p1_process_created", sql("ev", f"SELECT {_columns(PROCESS_FIELDS)} FROM ev WHERE status = 'Created'"))
def _(t: Tables) -> DataFrame:
    return _one_parser(t, "created", ev.process_created, PROCESS_FIELDS)


@query("p2_connection_allowed", sql("ev", f"SELECT {_columns(NETWORK_FIELDS)} FROM ev WHERE status = 'Allowed'"))
def _(t: Tables) -> DataFrame:
    return _one_parser(t, "allowed", ev.connection_allowed, NETWORK_FIELDS)


@query("p3_ssh_login", sql("ev", f"SELECT {_columns(NETWORK_FIELDS)} FROM ev WHERE status IN ('Accepted', 'Failed')"))
def _(t: Tables) -> DataFrame:
    return _one_parser(t, "ssh", lambda x: ev.ssh_login(x, YEAR), NETWORK_FIELDS)


@query("p4_json_network", sql("ev", f"SELECT {_columns(NETWORK_FIELDS)} FROM ev WHERE event_id % 12 = 4"))
def _(t: Tables) -> DataFrame:
    return _one_parser(t, "json", lambda x: ev.json_network(x, YEAR, c("_t")), NETWORK_FIELDS)


@query("p5_json_process", sql("ev", f"SELECT {_columns(PROCESS_FIELDS)} FROM ev WHERE event_id % 12 = 5"))
def _(t: Tables) -> DataFrame:
    return _one_parser(t, "json", lambda x: ev.json_process(x, YEAR, c("_t")), PROCESS_FIELDS)


@query("p6_generic_event", sql("ev", "SELECT source_file, line_number, source, line AS message FROM ev WHERE kind = 'GENERIC'"))
def _(t: Tables) -> DataFrame:
    generic = extract.with_details(t.events).filter("kind = 'GENERIC'")
    return generic.select("source_file", "line_number", "source", c("details")["message"].alias("message"))


@query("p7_parser_cascade", sql("ev", """SELECT source_file, line_number, kind, event_time, source_ip, dest_ip, source_port,
    dest_port, protocol, process_name, bytes_transferred, pid, "user", command_line, path, status, source FROM ev"""))
def _(t: Tables) -> DataFrame:
    return t.events.select("source_file", "line_number", "kind", "event_time", "source_ip", "dest_ip", "source_port",
                           "dest_port", "protocol", "process_name", "bytes_transferred", "pid", "user", "command_line",
                           "path", "status", "source")


@query("p8_timestamp_formats", sql("raw", """
SELECT line_number, CASE event_id % 9 WHEN 2 THEN log_ts + INTERVAL 250 MILLISECONDS WHEN 3 THEN log_ts + INTERVAL 123456 MICROSECONDS
    WHEN 8 THEN NULL ELSE log_ts END AS event_time FROM raw"""))
def _(t: Tables) -> DataFrame:
    ts = c("log_ts")
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss'.25'", "yyyy-MM-dd'T'HH:mm:ss'.123456Z'",
             "MMM  d HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss' +0000'", "'no time'")
    written = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        written = F.when(c("event_id") % 9 == i, F.date_format(ts, form)).otherwise(written)
    return t.derived.select("line_number", times.parse_timestamp(written, YEAR).alias("event_time"))


@query("p9_timestamp_anywhere", sql("raw", """
SELECT line_number, CASE WHEN event_id % 12 = 9 THEN log_ts + INTERVAL 123 MILLISECONDS ELSE log_ts END AS found FROM raw"""))
def _(t: Tables) -> DataFrame:
    return times.with_found_time(t.lines, default_year=YEAR).select("line_number", "found")


@query("p10_protocol_name", sql("raw", """
SELECT number, CASE number WHEN '6' THEN 'TCP' WHEN '17' THEN 'UDP' WHEN '1' THEN 'ICMP' ELSE number END AS protocol, count(*) AS n
FROM (SELECT regexp_extract(line, 'Protocol: (\\d+)', 1) AS number FROM raw WHERE event_id % 12 = 3) GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    number = F.regexp_extract("line", r"Protocol: (\d+)", 1)
    rows = t.lines.filter(number != "").select(number.alias("number"))
    return rows.groupBy("number", net.protocol_name(c("number")).alias("protocol")).agg(F.count(F.lit(1)).alias("n"))


@query("p11_text_helpers", sql("ev", """
SELECT line_number, regexp_replace(path, '^.*[\\\\/]', '') AS base, upper(left(status, 1)) || lower(substr(status, 2)) AS status,
    CASE WHEN length(line) > 40 THEN left(line, 40) || '...' ELSE line END AS shown FROM ev WHERE kind = 'PROCESS'"""))
def _(t: Tables) -> DataFrame:
    rows = t.parsed.filter("kind = 'PROCESS'")
    return rows.select("line_number", text.basename(c("path")).alias("base"),
                       text.capitalize(F.upper("status")).alias("status"), text.truncate(c("line"), 40, "...").alias("shown"))


@query("p12_packet_export", sql("packets", "SELECT * FROM packets"))
def _(t: Tables) -> DataFrame:
    return t.packets.select("source_file", "line_number", "event_time", "source_ip", "source_port", "dest_ip", "dest_port",
                            "flags", "seq", "win", "length")


@query("p13_verdict_text", sql("raw", """
SELECT line_number, CASE WHEN line_number % 3 = 0 THEN 'true' ELSE 'false' END AS fp, '0.' || (line_number % 10) AS confidence,
    'first ' || line_number || chr(10) || 'second line' AS explanation, CAST(4 AS INTEGER) AS n_keys FROM raw"""))
def _(t: Tables) -> DataFrame:
    n = c("line_number")
    body = F.concat(
        F.lit("preamble without a key\n\nIS_FALSE_POSITIVE: "), F.when(n % 3 == 0, "true").otherwise("false"),
        F.lit("\nCONFIDENCE: old\n  CONFIDENCE :  0."), (n % 10).cast("string"), F.lit(" \nEXPLANATION: first "),
        n.cast("string"), F.lit("\n\n  second line\nLINK: http://x:1/y"))
    v = t.derived.select("line_number", F.explode(F.array(triage.parse_verdict(body))).alias("v"))
    return v.select("line_number", c("v")["IS_FALSE_POSITIVE"].alias("fp"), c("v")["CONFIDENCE"].alias("confidence"),
                    c("v")["EXPLANATION"].alias("explanation"), F.size("v").alias("n_keys"))
