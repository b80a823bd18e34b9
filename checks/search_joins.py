"""Predicates, search and joins (Q, J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.oracle_base import json_sql, plain_space, rx, sql, values
from checks.registry import query
from checks.tables import YEAR, Tables
from threatlake import catalog, session
from threatlake.functions import net
from threatlake.operators import lookups, matching, rule_tables, running, search, search_index, triage
from threatlake.plans import scan
from threatlake.sources import carrier, reference

c = F.col
DOC = ("doc_id", "pos", "line")


@query("q1_substring_search", sql("doc_lines", "SELECT doc_id, pos, line FROM doc_lines WHERE contains(lower(line), 'the ')"))
def _(t: Tables) -> DataFrame:
    return search.search(t.document_lines, "The ").select(*DOC)


@query("q2_case_sensitive_search", sql("doc_lines", "SELECT doc_id, pos, line FROM doc_lines WHERE contains(line, 'The')"))
def _(t: Tables) -> DataFrame:
    return search.search(t.document_lines, search.Criteria("The", case_sensitive=True)).select(*DOC)


@query("q3_regex_search", sql("doc_lines", r"SELECT doc_id, pos, line FROM doc_lines WHERE regexp_matches(line, '(?i)\b[a-z]+ing\s+the\b|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}')"))
def _(t: Tables) -> DataFrame:
    criteria = search.Criteria(r"\b[a-z]+ing\s+the\b|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", use_regex=True)
    return search.search(t.document_lines, criteria).select(*DOC)


@query("q4_time_range_search", sql("raw", """
WITH timed AS (SELECT *, CASE WHEN event_id % 12 = 9 THEN log_ts + INTERVAL 123 MILLISECONDS ELSE log_ts END AS found FROM raw)
SELECT line_number, line FROM timed WHERE found BETWEEN TIMESTAMP '2024-01-01 00:00:10' AND TIMESTAMP '2024-01-01 08:30:00'
UNION ALL SELECT line_number, 'no stamp ' || line_number FROM timed WHERE event_id % 12 = 11"""))
def _(t: Tables) -> DataFrame:
    bare = t.derived.filter("event_id % 12 = 11").select(
        "line_number", F.concat(F.lit("no stamp "), c("line_number").cast("string")).alias("line"))
    both = t.lines.select("line_number", "line").unionByName(bare)
    return search.search(both, search.Criteria("", start="2024-01-01 00:00:10", end="2024-01-01 08:30:00", default_year=YEAR))


@query("q5_blank_lines", sql("doc_lines", "SELECT lang, count(*) AS n_lines FROM doc_lines WHERE trim(line, chr(32) || chr(9) || chr(13) || chr(160)) <> '' GROUP BY lang"))
def _(t: Tables) -> DataFrame:
    return search.search(t.document_lines, "").groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"))


@query("q6_search_findings", sql("ff", """
SELECT source_file, line_number, severity FROM ff WHERE contains(lower(content), 'malicious') OR contains(lower(descriptions), 'malicious')
    OR contains(lower(categories), 'malicious')"""))
def _(t: Tables) -> DataFrame:
    return search.search_findings(t.file_findings, "malicious").select("source_file", "line_number", "severity")


def _indexed(t: Tables, table: DataFrame, criteria: search.Criteria | str, text: Column | str = "line") -> DataFrame:
    """The rows of the files that can hold a match, of the table landed with its index."""
    folder = session.new_folder(t.spark, "indexed")
    search_index.land_indexed(table, folder, text)
    return search_index.candidates(t.spark, folder, criteria)


@query("q1_indexed_search", sql("doc_lines", "SELECT doc_id, pos, line FROM doc_lines WHERE contains(lower(line), 'tionhation')"))
def _(t: Tables) -> DataFrame:
    return search.search(_indexed(t, t.document_lines, "TionHation"), "TionHation").select(*DOC)


@query("q3_indexed_search", sql("raw", r"SELECT source_file, line_number, line FROM raw WHERE regexp_matches(line, '(?i)for u17 from [\d.]+ port \d+')"))
def _(t: Tables) -> DataFrame:
    criteria = search.Criteria(r"FOR u17 from [\d.]+ port \d+", use_regex=True)
    return search.search(_indexed(t, t.lines, criteria), criteria).select("source_file", "line_number", "line")


@query("q6_indexed_findings", sql("ff", "SELECT source_file, line_number, severity FROM ff WHERE contains(lower(content), 'u17 from')"))
def _(t: Tables) -> DataFrame:
    rows = _indexed(t, t.file_findings, "U17 from", F.to_json(F.struct("*")))
    return search.search_findings(rows, "U17 from").select("source_file", "line_number", "severity")


@query("q7_indicator_description", sql("ff", "SELECT source_file, line_number, severity FROM ff WHERE contains(lower(descriptions), 'brute force')"))
def _(t: Tables) -> DataFrame:
    return search.with_indicator_text(t.file_findings, "Brute Force").select("source_file", "line_number", "severity")


@query("q8_severity_category_filter", sql("findings", """
SELECT source_file, line_number, severity, verdict_source FROM findings f WHERE severity >= 3 AND EXISTS (
    SELECT 1 FROM indicators i WHERE i.source_file = f.source_file AND i.line_number = f.line_number AND i.category = 'NETWORK')"""))
def _(t: Tables) -> DataFrame:
    return search.filter_findings(t.findings, 3, "NETWORK").select("source_file", "line_number", "severity", "verdict_source")


@query("q9_indicator_severity_filter", sql("scan_hits", """
SELECT source_file, line_number, max(severity) AS top FROM scan_hits GROUP BY ALL
HAVING max(severity) >= 5 AND bool_or(category = 'MALWARE')"""))
def _(t: Tables) -> DataFrame:
    return search.filter_by_indicator(t.file_findings, 5, "MALWARE").select(
        "source_file", "line_number", c("severity").alias("top"))


@query("q10_emit_thresholds", sql("dynf", "SELECT source_file, line_number, kind, dynamic_severity AS severity FROM dynf"))
def _(t: Tables) -> DataFrame:
    found = matching.min_severity(scan.dynamic_findings(t.scored), 2)
    return found.select("source_file", "line_number", "kind", "severity")


def _benign_sql() -> str:
    from checks.oracle_base import benign_case
    return sql("raw", f"""
WITH tagged AS (SELECT line_number, {benign_case('description')} AS description, {benign_case('max_freq')} AS max_freq,
    {benign_case('multiplier')} AS m, line_number % 1100 AS freq FROM raw)
SELECT line_number, CASE WHEN freq > max_freq THEN description || ' (High Frequency: ' || freq || ' > ' || max_freq || ')' ELSE description END AS description,
    round(CASE WHEN freq > max_freq THEN m * 1.5 ELSE m END, 6) AS multiplier,
    CASE WHEN freq > max_freq THEN m * 1.5 ELSE m END < 0.5 AS suppressed FROM tagged WHERE description IS NOT NULL""")


@query("q11_benign_suppression", _benign_sql())
def _(t: Tables) -> DataFrame:
    tagged = matching.benign_rule(t.lines).withColumn("freq", c("line_number") % 1100)
    multiplier, description = matching.benign_verdict(c("freq"), c("benign"))
    tagged = tagged.filter("benign is not null").withColumns({"description": description, "m": multiplier})
    return tagged.select("line_number", "description", F.round("m", 6).alias("multiplier"),
                         matching.suppressed(c("benign"), c("m"), 0.5).alias("suppressed"))


_PORTS = " OR ".join(f"(protocol = '{p}' AND dest_port IN {ports})" for p, ports in catalog.BASELINE_PORTS.items())


@query("q12_risky_ports", sql("ev", f"""
SELECT source_file, line_number, dest_port, dest_port IN {catalog.HIGH_RISK_PORTS} AS high_risk, NOT ({_PORTS}) AS unlisted
FROM ev WHERE kind = 'NETWORK'"""))
def _(t: Tables) -> DataFrame:
    return lookups.port_flags(t.parsed).select("source_file", "line_number", "dest_port", "high_risk", "unlisted")


@query("q13_suspicious_process_names", sql("ev", f"""
SELECT n AS process_name, count(*) AS events FROM (SELECT CASE WHEN "user" LIKE 'u%' THEN 'unknown-né' || process_name ELSE process_name END AS n
    FROM ev WHERE kind = 'PROCESS') WHERE {' OR '.join(rx(p, "replace(n, 'é', 'e')") for p in catalog.SUSPICIOUS_PROCESS_PATTERNS)} GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    named = t.parsed.filter("kind = 'PROCESS'").select(F.when(
        c("user").startswith("u"), F.concat(F.lit("unknown-né"), c("process_name"))).otherwise(c("process_name")).alias("process_name"))
    return named.filter(lookups.suspicious_process(c("process_name"))).groupBy("process_name").agg(
        F.count(F.lit(1)).alias("events"))


@query("q14_domain_whitelist", sql("", f"""
WITH hosts AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:]+)', 1)) AS host FROM pages),
mixed AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN host || '.Google.com' WHEN 1 THEN 'notgoogle.com' ELSE host END AS domain FROM hosts)
SELECT page_id, domain, {' OR '.join(f"lower(domain) = '{d}' OR ends_with(lower(domain), '.{d}')" for d in catalog.BASELINE_DOMAINS)} AS whitelisted,
    CASE {' '.join(f"WHEN lower(domain) = '{d}' OR ends_with(lower(domain), '.{d}') THEN '{d}'" for d in catalog.BASELINE_DOMAINS)} END AS listed_domain
FROM mixed"""))
def _(t: Tables) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^https?://([^/:]+)", 1))
    third = c("page_id") % 3
    domain = F.when(third == 0, F.concat(host, F.lit(".Google.com"))).when(third == 1, "notgoogle.com").otherwise(host)
    rows = t.table("pages").select("page_id", domain.alias("domain"))
    listed = reference.values(t.spark, "domain", catalog.BASELINE_DOMAINS)
    joined = lookups.with_listed_domain(rows, "domain", listed)
    return joined.select("page_id", "domain", lookups.is_whitelisted_domain(c("domain")).alias("whitelisted"), "listed_domain")


# -- joins ----------------------------------------------------------------------

@query("j1_rules_by_lines", sql("root_hits", "SELECT source_file, line_number, rule_id FROM root_hits"))
def _(t: Tables) -> DataFrame:
    return matching.rule_hits(t.lines, catalog.ROOT_RULES).select("source_file", "line_number", "rule_id")


_USER_RULES = [(901, "Failed password", "AUTH", 3, r"failed\s+password"), (902, "Shell tool", "PROCESS", 4, r"\b(?:nc|powershell)\s+-"),
               (903, "Port 4444", "NETWORK", 2, r"\b4444\b"), (904, "Never", "NETWORK", 1, r"zzz{3}q")]


@query("j1_rule_table", sql("raw", f"""
SELECT source_file, line_number, rule_id, severity FROM raw JOIN {values([(r[0], r[3], '(?i)' + r[4]) for r in _USER_RULES])} r(rule_id, severity, pattern)
ON regexp_matches({plain_space("line")}, pattern)"""))
def _(t: Tables) -> DataFrame:
    listed = t.spark.createDataFrame(_USER_RULES, "rule_id int, description string, category string, severity int, pattern string")
    rules = matching.rules_from_table(listed)
    hits = matching.rule_hits(t.lines, rules)
    return hits.join(F.broadcast(listed.select("rule_id", "severity")), "rule_id").select("source_file", "line_number", "rule_id", "severity")


#: Rules for each user of the events: as many as users times this.
_PER_USER = 67


@query("j1_many_rules", sql("raw", f"""
SELECT source_file, line_number, e.user_id * {_PER_USER} + g.n AS rule_id, CAST(g.n % 5 + 1 AS INTEGER) AS severity
FROM raw JOIN events e ON raw.event_id = e.event_id, range({_PER_USER}) g(n)
WHERE contains(line, 'u' || e.user_id || ' from ') AND regexp_matches(line,
    '(?i)FOR U' || e.user_id || ' from ' || CASE WHEN g.n % 2 = 0 THEN '45\\.67\\.0\\.' ELSE '192\\.168\\.1\\.' END || g.n // 2 || ' port \\d+')"""))
def _(t: Tables) -> DataFrame:
    users = t.table("events").select("user_id").distinct()
    k, user = c("k"), c("user_id")
    rules = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(_PER_USER - 1))).alias("k")).select(
        (user * _PER_USER + k).alias("rule_id"), (k % 5 + 1).alias("severity"), F.concat(
            F.lit("FOR U"), user.cast("string"), F.lit(" from "), F.when(k % 2 == 0, "45\\.67\\.0\\.").otherwise("192\\.168\\.1\\."),
            F.floor(k / 2).cast("string"), F.lit(" port \\d+")).alias("pattern"))
    return rule_tables.table_hits(t.lines, rules).select("source_file", "line_number", "rule_id", "severity")


@query("j2_all_indicators", sql("ff", "SELECT source_file, line_number, severity, categories, descriptions FROM ff"))
def _(t: Tables) -> DataFrame:
    return t.file_findings.select("source_file", "line_number", "severity",
                                  F.array_join(c("indicators")["category"], " | ").alias("categories"),
                                  F.array_join(c("indicators")["description"], " | ").alias("descriptions"))


@query("j3_best_rule", sql("best", "SELECT source_file, line_number, rule_id, category, severity, CAST(confidence AS DOUBLE) AS confidence FROM best"))
def _(t: Tables) -> DataFrame:
    return matching.best_rule(t.lines).filter("rule is not null").select("source_file", "line_number", "rule.rule_id",
                                                                       "rule.category", "rule.severity", "rule.confidence")


_TRUSTED = values([(p.process_name, p.description, p.max_connections, p.base_trust) for p in catalog.TRUSTED_PROCESSES])


@query("j4_trusted_process_lookup", sql("ev", f"""
SELECT source_file, line_number, process_name, description, CAST(base AS DOUBLE) AS base_trust FROM ev
LEFT JOIN {_TRUSTED} t(name, description, m, base) ON lower(process_name) = t.name WHERE kind <> 'GENERIC'"""))
def _(t: Tables) -> DataFrame:
    joined = lookups.with_trusted(t.parsed.filter("kind != 'GENERIC'"))
    return joined.select("source_file", "line_number", "process_name", "trusted.description", "trusted.base_trust")


_SERVICES = values([(s.service, p, s.protocol, s.internal_only, s.per_minute_limit, s.risk_factor)
                    for s in catalog.SERVICES for p in s.ports])


@query("j5_service_lookup", sql("ev", f"""
SELECT source_file, line_number, e.dest_port, service, internal_only, CAST(risk AS DOUBLE) AS risk_factor FROM ev e
LEFT JOIN {_SERVICES} s(service, port, proto, internal_only, lim, risk) ON e.dest_port = s.port AND upper(e.protocol) = s.proto
WHERE kind = 'NETWORK'"""))
def _(t: Tables) -> DataFrame:
    joined = lookups.with_service(t.parsed.filter("kind = 'NETWORK'"))
    return joined.select("source_file", "line_number", "dest_port", "service.service", "service.internal_only", "service.risk_factor")


_RELATED = """
WITH rel AS (SELECT a.source_file, a.line_number, lower(b.kind) AS type, b.event_time AS related_time, b.line_number AS related_line
    FROM known a JOIN known b ON a.source_file = b.source_file AND b.event_time BETWEEN a.event_time - INTERVAL 300 SECONDS AND a.event_time
    AND (CASE WHEN a.kind = 'NETWORK' AND b.kind = 'NETWORK' THEN a.source_ip = b.source_ip AND a.dest_ip = b.dest_ip
         ELSE a.process_name = b.process_name AND a.process_name <> '' END))"""


@query("j6_pair_correlation", sql("scored", """
SELECT source_file, line_number, CAST(w_pair AS BIGINT) AS related FROM corr WHERE kind = 'NETWORK'"""))
def _(t: Tables) -> DataFrame:
    points = t.parsed.filter("kind = 'NETWORK' and event_time is not null").select(
        "source_file", "line_number", "event_time", "source_ip", "dest_ip", F.lit(1).cast("bigint").alias("related"))
    keys = ["source_file", "source_ip", "dest_ip"]
    counted = running.trailing_count(points, keys, ["related"], catalog.CORRELATION_SECONDS)
    return points.drop("related").join(counted, [*keys, "event_time"]).select("source_file", "line_number", "related")


@query("j7_network_process_correlation", sql("scored", """
SELECT source_file, line_number, correlated FROM corr"""))
def _(t: Tables) -> DataFrame:
    return running.correlation_count(t.parsed)


# Every third connection goes to one of some public servers.
_SERVERS = ("8.8.8.8", "1.1.1.1", "8.8.4.4", "45.67.0.9", "9.9.9.9")
_ADDRESSES = ("SELECT source_file, line_number, CASE WHEN line_number % 3 = 0 THEN [" + ",".join(f"'{s}'" for s in _SERVERS)
              + "][line_number % 5 + 1] ELSE dest_ip END AS dest_ip FROM ev WHERE kind = 'NETWORK'")


def addressed(t: Tables) -> DataFrame:
    server = F.array(*map(F.lit, _SERVERS))[(c("line_number") % 5).cast("int")]
    return t.parsed.filter("kind = 'NETWORK'").withColumn(
        "dest_ip", F.when(c("line_number") % 3 == 0, server).otherwise(c("dest_ip")))


@query("j8_whitelist_removal", sql("ev", f"""
SELECT source_file, line_number, process_name, lower(process_name) IN {catalog.BASELINE_PROCESSES} AS trusted FROM ev
WHERE kind <> 'GENERIC' AND lower(process_name) NOT IN {catalog.WHITELISTED_PROCESSES}"""))
def _(t: Tables) -> DataFrame:
    named = t.parsed.filter("kind != 'GENERIC'").withColumn("name", F.lower("process_name"))
    left = lookups.exclude(named, "name", reference.values(t.spark, "process", catalog.WHITELISTED_PROCESSES))
    baseline = reference.values(t.spark, "process", catalog.BASELINE_PROCESSES)
    flagged = lookups.retain(left, "name", baseline).withColumn("trusted", F.lit(True)).unionByName(
        lookups.exclude(left, "name", baseline).withColumn("trusted", F.lit(False)))
    return flagged.select("source_file", "line_number", "process_name", "trusted")


@query("j8_ip_whitelist", sql("ev", f"""
SELECT source_file, line_number, dest_ip FROM ({{}}) WHERE dest_ip NOT IN {catalog.WHITELISTED_IPS}""".replace("{}", _ADDRESSES)))
def _(t: Tables) -> DataFrame:
    listed = reference.values(t.spark, "address", catalog.WHITELISTED_IPS)
    return lookups.exclude(addressed(t), "dest_ip", listed).select("source_file", "line_number", "dest_ip")


@query("q14_dns_servers", sql("ev", f"""
SELECT source_file, line_number, dest_ip, dest_ip IN {catalog.BASELINE_DNS_SERVERS} AS known FROM ({{}})""".replace("{}", _ADDRESSES)))
def _(t: Tables) -> DataFrame:
    return addressed(t).select("source_file", "line_number", "dest_ip", lookups.is_known_dns_server(c("dest_ip")).alias("known"))


@query("j9_network_containment", sql("ev", """
SELECT source_file, line_number, source_ip, CASE WHEN source_ip LIKE '10.%' THEN '10.0.0.0/8' WHEN source_ip LIKE '192.168.%' THEN '192.168.0.0/16' END AS network,
    source_ip LIKE '10.%' OR source_ip LIKE '192.168.%' AS is_internal FROM ev WHERE kind = 'NETWORK'"""))
def _(t: Tables) -> DataFrame:
    known = t.parsed.filter("kind = 'NETWORK'")
    joined = lookups.with_network_of_table(known, "source_ip", reference.cidrs(t.spark))
    joined = lookups.with_network(joined.drop("network"), "source_ip")
    return joined.select("source_file", "line_number", "source_ip", "network",
                         net.in_networks(net.ipv4_number(c("source_ip")), catalog.INTERNAL_NETWORKS).alias("is_internal"))


#: Blocks of both families, nested ones, a single address, one that cannot be read.
_BLOCKS = ("10.0.0.0/8", "10.0.0.0/30", "192.168.0.0/16", "45.67.0.2", "0.0.0.0/0", "fe80::/10", "2001:db8::/32", "2001:db8:0:3::/64",
           "2001:db8:0:3::a/128", "::/0", "bad/8")


@query("j9_longest_network", sql("", """
WITH a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '10.0.0.' || event_id % 7 WHEN 1 THEN '192.168.' || event_id % 9 || '.1' WHEN 2 THEN '45.67.0.' || event_id % 4
    WHEN 3 THEN '2001:db8:0:' || event_id % 4 || '::' || ['a', 'b'][event_id % 2 + 1] WHEN 4 THEN 'fe80::' || event_id % 9 ELSE ['x', '2002::1', '300.1.1.1'][event_id % 5 % 3 + 1] END AS ip FROM events)
SELECT event_id, ip, CASE WHEN starts_with(ip, '10.0.0.') THEN CASE WHEN CAST(split_part(ip, '.', 4) AS INTEGER) < 4 THEN '10.0.0.0/30' ELSE '10.0.0.0/8' END
    WHEN starts_with(ip, '192.168.') THEN '192.168.0.0/16' WHEN ip = '45.67.0.2' THEN '45.67.0.2' WHEN starts_with(ip, '45.') THEN '0.0.0.0/0'
    WHEN ip = '2001:db8:0:3::a' THEN '2001:db8:0:3::a/128' WHEN starts_with(ip, '2001:db8:0:3:') THEN '2001:db8:0:3::/64'
    WHEN starts_with(ip, '2001:db8:') THEN '2001:db8::/32' WHEN starts_with(ip, 'fe80') THEN 'fe80::/10' WHEN ip = '2002::1' THEN '::/0' END AS network FROM a"""))
def _(t: Tables) -> DataFrame:
    e = c("event_id")

    def joined(*parts) -> F.Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    ip = (F.when(e % 6 == 0, joined("10.0.0.", e % 7)).when(e % 6 == 1, joined("192.168.", e % 9, ".1")).when(e % 6 == 2, joined("45.67.0.", e % 4))
          .when(e % 6 == 3, joined("2001:db8:0:", e % 4, "::", F.when(e % 2 == 0, "a").otherwise("b"))).when(e % 6 == 4, joined("fe80::", e % 9))
          .otherwise(F.element_at(F.array(*map(F.lit, ("x", "2002::1", "300.1.1.1"))), (e % 5 % 3 + 1).cast("int"))))
    addresses = t.spread(t.table("events")).select("event_id", ip.alias("ip"))
    return lookups.with_longest_network(addresses, "ip", t.spark.createDataFrame([(b,) for b in _BLOCKS], "network string"))


@query("j10_verdict_choice", sql("findings", "SELECT source_file, line_number, severity, verdict_source, round(CASE WHEN wins THEN risk END, 6) AS risk FROM findings"))
def _(t: Tables) -> DataFrame:
    return t.findings.select("source_file", "line_number", "severity", "verdict_source", F.round("risk", 6).alias("risk"))


@query("flagship_findings", sql("findings", """
SELECT verdict_source, severity, count(*) AS findings, round(max(CASE WHEN wins THEN risk END), 6) AS top_risk FROM findings GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    found = scan.scan(t.lines, YEAR)
    return found.groupBy("verdict_source", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.round(F.max("risk"), 6).alias("top_risk"))


_REFINED = """
refined AS (SELECT f.source_file, f.line_number, f.severity, v.fp, v.confidence, v.explanation, v.revised, f.event_time
    FROM findings f LEFT JOIN verdicts v ON f.source_file = v.source_file AND f.line_number = v.line_number
    WHERE NOT coalesce(v.fp = 'true' AND v.confidence >= 0.8, false))"""


@query("j11_second_pass", sql("verdicts", f"""WITH {_REFINED}
SELECT source_file, line_number, severity, CASE WHEN fp IS NOT NULL THEN fp = 'true' END AS is_false_positive, confidence, explanation,
    coalesce(revised, severity) AS revised_severity FROM refined"""))
def _(t: Tables) -> DataFrame:
    return triage.refine(t.findings, t.verdicts).select(
        "source_file", "line_number", "severity", "is_false_positive", "confidence", "explanation", "revised_severity")


def group_verdicts(groups: DataFrame) -> DataFrame:
    n = c("bucket") % 10
    body = F.concat(F.lit("CORRELATED_THREAT: campaign\nCONFIDENCE: 0."), n.cast("string"), F.lit("\nEXPLANATION: chained\n"),
                    F.when(c("bucket") % 2 == 0, F.lit("SEVERITY: 5\n")).otherwise("SEVERITY: high\n"),
                    F.lit("RECOMMENDED_ACTIONS: isolate, patch"))
    return groups.select("source_file", "bucket", body.alias("text"))


_GROUPS = """
grouped AS (SELECT source_file, CAST(floor(epoch(event_time) / 300) AS BIGINT) AS bucket, count(*) AS n, min(line_number) AS first_line,
    max(line_number) AS last_line FROM refined WHERE event_time IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
threats AS (SELECT *, CAST(CASE WHEN bucket % 2 = 0 THEN 5 ELSE 3 END AS INTEGER) AS severity FROM grouped WHERE bucket % 10 > 7)"""


@query("j12_correlated_threats", sql("verdicts", f"""WITH {_REFINED}, {_GROUPS}
SELECT source_file, bucket, n AS findings, first_line, last_line, severity, 'campaign' AS content, 'isolate| patch' AS actions FROM threats"""))
def _(t: Tables) -> DataFrame:
    groups = triage.groups(triage.refine(t.findings, t.verdicts))
    return triage.correlated_threats(groups, group_verdicts(groups)).select(
        "source_file", "bucket", "findings", "first_line", "last_line", "severity", "content",
        F.array_join("recommended_actions", "|").alias("actions"))


@query("u3_findings_and_threats", sql("verdicts", f"""WITH {_REFINED}, {_GROUPS}
SELECT 'finding' AS type, source_file, line_number, severity FROM refined
UNION ALL SELECT 'correlated_threat', source_file, NULL, severity FROM threats"""))
def _(t: Tables) -> DataFrame:
    refined = triage.refine(t.findings, t.verdicts)
    groups = triage.groups(refined)
    threats = triage.correlated_threats(groups, group_verdicts(groups))
    both = triage.with_threats(refined.drop("explanation"), threats.drop("findings"))
    return both.select(F.coalesce("type", F.lit("finding")).alias("type"), "source_file", "line_number", "severity")


_BUNDLES = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY line_number) AS n FROM findings),
texts AS (SELECT r.source_file, r.line_number, r.n, 'Finding (Severity ' || r.severity || '):' || chr(10) || r.content || chr(10) || 'Indicators: ' ||
    string_agg(i.description, ', ' ORDER BY i.pos) AS t FROM ranked r JOIN indicators i ON r.source_file = i.source_file AND r.line_number = i.line_number
    GROUP BY r.source_file, r.line_number, r.n, r.severity, r.content),
bundles AS (SELECT source_file, (n - 1) // 50 AS bundle, count(*) AS findings, string_agg(t, chr(10) ORDER BY n) AS text FROM texts GROUP BY ALL)"""


@query("j13_summary_cache", sql("findings", f"""WITH {_BUNDLES}
SELECT md5(text || ':200') AS cache_key, bundle % 2 = 0 AS hit, CASE WHEN bundle % 2 = 0 THEN 'summary of ' || source_file END AS summary FROM bundles"""))
def _(t: Tables) -> DataFrame:
    prompts = triage.evidence_bundles(t.findings).withColumnRenamed("text", "prompt")
    cache = prompts.filter("bundle % 2 = 0").select(
        triage.cache_key(c("prompt"), 200).alias("cache_key"), F.concat(F.lit("summary of "), c("source_file")).alias("summary"))
    hits = triage.cache_hits(prompts, cache).select("cache_key", F.lit(True).alias("hit"), "summary")
    misses = triage.cache_misses(prompts, cache).select(
        "cache_key", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("summary"))
    return hits.unionByName(misses)


@query("j13_stored_summaries", sql("findings", f"""WITH {_BUNDLES}
SELECT md5(text || ':200') AS cache_key, 'run ' || CASE WHEN bundle % 3 = 0 THEN 2 ELSE 1 END || ' of ' || source_file AS summary, true AS hit FROM bundles"""))
def _(t: Tables) -> DataFrame:
    """Misses of a first run are hits of the next one; a second store replaces some of them."""
    path = session.new_folder(t.spark, "cache")
    prompts = triage.evidence_bundles(t.findings).withColumnRenamed("text", "prompt")

    def summaries(run: int, rows: DataFrame) -> DataFrame:
        return rows.select(triage.cache_key(c("prompt"), 200).alias("cache_key"), F.concat(F.lit(f"run {run} of "), c("source_file")).alias("summary"))

    for run, rows in ((1, triage.cache_misses(prompts, triage.stored_summaries(t.spark, path))), (2, prompts.filter("bundle % 3 = 0"))):
        triage.save_summaries(summaries(run, rows), path)
    store = triage.stored_summaries(t.spark, path)
    hits = triage.cache_hits(prompts, store).select("cache_key", "summary", F.lit(True).alias("hit"))
    return hits.unionByName(triage.cache_misses(prompts, store).select("cache_key", F.lit(None).cast("string").alias("summary"), F.lit(False).alias("hit")))


@query("a16_evidence_bundles", sql("findings", f"WITH {_BUNDLES} SELECT source_file, bundle, findings, text FROM bundles"))
def _(t: Tables) -> DataFrame:
    return triage.evidence_bundles(t.findings)


@query("s4_json_scan", json_sql("findings", "SELECT source_file, line_number, severity, verdict_source, round(CASE WHEN wins THEN risk END, 6) AS risk FROM findings"))
def _(t: Tables) -> DataFrame:
    return t.json_findings.select("source_file", "line_number", "severity", "verdict_source", F.round("risk", 6).alias("risk"))


@query("w5_json_ordinal", json_sql("findings", """
SELECT source_file, line_number, row_number() OVER (PARTITION BY source_file ORDER BY line_number) AS ordinal FROM findings"""))
def _(t: Tables) -> DataFrame:
    return running.ordinal(t.json_findings.select("source_file", "line_number"))


@query("a16_json_bundles", json_sql("findings", f"WITH {_BUNDLES} SELECT source_file, bundle, findings FROM bundles"))
def _(t: Tables) -> DataFrame:
    return triage.evidence_bundles(t.json_findings).select("source_file", "bundle", "findings")


@query("j11_json_second_pass", json_sql("verdicts", f"""WITH {_REFINED}
SELECT source_file, line_number, severity, confidence, coalesce(revised, severity) AS revised_severity FROM refined"""))
def _(t: Tables) -> DataFrame:
    found = t.json_findings
    return triage.refine(found, carrier.verdicts_for(found)).select(
        "source_file", "line_number", "severity", "confidence", "revised_severity")


@query("a16_short_evidence", sql("findings", """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY line_number) AS n FROM findings WHERE severity >= 2)
SELECT source_file, left(string_agg('Finding ' || n || ': ' || left(content, 200) || '...', chr(10) ORDER BY n), 300)
    || CASE WHEN length(string_agg('Finding ' || n || ': ' || left(content, 200) || '...', chr(10) ORDER BY n)) > 300 THEN '...(truncated)' ELSE '' END AS text
FROM ranked WHERE n <= 5 GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    return triage.short_evidence(t.findings, 5, 200).select("source_file", triage.chat_context(c("text"), 300).alias("text"))


@query("j14_triage_chain", sql("verdicts", """
SELECT f.source_file, f.line_number, CAST(f.line_number % 5 + 1 AS INTEGER) AS severity, 'threat ' || f.line_number AS threat, 'block|report' AS actions
FROM findings f JOIN verdicts v ON f.source_file = v.source_file AND f.line_number = v.line_number WHERE f.severity >= 2 AND v.fp <> 'true'"""))
def _(t: Tables) -> DataFrame:
    n = c("line_number")
    details = t.findings.select("source_file", "line_number", F.concat(
        F.lit("THREAT: threat "), n.cast("string"), F.lit("\nSEVERITY: "), (n % 5 + 1).cast("string"),
        F.lit("\nACTIONS: block, report")).alias("text"))
    return triage.triage(t.findings, t.verdicts, details).select(
        "source_file", "line_number", "severity", "threat", F.array_join("actions", "|").alias("actions"))


@query("t3_first_correlated", sql("scored", f"""{_RELATED}
SELECT source_file, line_number, CAST(position AS INTEGER) AS position, type, related_time FROM (SELECT *, row_number() OVER (
    PARTITION BY source_file, line_number ORDER BY related_time, type DESC, related_line) AS position FROM rel) WHERE position <= 5"""))
def _(t: Tables) -> DataFrame:
    return running.earliest_correlated(t.parsed).select("source_file", "line_number", "position", "type", "related_time")


@query("u2_correlated_union", sql("scored", f"""{_RELATED}
SELECT source_file, line_number, count(*) FILTER (type = 'network') AS network, count(*) FILTER (type = 'process') AS process
FROM (SELECT *, row_number() OVER (PARTITION BY source_file, line_number ORDER BY related_time, type DESC, related_line) AS p FROM rel)
WHERE p <= 5 GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    return running.earliest_correlated(t.parsed).groupBy("source_file", "line_number").agg(
        F.count_if(c("type") == "network").alias("network"), F.count_if(c("type") == "process").alias("process"))


