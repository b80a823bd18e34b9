"""DuckDB SQL for the derived log, its events, rule hits, scores and findings.

Written for DuckDB's own functions and RE2, without look-around, as a second
computation of the same results.
"""

from __future__ import annotations

from threatlake import catalog
from threatlake.sources import carrier

_IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
INTERNAL = catalog.INTERNAL_PREFIX


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(items: tuple, n: str) -> str:
    return "[" + ",".join(q(str(i)) for i in items) + f"][({n}) % {len(items)} + 1]"


def values(rows: list[tuple]) -> str:
    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        return q(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ",".join("(" + ",".join(one(v) for v in r) + ")" for r in rows) + ")"


def plain_space(column: str) -> str:
    """The white space beyond ASCII of the derived log as blanks: RE2 knows no other."""
    return f"translate({column}, chr(160) || chr(8195), '  ')"


def rx(pattern: str, column: str = "line") -> str:
    return f"regexp_matches({plain_space(column)}, {q('(?i)' + pattern)})"


def _derived() -> str:
    commands = tuple(c for c in carrier.COMMANDS if "\\" not in c)
    iso, syslog = "strftime(log_ts, '%Y-%m-%d %H:%M:%S')", "strftime(log_ts, '%b %d %H:%M:%S')"
    ssh = "{} || ' host1 sshd[7]: {} for u' || user_id || ' from ' || src || ' port ' || sport || ' ssh2'"
    path = "'C:\\Windows\\System32\\' || exe"
    lines = [
        ssh.format(syslog, "Failed password"),
        ssh.format(syslog, "Accepted publickey"),
        f"{iso} || ' EventID=4688 New Process Name: ' || {path} || ' Creator Process Name: "
        f"C:\\Windows\\explorer.exe Process Command Line: ' || {pick(carrier.COMMANDS, 'k')}",
        f"{iso} || ' EventID=5156 Application Name: ' || {path} || ' Source Address: ' || src || "
        f"' Source Port: ' || sport || ' Dest Address: ' || dst || ' Dest Port: ' || port || "
        f"' Protocol: ' || {pick(carrier.PROTOCOLS, 'user_id')}",
        f"""'{{"timestamp":"' || {iso} || '","src_ip":"' || dst || '","dst_ip":"' || src || '","dst_port":' ||
            port || ',"src_port":' || sport || ',"protocol":"tcp","bytes":' ||
            CAST(floor(value) AS BIGINT) * 1000000 || '}}'""",
        f"""'{{"@timestamp":"' || {iso} || '","process_name":"' || exe || '","pid":' || (1000 + user_id) ||
            ',"username":"u' || user_id || '","cmdline":"' || {pick(commands, 'k')} || '"}}'""",
        f"{iso} || ' ids0 ' || {pick(carrier.RULE_LINES[15:17], 'k')}",
        f"{iso} || ' scanner ' || {pick(carrier.RULE_LINES[17:20], 'k')}",
        f"{iso} || ' web ' || src || ' ' || {pick(carrier.WEB_LINES, 'k')}",
        f"{iso} || '.123 ' || src || ':' || sport || ' -> ' || dst || ':' || port || ' [SYN] Seq=0 Win=1024 Len=0'",
        f"{iso} || ' ' || {pick(carrier.BENIGN_LINES + carrier.OTHER_LINES, 'k')}",
        f"{iso} || ' ' || {pick(carrier.RULE_LINES, 'k')}",
    ]
    cases = " ".join(f"WHEN {i} THEN {line}" for i, line in enumerate(lines))
    return f"""
base AS (SELECT event_id, user_id, value, event_id // 200 AS block, event_id // 12 AS k,
    (event_id // 200) % 4 = 0 AS hot FROM events),
parts AS (SELECT *,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(block * 25200 + (event_id % 200) * CASE WHEN hot THEN 1 ELSE 13 END) AS log_ts,
    CASE WHEN hot THEN '45.67.0.1' WHEN user_id % 5 = 0 THEN '45.67.0.' || (user_id % 2 + 1)
         ELSE '192.168.1.' || (user_id % 3 + 1) END AS src,
    '10.0.0.' || (50 + event_id % 3) AS dst, {pick(carrier.PORTS, 'k')} AS port,
    {pick(carrier.EXECUTABLES, 'user_id')} AS exe, 40000 + user_id AS sport FROM base),
raw AS (SELECT event_id, event_id + 1 AS line_number, 'day' || (block % 3) || '.log' AS source_file, log_ts,
    block, k, user_id, CASE event_id % 12 {cases} END AS line FROM parts)"""


def _events() -> str:
    stamp = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})"
    created = stamp + r".*?EventID=4688.*?New Process Name:\s*(.+?)\s+Creator Process Name:\s*(.+?)\s+Process Command Line:\s*(.*)"
    allowed = (stamp + r".*?EventID=5156.*?Application Name:\s*(.+?)\s+Source Address:\s*(\S+)\s+Source Port:\s*(\d+)\s+"
               r"Dest Address:\s*(\S+)\s+Dest Port:\s*(\d+)\s+Protocol:\s*(\d+)")
    ssh = (r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}).*?sshd\[\d+\]:\s+(Accepted|Failed)\s+(?:password|publickey)\s+for\s+(\S+)"
           r"\s+from\s+(" + _IP + r")\s+port\s+(\d+)")

    def g(pattern: str, n: int) -> str:
        return f"regexp_extract(line, {q(pattern)}, {n})"

    def j(name: str) -> str:
        return f"json_extract_string(doc, '$.\"{name}\"')"

    return f"""
typed AS (SELECT *, CASE
        WHEN regexp_matches(line, {q(created)}) THEN 'created' WHEN regexp_matches(line, {q(allowed)}) THEN 'allowed'
        WHEN regexp_matches(line, {q(ssh)}) THEN 'ssh' WHEN json_valid(line) THEN 'json' ELSE 'generic' END AS shape,
    CASE WHEN json_valid(line) THEN line END AS doc FROM raw),
named AS (SELECT *, CASE shape WHEN 'json' THEN CASE WHEN {j('src_ip')} IS NOT NULL THEN 'jnet' ELSE 'jproc' END ELSE shape END AS form
    FROM typed),
ev AS (SELECT event_id, source_file, line_number, line, log_ts, block, k,
    CASE WHEN form IN ('allowed','ssh','jnet') THEN 'NETWORK' WHEN form IN ('created','jproc') THEN 'PROCESS' ELSE 'GENERIC' END AS kind,
    CASE form WHEN 'created' THEN CAST({g(created, 1)} AS TIMESTAMP) WHEN 'allowed' THEN CAST({g(allowed, 1)} AS TIMESTAMP)
        WHEN 'ssh' THEN strptime('2024 ' || {g(ssh, 1)}, '%Y %b %d %H:%M:%S')
        WHEN 'jnet' THEN CAST({j('timestamp')} AS TIMESTAMP) WHEN 'jproc' THEN CAST({j('@timestamp')} AS TIMESTAMP) END AS event_time,
    CASE form WHEN 'allowed' THEN {g(allowed, 3)} WHEN 'ssh' THEN {g(ssh, 4)} WHEN 'jnet' THEN {j('src_ip')} END AS source_ip,
    CASE form WHEN 'allowed' THEN {g(allowed, 5)} WHEN 'ssh' THEN 'self' WHEN 'jnet' THEN {j('dst_ip')} END AS dest_ip,
    CAST(CASE form WHEN 'allowed' THEN {g(allowed, 4)} WHEN 'ssh' THEN {g(ssh, 5)} WHEN 'jnet' THEN {j('src_port')} END AS INTEGER) AS source_port,
    CAST(CASE form WHEN 'allowed' THEN {g(allowed, 6)} WHEN 'ssh' THEN '22' WHEN 'jnet' THEN {j('dst_port')} END AS INTEGER) AS dest_port,
    CASE form WHEN 'allowed' THEN CASE {g(allowed, 7)} WHEN '6' THEN 'TCP' WHEN '17' THEN 'UDP' WHEN '1' THEN 'ICMP'
        ELSE {g(allowed, 7)} END WHEN 'ssh' THEN 'TCP' WHEN 'jnet' THEN upper({j('protocol')}) END AS protocol,
    CASE form WHEN 'created' THEN regexp_replace({g(created, 2)}, '^.*[\\\\/]', '')
        WHEN 'allowed' THEN regexp_replace({g(allowed, 2)}, '^.*[\\\\/]', '') WHEN 'ssh' THEN 'sshd'
        WHEN 'jnet' THEN '' WHEN 'jproc' THEN {j('process_name')} END AS process_name,
    CAST(CASE form WHEN 'jnet' THEN {j('bytes')} WHEN 'allowed' THEN '0' WHEN 'ssh' THEN '0' END AS BIGINT) AS bytes_transferred,
    CAST(CASE form WHEN 'created' THEN '0' WHEN 'jproc' THEN {j('pid')} END AS INTEGER) AS pid,
    CASE form WHEN 'created' THEN 'Unknown' WHEN 'jproc' THEN {j('username')} END AS "user",
    CASE form WHEN 'created' THEN {g(created, 4)} WHEN 'jproc' THEN {j('cmdline')} END AS command_line,
    CASE form WHEN 'created' THEN {g(created, 2)} WHEN 'jproc' THEN '' END AS path,
    CASE form WHEN 'created' THEN 'Created' WHEN 'allowed' THEN 'Allowed' WHEN 'ssh' THEN {g(ssh, 2)}
        WHEN 'jnet' THEN '' WHEN 'jproc' THEN '' END AS status,
    CASE form WHEN 'generic' THEN CASE WHEN contains(line, ' ') THEN split_part(line, ' ', 1) ELSE 'unknown' END END AS source
    FROM named)"""


def rule_sql(rule: catalog.Rule, column: str = "line") -> str:
    marker = catalog._NOT_INTERNAL
    if rule.pattern.endswith(marker):
        head = rule.pattern[: -len(marker)]
        ip = f"regexp_extract({plain_space(column)}, {q('(?i)' + head + '(' + _IP + ')')}, 1)"
        return f"({ip} <> '' AND NOT regexp_matches({ip}, {q('^' + INTERNAL)}))"
    cond = rx(rule.pattern, column)
    if rule.min_tokens:
        tokens = f"len(regexp_extract_all({column}, {q(catalog.SHORT_NUMBER)}))"
        cond = f"({cond} OR {tokens} >= {rule.min_tokens})"
    return cond


def hits_cte(name: str, rules: tuple, source: str = "raw") -> str:
    """(source_file, line_number, rule_id, description, category, severity, confidence)."""
    info = values([(r.rule_id, r.description, r.category, r.severity, r.confidence) for r in rules])
    flags = ",".join(f"CASE WHEN {rule_sql(r)} THEN {r.rule_id} END" for r in rules)
    return f"""
{name}_all AS (SELECT source_file, line_number, line, unnest([{flags}]) AS rule_id FROM {source}),
{name} AS (SELECT h.*, i.description, i.category, i.severity, i.confidence FROM {name}_all h
    JOIN {info} i(rule_id, description, category, severity, confidence) ON h.rule_id = i.rule_id)"""


def _best() -> str:
    return """
best AS (SELECT * FROM root_hits QUALIFY row_number() OVER (
    PARTITION BY source_file, line_number ORDER BY severity DESC, rule_id) = 1)"""


def benign_sql(rule: catalog.BenignRule) -> str:
    if rule.description == "External TCP SYN":
        return f"({rx('tcp.*syn')} AND NOT {rx(INTERNAL)})"
    if "(?!" in rule.pattern:
        word = rule.pattern.split(".*")[0]
        path = f"regexp_extract({plain_space('line')}, {q('(?i)' + word + r'.*(?:GET|POST)\s+/(.*)')}, 1)"
        return f"({rx(rule.pattern.replace('(?!admin|login|wp-admin)', ''))} AND NOT regexp_matches({path}, '(?i)^(admin|login|wp-admin)'))"
    return rx(rule.pattern)


# The order in which benign rules are tried, written out apart from the catalogue.
_BENIGN_ORDER = (
    "Internal HTTPS request", "Internal HTTP request", "Internal TCP handshake ACK", "Internal SMB negotiation",
    "Internal ARP request", "Internal ARP reply", "Internal TCP SYN", "External TCP SYN", "Common External DNS query",
    "Internal DNS query", "Failed DNS response", "DHCP discover", "DHCP offer", "NTP client")


def benign_case(field: str) -> str:
    by_name = {r.description: r for r in catalog.BENIGN_RULES}
    ordered = [by_name[name] for name in _BENIGN_ORDER]
    def value(r):
        v = getattr(r, field)
        return q(v) if isinstance(v, str) else (f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v))
    return "CASE " + " ".join(f"WHEN {benign_sql(r)} THEN {value(r)}" for r in ordered) + " END"


LOCATION = r"""CASE WHEN {ip} IS NULL THEN NULL WHEN {ip} IN ('127.0.0.1','::1') THEN 'localhost'
    WHEN NOT regexp_matches({ip}, '^\d+\.\d+\.\d+\.\d+$') THEN 'unknown'
    WHEN regexp_matches({ip}, '^(0|10|127)\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.2\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^2[45][0-9]\.') THEN 'internal'
    WHEN regexp_matches({ip}, '^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.') THEN 'special' ELSE 'external' END"""

TIME_FACTOR = """CASE WHEN {t} IS NULL THEN 1.0
    WHEN (isodow({t}) = 7 AND hour({t}) >= 22) OR (isodow({t}) = 1 AND hour({t}) < 4) THEN 0.5
    WHEN (isodow({t}) = 4 AND hour({t}) >= 23) OR (isodow({t}) = 5 AND hour({t}) < 1) THEN 0.5
    WHEN isodow({t}) <= 5 AND hour({t}) >= 8 AND hour({t}) < 18 THEN 0.7 ELSE 1.5 END"""


def steps(value: str, bounds: tuple, factors: tuple) -> str:
    arms = " ".join(f"WHEN {value} <= {b} THEN CAST({f} AS DOUBLE)" for b, f in zip(bounds, factors, strict=False))
    return f"CASE {arms} ELSE CAST({factors[-1]} AS DOUBLE) END"


def cut(value: str, bounds: tuple) -> str:
    arms = " ".join(f"WHEN {value} < {b} THEN {i}" for i, b in enumerate(bounds, 1))
    return f"CASE {arms} ELSE {len(bounds) + 1} END"


def _scored() -> str:
    trusted = values([(p.process_name, p.description, p.base_trust, p.paths[0].lower(), p.users[0] == "*",
                       ",".join(p.users), "," + ",".join(map(str, p.allowed_ports)) + ",") for p in catalog.TRUSTED_PROCESSES])
    services = values([(s.service, port, s.protocol, s.internal_only, s.risk_factor)
                       for s in catalog.SERVICES for port in s.ports])
    factors = catalog.FREQUENCY_FACTORS
    command_hits = [rx(r.pattern, "coalesce(command_line, '')") for r in catalog.COMMAND_RULES]
    weights = [r.weight for r in catalog.COMMAND_RULES]
    hit_list = "list_filter([" + ",".join(
        f"CASE WHEN {c} THEN CAST({w} AS DOUBLE) END" for c, w in zip(command_hits, weights, strict=True)) + "], lambda x: x IS NOT NULL)"
    reason_list = "list_filter([" + ",".join(
        f"CASE WHEN {c} THEN {q(r.description)} END" for c, r in zip(command_hits, catalog.COMMAND_RULES, strict=True)) + "], lambda x: x IS NOT NULL)"
    window = "ORDER BY event_time RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND CURRENT ROW"
    return f"""
known AS (SELECT *, CASE kind WHEN 'NETWORK' THEN 'net:' || source_ip || '->' || dest_ip ELSE 'proc:' || process_name END AS freq_key,
    CASE kind WHEN 'NETWORK' THEN protocol || ':' || coalesce(dest_port, 0)
        ELSE CASE WHEN "user" <> '' THEN "user" ELSE 'UnknownUser' END END AS freq_source
    FROM ev WHERE kind <> 'GENERIC'),
dyn AS (SELECT *, count(*) OVER (PARTITION BY source_file, freq_key, freq_source ORDER BY line_number) AS frequency,
    CASE WHEN kind = 'NETWORK' THEN count(*) OVER (PARTITION BY source_file, kind, source_ip, dest_ip {window}) ELSE 0 END AS w_pair,
    sum(CASE WHEN kind = 'PROCESS' THEN 1 ELSE 0 END) OVER (PARTITION BY source_file, process_name {window}) AS w_proc,
    sum(CASE WHEN kind = 'NETWORK' THEN 1 ELSE 0 END) OVER (PARTITION BY source_file, process_name {window}) AS w_net
    FROM known),
corr AS (SELECT *, CAST(CASE WHEN kind = 'PROCESS' THEN w_proc + w_net WHEN process_name <> '' THEN w_pair + w_proc
    ELSE w_pair END AS BIGINT) AS correlated FROM dyn),
looked AS (SELECT c.*, t.description AS t_description, t.base AS t_base, t.path AS t_path, t.any_user, t.users, t.ports,
    s.service, s.internal_only, s.risk_factor, {LOCATION.format(ip='c.source_ip')} AS source_location,
    {LOCATION.format(ip='c.dest_ip')} AS dest_location, CAST({TIME_FACTOR.format(t='c.event_time')} AS DOUBLE) AS time_factor,
    CASE WHEN kind = 'NETWORK' THEN {benign_case('description')} END AS b_description,
    CASE WHEN kind = 'NETWORK' THEN {benign_case('max_freq')} END AS b_max,
    CASE WHEN kind = 'NETWORK' THEN {benign_case('multiplier')} END AS b_multiplier
    FROM corr c LEFT JOIN {trusted} t(name, description, base, path, any_user, users, ports) ON lower(c.process_name) = t.name
    LEFT JOIN {services} s(service, port, protocol, internal_only, risk_factor)
        ON c.dest_port = s.port AND upper(c.protocol) = s.protocol),
checked AS (SELECT *, CASE WHEN kind = 'PROCESS' AND path <> '' THEN lower(path) = t_path END AS path_ok,
    CASE WHEN kind = 'PROCESS' AND "user" <> '' THEN any_user OR list_contains(string_split(users, ','), "user") END AS user_ok,
    CASE WHEN kind = 'NETWORK' AND source_port <> 0 AND dest_port <> 0 THEN
        list_filter(CASE WHEN source_port = dest_port THEN [source_port] ELSE list_sort([source_port, dest_port]) END,
            lambda p: NOT contains(ports, ',' || p || ',')) END AS unexpected,
    CASE WHEN kind = 'PROCESS' THEN {hit_list} END AS c_hits, CASE WHEN kind = 'PROCESS' THEN {reason_list} END AS c_reasons,
    CASE WHEN b_description IS NULL THEN 1.0 WHEN frequency > b_max THEN b_multiplier * 1.5 ELSE b_multiplier END AS benign_factor
    FROM looked),
scores AS (SELECT *,
    CASE WHEN kind = 'NETWORK' AND process_name = '' THEN CAST(1.0 AS DOUBLE) WHEN t_base IS NULL THEN CAST(0.1 AS DOUBLE)
        ELSE greatest(CAST(0.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE), CAST(t_base AS DOUBLE)
            - (CASE WHEN NOT path_ok THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
             + CASE WHEN NOT user_ok THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
             + CASE WHEN len(unexpected) > 0 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END))) END AS trust,
    CASE WHEN kind = 'NETWORK' THEN greatest(CAST(0.1 AS DOUBLE),
        CASE WHEN source_location = 'internal' AND dest_location = 'internal' THEN CAST(0.3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
        * CASE WHEN service IS NULL THEN CAST(1.5 AS DOUBLE) WHEN internal_only AND dest_location <> 'internal'
            THEN CAST(risk_factor AS DOUBLE) * CAST(2.5 AS DOUBLE) ELSE CAST(risk_factor AS DOUBLE) END
        * CASE WHEN source_location = 'external' AND dest_location = 'internal' THEN CAST(1.5 AS DOUBLE)
            WHEN source_location = 'internal' AND dest_location = 'external' THEN CAST(1.1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
        * time_factor) END AS connection_risk,
    CASE WHEN kind = 'PROCESS' THEN CASE WHEN len(c_hits) = 0 THEN CAST(1 AS DOUBLE) WHEN len(c_hits) = 1 THEN c_hits[1]
        ELSE least(CAST(5 AS DOUBLE), list_max(c_hits) + list_sum(c_hits[1:len(c_hits)-1]) * CAST(0.2 AS DOUBLE)) END END AS command_risk,
    {steps('correlated', (1, 3, 7, 15), (1.0, 1.2, 1.5, 2.0, 2.5))} AS correlation_factor,
    CASE WHEN kind = 'PROCESS' THEN {steps('frequency', catalog.FREQUENCY_PROCESS, factors)}
        WHEN source_location = 'internal' THEN {steps('frequency', catalog.FREQUENCY_INTERNAL, factors)}
        ELSE {steps('frequency', catalog.FREQUENCY_OTHER, factors)} END AS frequency_factor,
    b_description IS NOT NULL AND benign_factor < 1.5 AS suppressed
    FROM checked),
risk1 AS (SELECT *, CASE WHEN kind = 'NETWORK' THEN CASE WHEN trust < 0.6 THEN 1 + (1 - trust) * CAST(1.5 AS DOUBLE)
        WHEN trust < 0.8 THEN 1 + (1 - trust) * CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
        ELSE 1 + (1 - trust) * (1 - trust) * CAST(1.5 AS DOUBLE) END AS trust_multiplier FROM scores),
risk2 AS (SELECT *, CASE WHEN kind = 'NETWORK'
        THEN connection_risk * trust_multiplier * correlation_factor * frequency_factor * CAST(benign_factor AS DOUBLE)
        ELSE greatest(trust_multiplier, command_risk) * correlation_factor * frequency_factor
            * CASE WHEN time_factor > 1.01 THEN time_factor ELSE CAST(1 AS DOUBLE) END END AS unmitigated_risk FROM risk1),
risk3 AS (SELECT *, CASE WHEN kind = 'NETWORK' THEN (connection_risk < 0.5 OR trust >= CAST(0.9 AS DOUBLE)) AND unmitigated_risk > 1
        ELSE trust >= CAST(0.9 AS DOUBLE) AND command_risk < 2.5 AND unmitigated_risk > 1 END AS mitigated FROM risk2),
risk4 AS (SELECT *, CASE WHEN NOT mitigated THEN unmitigated_risk
    WHEN kind = 'NETWORK' THEN greatest(CAST(0.5 AS DOUBLE), least(connection_risk * trust_multiplier * CAST(benign_factor AS DOUBLE)
        * (1 + (correlation_factor - 1) * CAST(0.1 AS DOUBLE) + (frequency_factor - 1) * CAST(0.1 AS DOUBLE)),
        unmitigated_risk * CAST(0.3 AS DOUBLE)))
    ELSE greatest(CAST(0.5 AS DOUBLE), least(greatest(CAST(1 AS DOUBLE), command_risk) * (1 + (correlation_factor - 1) * CAST(0.05 AS DOUBLE)
        + (frequency_factor - 1) * CAST(0.05 AS DOUBLE) + (time_factor - 1) * CAST(0.1 AS DOUBLE)),
        unmitigated_risk * CAST(0.25 AS DOUBLE))) END AS risk FROM risk3),
scored AS (SELECT *, CASE WHEN kind = 'NETWORK' THEN {cut('risk', catalog.NETWORK_CUTOFFS)}
    ELSE {cut('risk', catalog.PROCESS_CUTOFFS)} END AS dynamic_severity FROM risk4)"""


def f2(x: str, places: int = 2) -> str:
    return f"printf('%.{places}f', CAST({x} AS DOUBLE))"


def listed(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ",".join(f"CASE WHEN {c} THEN {v} END" for c, v in pairs) + "], lambda x: x IS NOT NULL)"


def _reasons() -> str:
    conn = listed(
        ("source_location = 'internal' AND dest_location = 'internal'", "'Internal communication'"),
        ("service IS NOT NULL", f"'Known service: ' || service || ' (Risk Factor: ' || {f2('risk_factor')} || ')'"),
        ("service IS NOT NULL AND internal_only AND dest_location <> 'internal'",
         "'WARN: Internal-only service ''' || service || ''' accessed from ' || dest_location"),
        ("service IS NULL", "'WARN: Connection on uncommon port ' || dest_port || '/' || protocol"),
        ("source_location = 'external' AND dest_location = 'internal'", "'External to internal connection'"),
        ("source_location = 'internal' AND dest_location = 'external'", "'Internal to external connection'"),
        ("source_location = 'external' AND dest_location = 'external'", "'External to external connection'"),
        ("time_factor <> 1", f"'Time factor applied: ' || {f2('time_factor')}"))
    trust = listed(
        ("t_base IS NULL", "'Unknown process'"),
        ("t_base IS NOT NULL", f"'Known process: ' || t_description || ' (Base Trust: ' || {f2('t_base')} || ')'"),
        ("t_base IS NOT NULL AND NOT path_ok", "'PENALTY: Running from non-standard path: ' || path"),
        ("t_base IS NOT NULL AND path_ok", "'Path matches trusted definition.'"),
        ("t_base IS NOT NULL AND NOT user_ok", "'PENALTY: Running as unexpected user: ' || \"user\""),
        ("t_base IS NOT NULL AND user_ok", "'User matches trusted definition.'"),
        ("t_base IS NOT NULL AND len(unexpected) > 0",
         "'PENALTY: Using unexpected ports: {' || array_to_string(unexpected, ', ') || '}'"),
        ("t_base IS NOT NULL AND len(unexpected) = 0", "'Ports match trusted definition.'"))
    boosts = listed(
        ("correlation_factor > 1.01", f"'Correlation Boost (x' || {f2('correlation_factor')} || ')'"),
        ("frequency_factor > 1.01", f"'Frequency Boost (x' || {f2('frequency_factor')} || ')'"))
    note = (f"CASE WHEN kind = 'NETWORK' THEN 'MITIGATION: Risk reduced from ' || {f2('unmitigated_risk')} || ' due to ' || "
            f"concat_ws(' ', CASE WHEN trust >= 0.9 THEN 'high process trust (' || {f2('trust')} || ')' END, "
            f"CASE WHEN connection_risk < 0.5 THEN 'low base connection risk (' || {f2('connection_risk')} || ')' END) || '.' "
            f"ELSE 'MITIGATION: Risk reduced from ' || {f2('unmitigated_risk')} || ' due to high process trust (' || {f2('trust')} || "
            f"') and low/moderate cmd risk (' || {f2('command_risk', 1)} || ').' END")
    return f"""
noted AS (SELECT *, {conn} AS conn_reasons,
    CASE WHEN kind = 'NETWORK' AND process_name = '' THEN ['Process info N/A'] ELSE {trust} END AS trust_reasons,
    {boosts} AS boosts, CASE WHEN mitigated THEN {note} END AS mitigation_reason FROM scored),
reasoned AS (SELECT *, CASE WHEN kind = 'NETWORK'
    THEN conn_reasons || CASE WHEN trust < 0.8 THEN trust_reasons ELSE [] END || boosts
    ELSE trust_reasons || CASE WHEN command_risk > 1 THEN c_reasons ELSE ['Low command line risk.'] END || boosts
        || CASE WHEN time_factor > 1.01 THEN ['Off-Hours Execution (x' || {f2('time_factor')} || ')'] ELSE [] END END
    || CASE WHEN mitigated THEN [mitigation_reason] ELSE [] END AS reasons FROM noted),
dynf AS (SELECT * FROM reasoned WHERE NOT suppressed AND dynamic_severity >= 2)"""


def _findings() -> str:
    return """
chosen AS (SELECT coalesce(d.source_file, b.source_file) AS source_file, coalesce(d.line_number, b.line_number) AS line_number,
    coalesce(d.line, b.line) AS content, b.severity AS r_severity, b.category AS r_category, b.description AS r_description,
    d.dynamic_severity, d.risk, d.reasons, d.kind, d.mitigated, d.command_risk, d.correlation_factor, d.frequency_factor,
    d.time_factor, d.process_name, d.correlated,
    d.dynamic_severity IS NOT NULL AND (b.severity IS NULL OR d.dynamic_severity >= b.severity
        OR (b.category IN ('AUTH','NETWORK','BASELINE') AND b.severity <= 2)) AS wins
    FROM dynf d FULL OUTER JOIN best b ON d.source_file = b.source_file AND d.line_number = b.line_number),
findings AS (SELECT c.*, CASE WHEN wins THEN dynamic_severity ELSE r_severity END AS severity,
    CASE WHEN wins THEN 'dynamic' ELSE 'rule' END AS verdict_source, e.event_time
    FROM chosen c JOIN ev e ON c.source_file = e.source_file AND c.line_number = e.line_number),
reason_rows AS (SELECT source_file, line_number, u.i AS pos, u.reason AS reason FROM (
    SELECT source_file, line_number, unnest([{'i': 1, 'reason': reasons[1]}, {'i': 2, 'reason': reasons[2]},
        {'i': 3, 'reason': reasons[3]}, {'i': 4, 'reason': reasons[4]}]) AS u FROM findings WHERE wins)
    WHERE u.reason IS NOT NULL AND NOT starts_with(u.reason, 'MITIGATION')),
kinds AS (SELECT r.*, replace(replace(trim(split_part(reason, '(', 1)), 'Boost', ''), 'Factor', '') AS t, f.kind
    FROM reason_rows r JOIN findings f ON r.source_file = f.source_file AND r.line_number = f.line_number),
indicators AS (SELECT source_file, line_number, pos, CASE WHEN t = '' THEN 'Context' ELSE t END AS type,
    CASE WHEN contains(t, 'Pattern') THEN 'BASELINE'
        WHEN contains(t, 'Process') OR contains(t, 'Trust') OR (kind = 'PROCESS' AND contains(t, 'Command')) THEN 'PROCESS'
        WHEN contains(t, 'Connection') OR contains(t, 'Port') OR contains(t, 'Service') THEN 'NETWORK' ELSE 'BEHAVIOR' END AS category,
    reason AS description FROM kinds
    UNION ALL SELECT source_file, line_number, 1, 'PatternMatch', r_category, r_description FROM findings WHERE NOT wins),
factor_rows AS (SELECT source_file, line_number, unnest(list_filter([
        'SUMMARY:SeverityDecision', CASE WHEN kind = 'NETWORK' THEN 'NETWORK:BaseConnectionRisk' END,
        CASE WHEN kind = 'PROCESS' OR process_name <> '' THEN 'PROCESS:ProcessTrust' END,
        CASE WHEN command_risk > 1 THEN 'PROCESS:CommandLineRisk' END,
        CASE WHEN correlation_factor > 1.01 THEN 'BEHAVIOR:CorrelationFactor' END,
        CASE WHEN frequency_factor > 1.01 THEN 'BEHAVIOR:FrequencyFactor' END,
        CASE WHEN kind = 'PROCESS' AND time_factor > 1.01 THEN 'BEHAVIOR:TimeContextFactor' END,
        CASE WHEN mitigated THEN 'BASELINE:RiskMitigation' END], lambda x: x IS NOT NULL)) AS factor FROM findings WHERE wins
    UNION ALL SELECT source_file, line_number, r_category || ':PatternMatch' FROM findings WHERE NOT wins),
first_category AS (SELECT source_file, line_number, category FROM indicators QUALIFY row_number() OVER (
    PARTITION BY source_file, line_number ORDER BY pos) = 1)"""


def _file_findings() -> str:
    return """
ff AS (SELECT source_file, line_number, line AS content, max(severity) AS severity, count(*) AS n_indicators,
    string_agg(description, ' | ' ORDER BY rule_id) AS descriptions, string_agg(category, ' | ' ORDER BY rule_id) AS categories
    FROM scan_hits GROUP BY ALL)"""


def _documents() -> str:
    return """
doc_lines AS (SELECT doc_id, lang, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos, unnest(parts) AS line
    FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents))"""


def _packets() -> str:
    pattern = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)\s+(" + _IP + r"):(\d+)\s+->\s+(" + _IP + r"):(\d+)(.*)$"
    def g(n):
        return f"regexp_extract(line, {q(pattern)}, {n})"
    return f"""
packets AS (SELECT source_file, line_number, CAST({g(1)} AS TIMESTAMP) AS event_time, {g(2)} AS source_ip,
    CAST({g(3)} AS INTEGER) AS source_port, {g(4)} AS dest_ip, CAST({g(5)} AS INTEGER) AS dest_port,
    regexp_extract(line, '\\[([A-Z,]+)\\]', 1) AS flags, CAST(regexp_extract(line, 'Seq=(\\d+)', 1) AS BIGINT) AS seq,
    CAST(regexp_extract(line, 'Win=(\\d+)', 1) AS BIGINT) AS win, CAST(regexp_extract(line, 'Len=(\\d+)', 1) AS BIGINT) AS length
    FROM raw WHERE regexp_matches(line, {q(pattern)}))"""


def _verdicts() -> str:
    return """
verdicts AS (SELECT source_file, line_number, CASE WHEN line_number % 3 = 0 THEN 'true' ELSE 'false' END AS fp,
    CAST('0.' || (line_number % 10) AS DOUBLE) AS confidence, 'sample' AS explanation, CAST(line_number % 6 AS INTEGER) AS revised
    FROM findings WHERE line_number % 7 <> 0)"""


_PARTS = {
    "raw": (_derived, ()),
    "ev": (_events, ("raw",)),
    "root_hits": (lambda: hits_cte("root_hits", catalog.ROOT_RULES), ("raw",)),
    "scan_hits": (lambda: hits_cte("scan_hits", catalog.SCAN_RULES), ("raw",)),
    "threat_hits": (lambda: hits_cte("threat_hits", catalog.THREAT_RULES), ("raw",)),
    "best": (_best, ("root_hits",)),
    "scored": (_scored, ("ev",)),
    "dynf": (_reasons, ("scored",)),
    "findings": (_findings, ("dynf", "best")),
    "ff": (_file_findings, ("scan_hits",)),
    "doc_lines": (_documents, ()),
    "packets": (_packets, ("raw",)),
    "verdicts": (_verdicts, ("findings",)),
}


def _json_raw() -> str:
    """The log as JSON documents: a connection for every event, arrays for even blocks, objects for odd ones."""
    iso = "strftime(log_ts, '%Y-%m-%d %H:%M:%S')"
    return _derived().replace("\nraw AS (", "\nraw0 AS (") + f""",
raw AS (SELECT event_id, CASE WHEN block % 2 = 0 THEN event_id % 200 + 1 ELSE 1 END AS line_number,
    'doc' || CASE WHEN block % 2 = 0 THEN block * 200 ELSE event_id END AS source_file, log_ts, block, k, user_id,
    '{{"timestamp":"' || {iso} || '","src_ip":"45.67.0.' || user_id % 3 || '","dst_ip":"10.0.0.' || event_id % 3 ||
    '","dst_port":' || [80, 4444, 22][event_id % 3 + 1] || ',"src_port":' || 40000 + user_id || ',"protocol":"tcp","bytes":0}}' AS line FROM raw0)"""


def json_sql(needs: str, select: str) -> str:
    """`sql` over the log as JSON documents."""
    return sql(needs, select).replace(_derived(), _json_raw())


def sql(needs: str, select: str) -> str:
    """`select` with the common tables it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in _PARTS[name][1]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    ctes = ",".join(_PARTS[name][0]() for name in order)
    select = select.strip()
    if not ctes:
        return select
    if select.upper().startswith("WITH "):
        return f"WITH {ctes},\n{select[5:]}"
    return f"WITH {ctes}\n{select}"
