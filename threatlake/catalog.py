"""Reference data of the scanner: detection rules, baselines and thresholds.

Everything in this module is a *fixed value*: patterns, severities, word lists
and constants that the results depend on.  They are kept as plain text in one
place.  No table here grows with the data, so each may be unrolled into column
expressions or broadcast without a size check.

Patterns are written for ``java.util.regex`` with single escapes.  Where the
original literal only matches text with doubled backslashes, the entry carries
``as_written_live=False``: the pattern below is the evident intent.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """One detection rule.

    ``hints`` are lower-case literals of which at least one occurs in every
    matching line; they gate the regex.  ``min_tokens`` is an alternative
    condition: the line also matches when it holds that many short numbers.
    ``published`` is the original text where ``pattern`` differs from it by more
    than the flag in front.
    """

    rule_id: int
    ruleset: str
    description: str
    category: str
    severity: int
    pattern: str
    hints: tuple[str, ...] = ()
    confidence: float = 1.0
    source: str = "default"
    as_written_live: bool = True
    min_tokens: int | None = None
    published: str = ""

    @property
    def text(self) -> str:
        """The pattern as it is published and exported; `pattern` is the form the engine runs."""
        return self.published or f"(?i){self.pattern}"


class BenignRule(NamedTuple):
    description: str
    pattern: str
    max_freq: int
    multiplier: float
    as_written_live: bool
    priority: int
    hints: tuple[str, ...]  # as for Rule


class CommandRule(NamedTuple):
    description: str
    pattern: str
    weight: float
    as_written_live: bool


class TrustedProcess(NamedTuple):
    process_name: str
    description: str
    paths: tuple[str, ...]
    users: tuple[str, ...]
    allowed_ports: tuple[int, ...]
    max_connections: int
    base_trust: float


class Service(NamedTuple):
    service: str
    ports: tuple[int, ...]
    protocol: str
    internal_only: bool
    per_minute_limit: int | None
    risk_factor: float


# Case-insensitive (Unicode-aware), "." stops at line feeds only.
FLAGS = "(?iud)"
UNICODE_FLAGS = "(?iUd)"

# The three RFC 1918 prefixes as the rules spell them.
INTERNAL_PREFIX = r"(?:192\.168\.|10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)"
DOTTED_QUAD = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
_NOT_INTERNAL = r"(?!192\.168\.|10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)" + DOTTED_QUAD

# --------------------------------------------------------------------------
# Line rules, in catalogue order (order breaks severity ties).
# --------------------------------------------------------------------------
ROOT_RULES: tuple[Rule, ...] = (
    Rule(1, "root", "Port scan detected (Nmap/Masscan Only)", "RECON", 3,
         r"(?:nmap|masscan|aggressive\s+scan).*(?:port|scan)",
         ("nmap", "masscan", "aggressive")),
    Rule(2, "root", "External SSH brute force attempt", "ATTACK", 4,
         r"(?:failed|invalid)\s+ssh\s+(?:login|password|authentication).*?from\s+" + _NOT_INTERNAL,
         ("ssh",)),
    Rule(3, "root", "Internal SSH failed login", "AUTH", 2,
         r"(?:failed|invalid)\s+ssh\s+(?:login|password|authentication).*?from\s+" + INTERNAL_PREFIX,
         ("ssh",)),
    Rule(4, "root", "Successful internal SSH login", "AUTH", 1,
         r"accepted\s+(?:password|publickey)\s+for.*?from\s+" + INTERNAL_PREFIX,
         ("accepted",)),
    Rule(5, "root", "Suspicious outbound connection", "MALWARE", 3,
         r"(?:outbound|external)\s+connection\s+to\s+"
         r"(?:known\s+malicious|blacklisted|c2|command.*control)\s+(?:host|ip|domain)",
         ("connection",)),
    Rule(6, "root", "Routine DNS query", "NETWORK", 1,
         r"dns\s+query\s+(?:to|for)\s+"
         r"(?:google\.com|microsoft\.com|windowsupdate\.com|.*\.local)",
         ("dns",)),
    Rule(7, "root", "DNS query to known malicious domain", "C2", 5,
         r"dns\s+query\s+(?:to|for)\s+(?:known\s+malicious|blacklisted|malware|c2)\s+domain:\s*\S+",
         ("dns",)),
    Rule(8, "root", "Suspicious HTTP request", "WEB", 2,
         r"(?:GET|POST|PUT)\s+.*?(?:admin|login|wp-admin|phpmyadmin)",
         ("admin", "login")),
    Rule(9, "root", "Critical HTTP exploit attempt", "EXPLOIT", 5,
         r"(?:GET|POST|PUT)\s+.*?(?:eval\(|exec\(|system\(|\bcmd\.exe\b|"
         r"\bpowershell\s+-enc\b|\bbase64\b.*?\bexec\b)",
         ("eval(", "exec(", "system(", "cmd.exe", "powershell", "base64")),
    Rule(10, "root", "Failed authentication - internal", "AUTH", 2,
         r"(?:failed|invalid)\s+(?:login|auth|password).*?from\s+" + INTERNAL_PREFIX,
         ("failed", "invalid")),
    Rule(11, "root", "Failed authentication - external", "AUTH", 4,
         r"(?:failed|invalid)\s+(?:login|auth|password).*?from\s+" + _NOT_INTERNAL,
         ("failed", "invalid")),
    Rule(12, "root", "Unusual protocol behavior - internal", "ANOMALY", 2,
         r"(?:unusual|abnormal|unexpected)\s+(?:protocol|behavior|traffic)\s+"
         r"(?:detected|observed|found).*?(?:source|from):\s+" + INTERNAL_PREFIX,
         ("unusual", "abnormal", "unexpected")),
    Rule(13, "root", "Unusual protocol behavior - external", "ANOMALY", 3,
         r"(?:unusual|abnormal|unexpected)\s+(?:protocol|behavior|traffic)\s+"
         r"(?:detected|observed|found).*?(?:source|from):\s+" + _NOT_INTERNAL,
         ("unusual", "abnormal", "unexpected")),
    Rule(14, "root", "Large data transfer - internal", "EXFIL", 2,
         r"(?:large|bulk)\s+(?:upload|transfer|copy)\s+"
         r"(?:\d+\s*(?:MB|GB|TB)|(?:10|[2-9]0+)\+\s+files)\s+to\s+" + INTERNAL_PREFIX,
         ("large", "bulk")),
    Rule(15, "root", "Large data transfer - external", "EXFIL", 4,
         r"(?:large|bulk)\s+(?:upload|transfer|copy)\s+"
         r"(?:\d+\s*(?:MB|GB|TB)|(?:10|[2-9]0+)\+\s+files)\s+to\s+" + _NOT_INTERNAL,
         ("large", "bulk")),
    Rule(16, "root", "IDS Alert: Potential Exploit Detected", "IDS_ALERT", 4,
         r"(?:ET\s|SNORT\s).*?(?:EXPLOIT|MALWARE|ATTACK|POLICY).*?(?:Sig:.*?)?"
         r"(?:Cls:.*?Exploit|Cls:.*?Malware)",
         ("cls:",), 0.9, "default_ids"),
    Rule(17, "root", "IDS Alert: Suspicious Network Activity", "IDS_ALERT", 3,
         r"(?:ET\s|SNORT\s).*?(?:SCAN|INFO|POLICY|SUSPICIOUS|ANOMALY).*?(?:Sig:.*?)?"
         r"(?:Cls:.*?Scan|Cls:.*?Info|Cls:.*?Policy)",
         ("cls:",), 0.8, "default_ids"),
    Rule(18, "root", "Vulnerability Finding: Critical Severity", "VULNERABILITY", 5,
         r"Vulnerability.*?(?:CVE-[0-9]{4}-[0-9]{4,}).*?(?:Severity|Risk):\s*"
         r"(?:Critical|High|10\.0|9\.[0-9])",
         ("vulnerability",), 1.0, "default_vuln"),
    Rule(19, "root", "Vulnerability Finding: Medium Severity", "VULNERABILITY", 3,
         r"Vulnerability.*?(?:CVE-[0-9]{4}-[0-9]{4,}).*?(?:Severity|Risk):\s*"
         r"(?:Medium|[4-6]\.[0-9])",
         ("vulnerability",), 0.9, "default_vuln"),
    Rule(20, "root", "Misconfiguration: Insecure Service", "MISCONFIGURATION", 4,
         r"Misconfiguration.*?(?:Insecure|Weak|Default|Exposed).*?"
         r"(?:Service|Setting|Password|Permissions)",
         ("misconfiguration",), 0.9, "default_config"),
)

# --------------------------------------------------------------------------
# Rules of the plain file scan (packet exports, memory dumps,
# generic text).
# --------------------------------------------------------------------------
SCAN_RULES: tuple[Rule, ...] = (
    Rule(1, "scan", "Port scan detected", "RECON", 4,
         # The second arm backtracks without bound, so it is a count of short numbers here.
         r"(?:scan|probe|discover).*port", ("port",), min_tokens=5,
         published=r"(?i)(scan|probe|discover).*port|(?:\b\d{1,5}\b.*){5,}"),
    Rule(2, "scan", "Potential brute force attempt", "ATTACK", 4,
         r"(?:failed|invalid|wrong).*(?:login|password|authentication)|authentication\s+failure",
         ("failed", "invalid", "wrong", "authentication"),
         # The group is not captured here.
         published=r"(?i)(failed|invalid|wrong).*(?:login|password|authentication)|authentication\s+failure"),
    Rule(3, "scan", "Suspicious outbound connection", "MALWARE", 3,
         r"(?:outbound|external).*(?:connection|traffic).*(?:unknown|suspicious|malicious)",
         ("connection", "traffic")),
    Rule(4, "scan", "DNS query to known malicious domain", "C2", 5,
         r"dns.*(?:query|lookup).*(?:malicious|suspicious|blocked)", ("dns",)),
    Rule(5, "scan", "HTTP request with malicious payload", "EXPLOIT", 5,
         r"(?:GET|POST|PUT).*(?:eval|exec|system|cmd|shell|script|wget|curl)",
         ("get", "post", "put")),
    Rule(6, "scan", "Failed authentication attempt", "AUTH", 2,
         r"(?:failed|invalid|error).*(?:login|auth|password)", ("login", "auth", "password")),
    Rule(7, "scan", "Unusual protocol behavior", "ANOMALY", 3,
         r"(?:unusual|abnormal|unexpected).*(?:protocol|behavior|traffic)",
         ("unusual", "abnormal", "unexpected")),
    Rule(8, "scan", "Data exfiltration attempt", "EXFIL", 5,
         r"(?:upload|transfer|copy).*(?:large|multiple|suspicious).*(?:file|data)",
         ("upload", "transfer", "copy")),
    Rule(9, "scan", "Privilege escalation attempt", "PRIVESC", 5,
         r"(?:sudo|su|runas|privilege|admin).*(?:escalation|elevation)",
         ("escalation", "elevation")),
    Rule(10, "scan", "Suspicious file access", "ACCESS", 3,
         r"(?:access|read|write).*(?:denied|unauthorized|suspicious)",
         ("denied", "unauthorized", "suspicious")),
    Rule(11, "scan", "Suspicious network traffic pattern", "NETWORK", 4,
         r"(?:syn|ack|fin|rst).*flood|(?:ddos|dos).*attack", ("flood", "attack")),
    Rule(12, "scan", "Malware communication pattern", "MALWARE", 5,
         r"(?:beacon|callback|c2|command.*control)", ("beacon", "callback", "c2", "command")),
    Rule(13, "scan", "Suspicious process execution", "PROCESS", 4,
         r"(?:cmd\.exe|powershell|bash).*(?:execute|spawn|run)",
         ("cmd.exe", "powershell", "bash")),
    Rule(14, "scan", "Suspicious file operation", "FILE", 3,
         r"(?:create|modify|delete).*(?:system32|windows|etc)", ("create", "modify", "delete")),
)
# The second arm of the port-scan rule: at least `min_tokens` of these.
SHORT_NUMBER = r"\b\d{1,5}\b"

# --------------------------------------------------------------------------
# Threat families.  `source` is the family; on equal keys a later
# family replaces an earlier one.
# --------------------------------------------------------------------------
THREAT_KEYS: tuple[str, ...] = (
    "port_scan", "brute_force", "data_exfil", "privilege_escalation", "file_manipulation",
    "command_control", "payload_execution", "injection", "overflow", "private_ip", "suspicious_ip",
)
THREAT_RULES: tuple[Rule, ...] = (
    Rule(1, "threat", "Potential port scanning activity detected", "NETWORK", 3,
         r"(?:scan|probe|discover).*port.*\b(?:\d{1,5})\b", ("port",), source="network"),
    Rule(2, "threat", "Possible brute force attack", "NETWORK", 4,
         r"(?:failed|invalid|bad).*(?:login|password|authentication).*attempts?",
         ("attempt",), source="network"),
    Rule(3, "threat", "Potential data exfiltration", "NETWORK", 4,
         r"(?:upload|transfer|exfil).*(?:data|file).*(?:external|remote)",
         ("external", "remote"), source="network"),
    Rule(4, "threat", "Potential privilege escalation attempt", "SYSTEM", 5,
         r"(?:sudo|su|privilege|admin).*(?:escalation|elevation)",
         ("escalation", "elevation"), source="system"),
    Rule(5, "threat", "Suspicious file manipulation", "SYSTEM", 4,
         r"(?:modify|delete|change).*(?:system|config|binary).*files?", ("file",), source="system"),
    Rule(6, "threat", "Potential C2 communication", "MALWARE", 5,
         r"(?:beacon|callback|c2|command.*control)",
         ("beacon", "callback", "c2", "command"), source="malware"),
    Rule(7, "threat", "Suspicious payload execution", "MALWARE", 5,
         r"(?:execute|run|launch).*(?:payload|shellcode|malware)",
         ("payload", "shellcode", "malware"), source="malware"),
    Rule(8, "threat", "Potential injection attack", "EXPLOIT", 4,
         r"(?:sql|command|code).*injection", ("injection",), source="exploit"),
    Rule(9, "threat", "Potential overflow attack", "EXPLOIT", 5,
         r"(?:buffer|stack|heap).*overflow", ("overflow",), source="exploit"),
    Rule(10, "threat", "Private IP address detected", "NETWORK", 2,
         r"\b(?:10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.)\d{1,3}\.\d{1,3}\b", (), source="ip"),
    Rule(11, "threat", "Known DNS server IP detected", "NETWORK", 2,
         r"\b(?:1\.1\.1\.1|8\.8\.8\.8|8\.8\.4\.4)\b",
         ("1.1.1.1", "8.8.8.8", "8.8.4.4"), source="ip"),
)

# --------------------------------------------------------------------------
# Benign traffic, with the place in which each rule is tried.
# --------------------------------------------------------------------------
BENIGN_RULES: tuple[BenignRule, ...] = (
    BenignRule("Internal DNS query", r"dns.*query.*(?:\.local|\.internal)", 500, 0.1, False, 10, ("dns",)),
    BenignRule("Common External DNS query",
               r"dns.*query.*(?:google\.com|microsoft\.com|windowsupdate\.com)", 200, 0.3, False, 9, ("dns",)),
    BenignRule("Failed DNS response", r"dns.*response.*(?:NXDOMAIN|SERVFAIL)", 100, 0.7, True, 11, ("dns",)),
    BenignRule("Internal ARP request", r"arp.*who-has.*" + INTERNAL_PREFIX, 1000, 0.1, False, 5, ("arp",)),
    BenignRule("Internal ARP reply", r"arp.*reply.*" + INTERNAL_PREFIX, 1000, 0.1, False, 6, ("arp",)),
    BenignRule("DHCP discover", r"dhcp.*discover", 50, 0.2, True, 12, ("dhcp",)),
    BenignRule("DHCP offer", r"dhcp.*offer", 50, 0.2, True, 13, ("dhcp",)),
    BenignRule("Internal TCP SYN", r"tcp.*syn.*" + INTERNAL_PREFIX, 1000, 0.2, False, 7, ("syn",)),
    BenignRule("Internal TCP handshake ACK",
               r"tcp.*(?:syn-ack|ack).*" + INTERNAL_PREFIX, 1000, 0.2, False, 3, ("ack",)),
    BenignRule("External TCP SYN",
               r"^(?!.*" + INTERNAL_PREFIX + r").*tcp.*syn", 150, 0.6, True, 8, ("syn",)),
    BenignRule("Internal HTTP request",
               r"http.*(?:GET|POST)\s+/(?!admin|login|wp-admin).*" + INTERNAL_PREFIX, 500, 0.3, False, 2, ("http",)),
    BenignRule("Internal HTTPS request",
               r"https.*(?:GET|POST)\s+/(?!admin|login|wp-admin).*" + INTERNAL_PREFIX, 500, 0.3, False, 1, ("https",)),
    BenignRule("NTP client", r"ntp.*client", 50, 0.2, True, 14, ("ntp",)),
    BenignRule("Internal SMB negotiation", r"smb.*negotiate.*" + INTERNAL_PREFIX, 100, 0.4, False, 4, ("smb",)),
)
BENIGN_HIGH_FREQUENCY_FACTOR = 1.5
BENIGN_SUPPRESS_BELOW = 1.5

# --------------------------------------------------------------------------
# Command lines, with weights.
# --------------------------------------------------------------------------
COMMAND_RULES: tuple[CommandRule, ...] = (
    CommandRule("Netcat execution listener", r"(?:nc|netcat)\s+-[el]", 5.0, False),
    CommandRule("PowerShell encoded command", r"powershell\s+-[^a-zA-Z]*e[^a-zA-Z]*c", 5.0, False),
    CommandRule("Known hacking tool", r"(?:mimikatz|psexec|bloodhound)", 5.0, True),
    CommandRule("Download executable from HTTP", r"(?:wget|curl)\s+http.*\.exe", 4.5, False),
    CommandRule("Base64 decode operation", r"base64\s*-d", 4.0, False),
    CommandRule("Execute from temp directory", r"\\temp\\.*\.exe", 4.0, False),
    CommandRule("Registry modification", r"(?:reg|regedit).*(?:add|delete|modify)", 3.5, True),
    CommandRule("User/Group manipulation", r"(?:net\s+user|net\s+localgroup)", 3.5, False),
    CommandRule("Making file executable", r"(?:chmod|icacls)\s+[+]x", 3.0, False),
    CommandRule("System enumeration", r"(?:whoami|systeminfo|ipconfig|netstat)\s+-[a-z]*", 2.5, False),
    CommandRule("Download from HTTP source", r"(?:wget|curl)\s+http", 2.0, False),
    CommandRule("Access temp directory", r"\\temp\\", 1.5, False),
)
COMMAND_EXTRA_SHARE = 0.2
COMMAND_RISK_CAP = 5.0

# --------------------------------------------------------------------------
# Trusted processes and known services.
# --------------------------------------------------------------------------
TRUSTED_PROCESSES: tuple[TrustedProcess, ...] = (
    TrustedProcess("svchost.exe", "Windows Service Host",
                   (r"C:\Windows\System32\svchost.exe",),
                   ("SYSTEM", "LOCAL SERVICE", "NETWORK SERVICE"),
                   (80, 443, 53, 123, 445, 135, 139), 500, 0.8),
    TrustedProcess("lsass.exe", "Windows Security Process",
                   (r"C:\Windows\System32\lsass.exe",), ("SYSTEM",),
                   (88, 389, 636, 3268, 3269), 200, 0.95),
    TrustedProcess("explorer.exe", "Windows Explorer",
                   (r"C:\Windows\explorer.exe",), ("*",), (445, 139, 137, 138), 100, 0.7),
    TrustedProcess("chrome.exe", "Google Chrome Browser",
                   (r"C:\Program Files\Google\Chrome\Application\chrome.exe",
                    r"C:\Program Files (x86)\Google\Chrome\Application\chrome.exe"),
                   ("*",), (80, 443, 53), 200, 0.7),
    TrustedProcess("firefox.exe", "Mozilla Firefox Browser",
                   (r"C:\Program Files\Mozilla Firefox\firefox.exe",
                    r"C:\Program Files (x86)\Mozilla Firefox\firefox.exe"),
                   ("*",), (80, 443, 53), 200, 0.7),
    TrustedProcess("code.exe", "Visual Studio Code",
                   (r"C:\Users\*\AppData\Local\Programs\Microsoft VS Code\Code.exe",),
                   ("*",), (80, 443), 100, 0.6),
)
UNKNOWN_PROCESS_TRUST = 0.1
PENALTY_PATH, PENALTY_USER, PENALTY_PORTS = 0.3, 0.2, 0.15

SERVICES: tuple[Service, ...] = (
    Service("SSH", (22,), "TCP", False, 5, 1.5),
    Service("DNS", (53,), "UDP", False, 500, 0.5),
    Service("HTTP", (80, 8080), "TCP", False, 1000, 0.8),
    Service("HTTPS", (443, 8443), "TCP", False, 1000, 0.7),
    Service("NTP", (123,), "UDP", False, 50, 0.3),
    Service("SMTP", (25, 587), "TCP", False, 100, 1.0),
    Service("SMB", (445,), "TCP", True, 200, 0.6),
    Service("RDP", (3389,), "TCP", True, 10, 1.2),
    Service("LDAP", (389, 636), "TCP", True, 500, 0.7),
    Service("SQL", (1433, 1434), "TCP", True, 100, 1.0),
)
UNKNOWN_SERVICE_RISK = 1.5
INTERNAL_ONLY_PENALTY = 2.5

# IP protocol numbers with a name.
PROTOCOL_NAMES = {"6": "TCP", "17": "UDP", "1": "ICMP"}

# Fixed values: (weekday, start hour, end hour, multiplier); Monday is 0.
MAINTENANCE_WINDOWS = ((6, 22, 4, 0.5), (3, 23, 1, 0.5))
BUSINESS_START, BUSINESS_END, BUSINESS_MULTIPLIER = 8, 18, 0.7
OFF_HOURS_MULTIPLIER = 1.5

# Step functions as (inclusive upper bound, factor) plus the top.
CORRELATION_STEPS, CORRELATION_TOP = ((1, 1.0), (3, 1.2), (7, 1.5), (15, 2.0)), 2.5
FREQUENCY_FACTORS = (1.0, 1.2, 1.6, 2.2, 3.0)
FREQUENCY_INTERNAL = (100, 500, 1000, 2000)
FREQUENCY_OTHER = (20, 100, 300, 500)
FREQUENCY_PROCESS = (5, 15, 30, 50)
DEVIATION_STEPS, DEVIATION_TOP = ((0.1, 0.0), (0.5, 2.0), (1.0, 3.0), (2.0, 4.0)), 5.0
# Exclusive upper bounds of severities 1 to 4.
NETWORK_CUTOFFS = (1.0, 2.0, 4.0, 6.0)
PROCESS_CUTOFFS = (1.2, 2.2, 4.5, 7.0)
CORRELATION_SECONDS = 300

# --------------------------------------------------------------------------
# The simple event scorer.
# --------------------------------------------------------------------------
BENIGN_PROCESSES = (
    "svchost.exe", "lsass.exe", "services.exe", "chrome.exe", "firefox.exe", "msedge.exe",
    "explorer.exe", "winlogon.exe", "spoolsv.exe", "wininit.exe", "csrss.exe", "smss.exe",
    "system", "registry", "dllhost.exe", "taskhost.exe",
)
COMMON_PORTS = {
    "tcp": (80, 443, 22, 53, 3389, 445, 139, 135, 25, 587, 993, 995),
    "udp": (53, 67, 68, 123, 137, 138, 161, 162, 500, 514, 1900),
}
SUSPICIOUS_NAME = r"(?:temp|tmp|unknown).*\.exe"
SUSPICIOUS_ARGS = r"(?:bypass|hidden|encrypt|decode)"
MAX_CONNECTIONS_PER_MINUTE = 100
SCORER_PORT_SCAN_LIMIT = 10
AFTER_HOURS_START, AFTER_HOURS_END = 23, 5
PROCESS_WEIGHTS = {"unknown_process": 2.0, "system_critical": 1.5, "user_space": 1.0}
NETWORK_WEIGHTS = {"external_connection": 1.5, "unusual_port": 1.2, "high_frequency": 1.3}
TIME_WEIGHTS = {"business_hours": 0.8, "after_hours": 1.2, "weekend": 1.1}

# --------------------------------------------------------------------------
# The declared network baseline and its alert thresholds.
# --------------------------------------------------------------------------
BASELINE_PROCESSES = (
    "svchost.exe", "lsass.exe", "services.exe", "chrome.exe", "firefox.exe", "msedge.exe",
    "explorer.exe", "winlogon.exe", "spoolsv.exe", "wininit.exe", "csrss.exe", "smss.exe",
    "system", "registry",
)
BASELINE_PORTS = {
    "TCP": (20, 21, 22, 23, 25, 53, 80, 110, 143, 443, 445, 3389, 8080, 8443),
    "UDP": (53, 67, 68, 123, 161, 500, 514, 1900),
}
BASELINE_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")
BASELINE_DNS_SERVERS = (
    "8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "9.9.9.9", "208.67.222.222", "208.67.220.220",
)
BASELINE_DOMAINS = (
    "windows.com", "microsoft.com", "office.com", "google.com", "googleapis.com", "gstatic.com",
    "cloudflare.com", "akamai.net", "digicert.com", "verisign.com",
)
LIMIT_CONNECTIONS_PER_MINUTE = 10
LIMIT_FAILED_LOGINS = 5
LIMIT_TRANSFER_MB = 100
LIMIT_SCANNED_PORTS = 20
LIMIT_DNS_PER_MINUTE = 50

# The network rule set.
WHITELISTED_IPS = ("8.8.8.8", "8.8.4.4")
WHITELISTED_PROCESSES = ("chrome.exe", "firefox.exe", "svchost.exe", "explorer.exe")
ALLOWED_PORTS = (80, 443, 53, 22, 3389)
INTERNAL_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
SUSPICIOUS_PROCESS_PATTERNS = (
    r"suspicious[\w_-]*\.exe$", r"unknown[\w_-]*\.exe$", r"malware[\w_-]*\.exe$",
)
HIGH_RISK_PORTS = (4444, 1337, 31337, 666, 6666)
SEVERITY_MULTIPLIERS = {
    "repeated_events": 1.5, "multiple_indicators": 1.3, "unusual_port": 1.2,
    "suspicious_process": 1.4, "external_connection": 1.2,
}

# --------------------------------------------------------------------------
# Text handling and reports.
# --------------------------------------------------------------------------
MAX_LINE_LENGTH = 2048
EXAMPLE_CONTENT_LENGTH = 120
PAGE_SIZE, MAX_DISPLAYED = 50, 1000
MODE_PREFIXES = {
    "brief": "Provide a concise summary of the key findings. "
             "Focus only on the most critical security issues.",
    "detailed": "Provide a comprehensive analysis of all findings. "
                "Include both major and minor security concerns, with detailed explanations.",
    "technical": "Provide a technical analysis focusing on specific indicators, "
                 "timestamps, IP addresses, and technical details of potential threats.",
}
FALSE_POSITIVE_CONFIDENCE = 0.8
CORRELATED_THREAT_CONFIDENCE = 0.7
DEFAULT_CORRELATED_SEVERITY = 3
