"""Column names and types of the tables that operators exchange."""

from __future__ import annotations

INDICATOR = "struct<type:string,category:string,description:string,severity:int>"
INDICATORS = f"array<{INDICATOR}>"
RISK_FACTOR = (
    "struct<name:string,category:string,description:string,score:double,context:map<string,string>>"
)
RISK_FACTORS = f"array<{RISK_FACTOR}>"

# raw_logs: one row per line of a log.
RAW_LOGS = "source_file string, line_number bigint, line string, log_type string"

NETWORK, PROCESS, GENERIC = "NETWORK", "PROCESS", "GENERIC"

# The unified event; fields that do not apply to a kind are NULL.
EVENT_FIELDS: tuple[tuple[str, str], ...] = (
    ("kind", "string"),
    ("event_time", "timestamp_ntz"),
    ("source_ip", "string"),
    ("dest_ip", "string"),
    ("source_port", "int"),
    ("dest_port", "int"),
    ("protocol", "string"),
    ("process_name", "string"),
    ("dns_query", "string"),
    ("bytes_transferred", "bigint"),
    ("connection_duration", "double"),
    ("pid", "int"),
    ("parent_pid", "int"),
    ("user", "string"),
    ("command_line", "string"),
    ("path", "string"),
    ("status", "string"),
    ("source", "string"),
)
EVENT_STRUCT = "struct<" + ",".join(f"{name}:{kind}" for name, kind in EVENT_FIELDS) + ">"
EVENT_COLUMNS = tuple(name for name, _ in EVENT_FIELDS)
