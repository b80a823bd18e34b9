"""Event extraction: a log line to a nullable event struct.

Each parser reads its fields with one regex pass: the line is rewritten to the
captured groups joined by NUL (which a cleaned line never holds) and split.  A
literal test in front keeps the regex off lines that cannot match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatlake import schemas
from threatlake.functions import net, text, times

_LABEL_AHEAD = r"(?=\s+[A-Za-z][A-Za-z ]*:(?:\s|$))"
_STAMP = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})"
_QUAD = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"

# The line formats.  Values run up to the next "Label:", so paths
# may hold spaces.
PROCESS_CREATED = (
    r"(?isd)^.*?" + _STAMP + r".*?EventID=4688.*?New Process Name:\s*(.+?)" + _LABEL_AHEAD
    + r".*?Creator Process Name:\s*(.+?)" + _LABEL_AHEAD + r".*?Process Command Line:\s*(.*)$"
)
CONNECTION_ALLOWED = (
    r"(?isd)^.*?" + _STAMP + r".*?EventID=5156.*?Application Name:\s*(.+?)" + _LABEL_AHEAD
    + r".*?Source Address:\s*(\S+)\s+Source Port:\s*(\d+)\s+Dest Address:\s*(\S+)\s+"
    r"Dest Port:\s*(\d+)\s+Protocol:\s*(\d+).*$"
)
SSH_LOGIN = (
    r"(?sd)^.*?(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}).*?sshd\[\d+\]:\s+(Accepted|Failed)\s+"
    r"(?:password|publickey)\s+for\s+(\S+)\s+from\s+(" + _QUAD + r")\s+port\s+(\d+).*$"
)
PACKET = (
    r"(?sd)^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)\s+(" + _QUAD + r"):(\d+)\s+->\s+("
    + _QUAD + r"):(\d+)(.*)$"
)
_NUL = "\x00"


# Groups of each format.
_GROUPS = {"created": 4, "allowed": 7, "ssh": 5, "packet": 6}


def _captures(line: Column, pattern: str, name: str) -> Column:
    joined = F.regexp_replace(line, pattern, _NUL.join(f"${i + 1}" for i in range(_GROUPS[name])))
    return F.split(joined, _NUL)


def complete(parts: Column, name: str) -> Column:
    """Captures of a format, NULL where the regex did not match.

    `parts` is a column computed before: as an expression, the regex would run for each use.
    """
    return F.when(F.size(parts) == _GROUPS[name], parts)


def _event(**fields: Column) -> Column:
    known = dict(schemas.EVENT_FIELDS)
    assert set(fields) <= set(known), set(fields) - set(known)
    return F.struct(*[
        (fields[name] if name in fields else F.lit(None)).cast(kind).alias(name)
        for name, kind in schemas.EVENT_FIELDS
    ])


def captures(line: Column) -> dict[str, Column]:
    """Raw captures of the three text formats, for `complete`, and the JSON value; NULL where the line is of another format."""
    lowered = F.lower(line)
    return {
        "created": F.when(lowered.contains("eventid=4688"), _captures(line, PROCESS_CREATED, "created")),
        "allowed": F.when(lowered.contains("eventid=5156"), _captures(line, CONNECTION_ALLOWED, "allowed")),
        "ssh": F.when(line.contains("sshd["), _captures(line, SSH_LOGIN, "ssh")),
        "json": F.when(line.startswith("{"), F.try_parse_json(line)),
    }


def process_created(c: Column) -> Column:
    """Windows process creation."""
    path = F.trim(c[1])
    return F.when(c.isNotNull(), _event(
        kind=F.lit(schemas.PROCESS), event_time=times.parse_timestamp(c[0]),
        process_name=text.basename(path), pid=F.lit(0), user=F.lit("Unknown"),
        command_line=F.trim(c[3]), path=path, status=F.lit("Created")))


def connection_allowed(c: Column) -> Column:
    """Windows filtering platform connection."""
    ports_ok = c[3].try_cast("int").isNotNull() & c[5].try_cast("int").isNotNull()
    return F.when(ports_ok, _event(
        kind=F.lit(schemas.NETWORK), event_time=times.parse_timestamp(c[0]),
        source_ip=c[2], dest_ip=c[4], source_port=c[3].try_cast("int"),
        dest_port=c[5].try_cast("int"), protocol=net.protocol_name(c[6]),
        process_name=text.basename(F.trim(c[1])), bytes_transferred=F.lit(0),
        connection_duration=F.lit(0.0), status=F.lit("Allowed")))


def ssh_login(c: Column, default_year: int | None) -> Column:
    """Accepted or failed ssh login as a connection to this host's port 22."""
    return F.when(c[4].try_cast("int").isNotNull(), _event(
        kind=F.lit(schemas.NETWORK), event_time=times.parse_timestamp(c[0], default_year),
        source_ip=c[3], dest_ip=F.lit("self"), source_port=c[4].try_cast("int"),
        dest_port=F.lit(22), protocol=F.lit("TCP"), process_name=F.lit("sshd"),
        bytes_transferred=F.lit(0), connection_duration=F.lit(0.0),
        status=text.capitalize(c[1])))


# The fields of JSON records that are read.
_JSON_FIELDS = (
    "timestamp", "@timestamp", "time", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "process_name", "app_name",
    "bytes", "bytes_sent", "bytes_received", "status", "action", "pid", "process_id", "parent_pid", "parent_process_id",
    "user", "username", "command_line", "cmdline", "path", "exe",
)


def json_texts(v: Column) -> Column:
    """The known fields of a JSON record as text, read in one pass; a JSON null is NULL.

    As a column of its own it spares each use of a field a search in the record.
    """
    return F.try_variant_get(v, "$", "struct<" + ",".join(f"`{name}`:string" for name in _JSON_FIELDS) + ">")


class _Record:
    """The fields of a JSON record by their text; the value itself is asked only where text does not say enough."""

    def __init__(self, v: Column, texts: Column):
        self.v, self.texts = v, texts

    def text(self, *names: str) -> Column:
        """First present field; a JSON null counts as absent."""
        return F.coalesce(*[self.texts[name] for name in names])

    def number(self, *names: str, kind: str) -> Column:
        """First field that reads as `kind`.  Numbers that text does not give, such as 80.5 as int, come from the value."""
        def one(name: str) -> Column:
            given = self.texts[name]
            return F.coalesce(given.try_cast(kind), F.when(given.isNotNull(), F.try_variant_get(self.v, f"$['{name}']", kind)))
        return F.coalesce(*[one(name) for name in names])

    def is_number(self, *names: str) -> Column:
        value = F.coalesce(*[F.try_variant_get(self.v, f"$['{name}']", "variant") for name in names])
        # No number holds a colon, but every stamp does.
        return ~F.coalesce(self.text(*names), F.lit(":")).contains(":") & F.coalesce(
            F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.lit(False))

    def bad(self, *names: str) -> Column:
        """A field is present but does not read as a whole number."""
        return self.text(*names).isNotNull() & self.number(*names, kind="int").isNull()

    def time(self, default_year: int | None) -> Column:
        names = ("timestamp", "@timestamp", "time")
        return F.when(self.is_number(*names), times.parse_epoch(self.number(*names, kind="double"))).otherwise(
            times.parse_timestamp(self.text(*names), default_year))

    def is_network(self) -> Column:
        present = self.text("src_ip").isNotNull() & self.text("dst_ip").isNotNull()
        return present & self.text("dst_port").isNotNull() & self.text("protocol").isNotNull()


def json_network(v: Column, default_year: int | None, texts: Column) -> Column:
    """JSON connection record (P4); a bad number makes it no connection at all.  `texts`: `json_texts(v)` as a column."""
    r, sent, zero = _Record(v, texts), ("bytes", "bytes_sent"), F.lit(0)
    total = F.coalesce(r.number(*sent, kind="double"), F.lit(0.0)) + F.coalesce(
        r.number("bytes_received", kind="double"), F.lit(0.0))
    bad = r.bad("dst_port") | r.bad("src_port")
    for names in (sent, ("bytes_received",)):
        bad = bad | (r.text(*names).isNotNull() & ~r.is_number(*names))
    return F.when(r.is_network() & ~bad, _event(
        kind=F.lit(schemas.NETWORK), event_time=r.time(default_year),
        source_ip=r.text("src_ip"), dest_ip=r.text("dst_ip"),
        source_port=F.coalesce(r.number("src_port", kind="int"), zero),
        dest_port=r.number("dst_port", kind="int"), protocol=F.upper(r.text("protocol")),
        process_name=F.coalesce(r.text("process_name", "app_name"), F.lit("")),
        bytes_transferred=total.try_cast("bigint"), connection_duration=F.lit(0.0),
        status=F.coalesce(r.text("status", "action"), F.lit(""))))


def json_process(v: Column, default_year: int | None, texts: Column) -> Column:
    """JSON process record (P5).  `texts`: `json_texts(v)` as a column."""
    r, zero = _Record(v, texts), F.lit(0)
    named = r.text("process_name").isNotNull() & r.text("pid").isNotNull()
    wanted = (named | r.text("command_line").isNotNull()) & ~r.is_network()
    parents = ("parent_pid", "parent_process_id")
    given = (F.coalesce(r.number("parent_pid", kind="int"), zero) != 0) | (
        F.coalesce(r.number("parent_process_id", kind="int"), zero) != 0)
    bad = r.bad("pid", "process_id") | r.bad(*parents)
    return F.when(wanted & ~bad, _event(
        kind=F.lit(schemas.PROCESS), event_time=r.time(default_year),
        process_name=F.coalesce(r.text("process_name"), F.lit("")),
        pid=F.coalesce(r.number("pid", "process_id", kind="int"), zero),
        parent_pid=F.when(given, r.number(*parents, kind="int")),
        user=F.coalesce(r.text("user", "username"), F.lit("")),
        command_line=F.coalesce(r.text("command_line", "cmdline"), F.lit("")),
        path=F.coalesce(r.text("path", "exe"), F.lit("")),
        status=F.coalesce(r.text("status", "action"), F.lit(""))))


def generic(line: Column) -> Column:
    """Fallback: the first word is the source."""
    source = F.when(line.contains(" "), F.substring_index(line, " ", 1)).otherwise("unknown")
    return _event(kind=F.lit(schemas.GENERIC), source=source)


def packet_captures(line: Column) -> Column:
    """Raw captures of a packet-export line, for `complete`."""
    return F.when(line.contains(" -> "), _captures(line, PACKET, "packet"))


def packet(c: Column) -> Column:
    """Captures of a packet-export line to connection fields plus flags, sequence and payload."""
    rest = c[5]

    def number(pattern: str) -> Column:
        return F.regexp_extract(rest, pattern, 1).try_cast("bigint")

    flags = F.when(rest.contains("flags: none"), F.lit("none")).otherwise(
        F.nullif(F.regexp_extract(rest, r"\[([A-Z,]+)\]", 1), F.lit("")))
    protocol = (F.when(rest.contains("[UDP]"), "UDP").when(rest.contains(" ICMP "), "ICMP")
                .otherwise("TCP"))
    payload = F.nullif(F.regexp_extract(rest, r"Payload: (.*?)(?: Len=\d+)?$", 1), F.lit(""))
    return F.when(c.isNotNull(), F.struct(
        times.parse_timestamp(c[0]).alias("event_time"), c[1].alias("source_ip"),
        c[2].try_cast("int").alias("source_port"), c[3].alias("dest_ip"),
        c[4].try_cast("int").alias("dest_port"), protocol.alias("protocol"), flags.alias("flags"),
        number(r"Seq=(\d+)").alias("seq"), number(r"Win=(\d+)").alias("win"),
        number(r"Len=(\d+)").alias("length"), number(r"ttl:(\d+)").alias("ttl"),
        number(r"fragment offset=(\d+)").alias("fragment_offset"), payload.alias("payload")))
