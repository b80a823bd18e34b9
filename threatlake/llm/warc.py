"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake import session

c = F.col

#: Payloads of fewer bytes are always stored as responses.
LEAST_BYTES = 0
#: The pages carry no date of their own.
DATE = "1970-01-01T00:00:00Z"
_LINE = "\r\n"


class Archive(NamedTuple):
    """Folders of one archive: `headers`, a row per record, and `payloads`, a row per distinct payload."""

    headers: str
    payloads: str


def base32_sha1(data: Column) -> Column:
    """The SHA-1 digest in upper-case base 32: forty hexadecimal digits, five at a time."""
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexed = F.sha1(data)
    parts = (F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8))
    return F.translate(F.concat(*parts), digits, letters)


def _record_id(page: Column) -> Column:
    name = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(
        F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _lines(*parts: Column) -> Column:
    return F.concat_ws(_LINE, *parts)


def _named(name: str, value: Column) -> Column:
    """A header line; none if the value is null."""
    return F.concat(F.lit(f"{name}: "), value)


def _header(page: Column, url: Column, size: Column, digest: Column, first: Column) -> Column:
    """The exact bytes of a record before its payload; `first` is the response of a revisit, or null."""
    http = F.concat(_lines(
        F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
        _named("Content-Length", size.cast("string"))), F.lit(_LINE * 2))
    revisit = first.isNotNull()
    # White space and control characters would break a header line.
    target = F.regexp_replace(F.regexp_replace(url, "[\\r\\n]+", "%0A"), "[\\x00-\\x20]", "%20")
    body = F.octet_length(http) + F.when(revisit, 0).otherwise(size)
    warc = _lines(
        F.lit("WARC/1.1"), _named("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _named("WARC-Record-ID", _record_id(page)), _named("X-Page-ID", page.cast("string")),
        _named("WARC-Target-URI", target), _named("WARC-Date", F.lit(DATE)),
        _named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        _named("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _named("WARC-Refers-To", F.when(revisit, _record_id(first))),
        _named("X-Refers-To-Page", first.cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"), _named("Content-Length", body.cast("string")))
    return F.concat(warc, F.lit(_LINE * 2), http)


def _never_null(page: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), page.cast("string")), F.lit(""))


def write(pages: DataFrame, archive: Archive, key: str = "page_id", url: str = "url", html: str = "html",
          least_bytes: int = LEAST_BYTES) -> None:
    """Writes a record for every row.

    Of the records with equal payloads of at least `least_bytes` the one with the largest key is
    the response and the others are revisits; shorter payloads are all responses.  A null payload
    is an empty one; a null url leaves its header line out.  A null key comes before all others,
    so it is a response only among null keys.  Rows that repeat key and payload are all
    responses; their payload is stored once.  Other columns are not read.

    Payloads are addressed by SHA-256.  Only the digests are grouped; the payload bytes move once,
    by digest and key, which is one row per distinct payload and leaves no hot group.
    """
    payload = F.encode(F.coalesce(html, F.lit("")), "utf-8")
    rows = pages.select(c(key).alias("page"), c(url).alias("url"), payload.alias("payload"))
    facts = session.land(rows.select(
        "page", "url", F.octet_length("payload").cast("bigint").alias("size"), base32_sha1(c("payload")).alias("digest"),
        F.sha2("payload", 256).alias("address")), "records")
    firsts = session.land(facts.groupBy("address").agg(F.max("page").alias("first")), "firsts")
    joined = facts.join(firsts, "address")
    revisit = (c("size") >= least_bytes) & ~c("page").eqNullSafe(c("first"))
    header = _header(c("page"), c("url"), c("size"), c("digest"), F.when(revisit, c("first")))
    joined.select("page", "address", F.encode(header, "utf-8").alias("header"),
                  (~revisit).alias("response")).write.parquet(archive.headers)
    named = rows.select(F.sha2("payload", 256).alias("address"), _never_null(c("page")).alias("name"), "payload")
    stored = named.join(firsts.select("address", _never_null(c("first")).alias("name")), ["address", "name"])
    stored.dropDuplicates(["address", "name"]).select("address", "payload").write.parquet(archive.payloads)


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page, address, header, record): every record put together again, to the byte.

    A response is its header, its payload and two line ends; a revisit has no payload, so only
    responses are joined with the payloads, one for each payload that is not a short one.
    """
    headers, payloads = spark.read.parquet(archive.headers), spark.read.parquet(archive.payloads)
    ends = F.encode(F.lit(_LINE * 2), "utf-8")
    missing = F.raise_error(F.concat(F.lit("no payload "), c("address"))).cast("binary")
    full = headers.filter("response").join(payloads, "address", "left").select(
        "page", "address", "header", F.concat("header", F.coalesce("payload", missing), ends).alias("record"))
    bare = headers.filter("not response").select("page", "address", "header", F.concat("header", ends).alias("record"))
    return full.unionByName(bare)


def index(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page, payload_bytes, payload_digest, record_type, refers_to) read from the rebuilt records.

    Every record of `read` is taken apart: its two Content-Length fields must give its size, and a
    response's payload, cut out of the record, must have the digest of the header and the address.
    Size and digest of a revisit are those of the responses at its address.  A damaged record is
    an error.  Only these narrow facts are joined after that.
    """
    text, blank = F.decode("header", "utf-8"), _LINE * 2

    def field(name: str, lines: Column = text) -> Column:
        return F.nullif(F.regexp_extract(lines, f"(?:^|\\r\\n){name}: ([^\\r]*)", 1), F.lit(""))

    response = field("WARC-Type") == "response"
    http = F.substring_index(text, blank, -2)
    size = F.octet_length("record") - F.octet_length("header") - 4
    block = F.octet_length("record") - F.octet_length(F.substring_index(text, blank, 1)) - 8
    framed = (field("Content-Length").cast("int") == block) & (
        size == F.when(response, field("Content-Length", http).cast("int")).otherwise(0))
    payload = F.expr("substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - 4)")
    parts = session.land(read(spark, archive).select(
        field("X-Page-ID").cast("bigint").alias("page"), "address", field("WARC-Type").alias("record_type"),
        field("WARC-Payload-Digest").alias("named"), field("X-Refers-To-Page").cast("bigint").alias("refers_to"),
        framed.alias("framed"), F.when(response, size.cast("bigint")).alias("size"),
        F.when(response, base32_sha1(payload)).alias("digest"),
        F.when(response, F.sha2(payload, 256) == c("address")).alias("sound")), "parts")
    facts = parts.filter("record_type = 'response'").groupBy("address").agg(
        F.max("size").alias("payload_bytes"), F.max("digest").alias("payload_digest"), F.bool_and("sound").alias("sound"))
    joined = parts.drop("sound").join(facts, "address", "left")
    good = c("framed") & c("sound") & (c("named") == F.concat(F.lit("sha1:"), c("payload_digest")))
    checked = F.when(good, c("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record at "), c("address"))))
    return joined.select("page", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def new_archive(spark: SparkSession) -> Archive:
    """An archive in the shared folder."""
    return Archive(session.new_folder(spark, "warc-headers"), session.new_folder(spark, "warc-payloads"))
