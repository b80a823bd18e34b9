"""Log sources (S1-S9): text with exact line numbers, JSON documents, dispatch by format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatlake import catalog

# Declared log types, and the extensions that imply one.
LOG_TYPES = ("wireshark", "volatility_json", "volatility_text", "generic")
EXTENSION_TYPES = {"pcap": "wireshark", "pcapng": "wireshark", "json": "volatility_json"}

# What Unicode counts as white space at the ends of a line.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0        "
    "        　"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def drop_bad_bytes(text: Column) -> Column:
    """Bytes that are not UTF-8 are left out (S3)."""
    repaired = F.translate(F.make_valid_utf8(text), "�", "")
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def clean_lines(raw: DataFrame, max_length: int | None = None) -> DataFrame:
    """Drops empty lines, removes NULs, strips white space (S2); no line is cut.

    With `max_length` longer lines are dropped.  The limit counts the line feed, as
    the line is measured before stripping.
    """
    kept = raw if max_length is None else raw.filter(F.length("line") + 1 <= max_length)
    # A test of its own for lines that come to nothing: of the cleaned line it would clean each line twice.
    some = kept.filter(F.ltrim("line", F.lit(WHITE_SPACE + "\x00")) != "")
    return some.withColumn("line", strip(F.replace("line", F.lit("\x00"), F.lit(""))))


def strip_lines(raw: DataFrame) -> DataFrame:
    """Hygiene of the plain file scan: strip, drop blank lines; no length limit."""
    return raw.withColumn("line", strip(F.col("line"))).filter(F.col("line") != "")


def number_lines(scan: DataFrame, most_tasks: int | None = None) -> DataFrame:
    """Exact 1-based line numbers per file for a text scan, without shuffling the text.

    Within one split rows are consecutive, so the distance to the split's first
    row id plus the lines of the file's earlier splits is the line number.  The
    table of splits is broadcast at every size: four numbers for each split of the
    input, 50 MB for 100 TB in splits of 64 MB.  Files go by a hash of their path;
    a clash, or a split that only one of the two scans knows, is an error.

    With `most_tasks` small splits share a task; row ids are given before that, so they do not change.
    """
    rows = scan.select(
        scan["value"], F.col("_metadata.file_path").alias("source_file"),
        F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
    ).withColumn("_id", F.monotonically_increasing_id())
    if most_tasks is not None:
        rows = rows.coalesce(most_tasks)
    splits = rows.groupBy("_file", "_start").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"),
        F.min("source_file").alias("_low"), F.max("source_file").alias("_high"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    clash = F.col("_low") != F.col("_high")
    splits = splits.select(
        "_file", "_start", F.when(clash, F.raise_error("two paths of equal hash")).otherwise(F.col("_first")).alias("_first"),
        F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"))
    numbered = rows.join(F.broadcast(splits), ["_file", "_start"], "left")
    number = F.col("_id") - F.col("_first") + F.col("_before") + 1
    known = F.when(number.isNull(), F.raise_error("a file was split differently by two scans")).otherwise(number)
    return numbered.select("source_file", known.cast("bigint").alias("line_number"), F.col("value").alias("line"))


def _as_raw_logs(scan: DataFrame, log_type: str | None = None, most_tasks: int | None = None) -> DataFrame:
    lines = number_lines(scan, most_tasks)
    return lines.withColumn("line", drop_bad_bytes(F.col("line"))).withColumn("log_type", F.lit(log_type))


def read_text(spark: SparkSession, path: str | list[str], log_type: str = "generic", most_tasks: int | None = None) -> DataFrame:
    """raw_logs from text files: packet exports (S7), memory-forensics text (S6), generic.

    With `most_tasks` small splits share a task, one after the other.
    """
    return _as_raw_logs(spark.read.text(path), log_type, most_tasks)


def explode_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """JSON documents to rows: an object gives one, an array one per element, others none.

    Adds `item`, the JSON text of the element with its keys in their order, and
    `item_number`, its place in the document from 1 on.
    """
    doc = F.btrim(F.col(text), F.lit(" \t\n\r"))
    wrapped = F.when(doc.startswith("{"), F.concat(F.lit("["), doc, F.lit("]"))).when(
        doc.startswith("["), doc)
    items = F.from_json(wrapped, "array<string>")
    placed = documents.select("*", F.posexplode(items).alias("_place", "item")).filter("item is not null")
    return placed.withColumn("item_number", (F.col("_place") + 1).cast("bigint")).drop("_place")


def _documents(scan: DataFrame) -> DataFrame:
    docs = scan.select(F.col("_metadata.file_path").alias("source_file"),
                       drop_bad_bytes(F.col("value")).alias("text"))
    return explode_documents(docs).select(
        "source_file", F.col("item_number").alias("line_number"), F.col("item").alias("line"),
        F.lit("volatility_json").alias("log_type"))


def read_json_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """raw_logs from files that each hold one JSON document; an item's number stands for the line's.

    A single document cannot be split, so it bounds one row; many files spread.
    """
    return _documents(spark.read.text(path, wholetext=True))


def log_type_column(path: Column) -> Column:
    """Log type from the file extension."""
    name = F.substring_index(path, "/", -1)
    extension = F.lower(F.substring_index(name, ".", -1))
    out = F.lit("generic")
    for known, log_type in EXTENSION_TYPES.items():
        out = F.when(name.contains(".") & (extension == known), log_type).otherwise(out)
    return out


def _any_case(extension: str) -> str:
    """File-name glob for an extension in any case."""
    return "*." + "".join(f"[{ch}{ch.upper()}]" for ch in extension)


def read_logs(spark: SparkSession, path: str | list[str], log_type: str | None = None) -> DataFrame:
    """raw_logs of one declared type, or of each file's type by extension.

    Without a declared type there is a scan of lines and one of whole documents, limited to
    their files by name, so no list of files passes through the driver program and a tree
    of many folders is listed twice, however many types there are.
    """
    if log_type is not None:
        if log_type not in LOG_TYPES:
            raise ValueError(f"Unsupported log type: {log_type}")
        return read_json_documents(spark, path) if log_type == "volatility_json" else read_text(spark, path, log_type)
    lines = spark.read.text(path)
    lines = lines.filter(log_type_column(lines["_metadata"]["file_path"]) != "volatility_json")
    out = _as_raw_logs(lines).withColumn("log_type", log_type_column(F.col("source_file")))
    for extension in (extension for extension, kind in EXTENSION_TYPES.items() if kind == "volatility_json"):
        out = out.unionByName(_documents(spark.read.option("pathGlobFilter", _any_case(extension)).text(path, wholetext=True)))
    return out
