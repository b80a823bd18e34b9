"""Repeated search over landed tables (Q1-Q3, Q6): files that cannot hold the term are not read.

A table is landed with an index beside it.  Every file has a filter of the byte grams in its
folded text, cut into buckets and sorted by bucket, so a search reads the few buckets of its own
grams for all files, and then the files that hold all of them.  The search itself runs unchanged
on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.functions.text import is_plain_ascii
from threatlake.operators.rule_tables import FOLDED, mandatory_literals
from threatlake.operators.search import Criteria

c = F.col

#: Lengths of the grams in bytes; the longer tell files apart whose short grams are all in use.
GRAMS = (3, 6)
#: Bits of a file's filter, as a power of two: 1 MB, of which only buckets with a bit are kept.
FILTER_BITS = 23
#: Bits and bytes of a bucket: those of the engine's bitmaps.
BUCKET_BITS, BUCKET_BYTES = 15, 4096
#: Rows of a landed file at most.
ROWS_PER_FILE = 1_000_000
#: Files that are named one by one; a term in more of them is not rare, and the whole table is read.
MOST_FILES = 10_000
#: Bytes whose grams are computed at once.
_WINDOW = 1 << 20

_STEP = 0x9E3779B97F4A7C15


def folded(text: Column) -> Column:
    """The text whose grams are kept.

    ASCII letters in lower case, with the letters that match them when case is ignored; on other
    than ASCII lines the plain lower case too.
    """
    folded_text = F.lower(F.translate(text, *FOLDED))
    return F.when(is_plain_ascii(text), folded_text).otherwise(F.concat_ws("\n", folded_text, F.lower(text)))


def gram_places(data: np.ndarray, size: int) -> np.ndarray:
    """The bit of every gram of `size` bytes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    codes = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        codes = (codes << np.uint64(8)) | data[i: i + n]
    codes *= np.uint64(_STEP)
    codes ^= codes >> np.uint64(29)
    codes *= np.uint64(_STEP)
    return (codes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _buckets(name: str, bits: np.ndarray) -> pa.RecordBatch:
    rows = np.packbits(bits, bitorder="little").reshape(-1, BUCKET_BYTES)
    used = np.flatnonzero(rows.any(axis=1))
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()),
         pa.array([rows[i].tobytes() for i in used], pa.binary())], names=["file", "bucket", "bits"])


def _file_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters of the stretches of files in a task, one filter in memory at a time."""
    at, bits = None, np.zeros(1 << FILTER_BITS, dtype=bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        names, texts = batch.column(0), batch.column(1)
        runs = names.to_pandas()
        starts = np.flatnonzero((runs != runs.shift()).to_numpy()).tolist()
        for first, end in zip(starts, [*starts[1:], batch.num_rows]):
            name = names[first].as_py()
            if name != at:
                if at is not None:
                    yield _buckets(at, bits)
                at, bits = name, np.zeros(1 << FILTER_BITS, dtype=bool)
            # Grams across two rows are kept too; they can only add a file, never lose one.
            data = np.frombuffer(b"\n".join(x for x in texts.slice(first, end - first).to_pylist() if x), dtype=np.uint8)
            for begin in range(0, len(data), _WINDOW):
                window = data[begin: begin + _WINDOW + max(GRAMS) - 1]
                for size in GRAMS:
                    bits[gram_places(window, size)] = True
    if at is not None:
        yield _buckets(at, bits)


def land_indexed(table: DataFrame, folder: str, text: Column | str = "line", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes `table` to `folder`/rows and the filters of its files to `folder`/grams.

    `text` is what will be searched.  Null and empty texts add nothing, repeated rows nothing new;
    an empty table has an empty index.  The folder must be new.  Only filters are shuffled, at most
    1 MB for a file and task.
    """
    spark = table.sparkSession
    table.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{folder}/rows")
    rows = spark.read.schema(table.schema).parquet(f"{folder}/rows")
    name = rows.metadataColumn("_metadata")["file_name"]
    searched = folded(c(text) if isinstance(text, str) else text).cast("binary")
    filters = rows.select(name.alias("file"), searched.alias("text")).mapInArrow(
        _file_filters, "file string, bucket int, bits binary")
    whole = filters.groupBy("bucket", "file").agg(F.bitmap_or_agg("bits").alias("bits"))
    whole.repartitionByRange("bucket", "file").sortWithinPartitions("bucket", "file").write.parquet(f"{folder}/grams")


def required_literals(criteria: Criteria) -> list[str]:
    """Folded strings of which the folded text of every match holds at least one; none if none are known."""
    if criteria.use_regex:
        return mandatory_literals(criteria.pattern, min(GRAMS))
    # A text in the given case is only known to hold the ASCII part of its folded form.
    lowered = "".join(x.lower() if x.isascii() else "\0" for x in criteria.pattern) if criteria.case_sensitive else (
        criteria.pattern.lower())
    longest = max(lowered.split("\0"), key=len) if criteria.case_sensitive else lowered
    return [longest] if len(longest.encode()) >= min(GRAMS) else []


def _wanted(literals: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(literal, its number of bits, bucket, byte, bit) of all grams of the literals."""
    out = []
    for number, literal in enumerate(literals):
        data = np.frombuffer(literal.encode(), dtype=np.uint8)
        places = np.unique(np.concatenate([gram_places(data, size) for size in GRAMS])).tolist()
        out += [(number, len(places), p >> BUCKET_BITS, (p >> 3) % BUCKET_BYTES, p & 7) for p in places]
    return out


def candidate_files(spark: SparkSession, folder: str, criteria: Criteria | str) -> DataFrame | None:
    """(file) of all files that can hold a match; None if the index cannot tell."""
    literals = required_literals(Criteria(criteria) if isinstance(criteria, str) else criteria)
    if not literals:
        return None
    wanted = _wanted(literals)
    # As long as the pattern is; the buckets are a pushed filter of the scan.
    asked = spark.createDataFrame(wanted, "literal int, places int, bucket int, byte int, bit int")
    grams = spark.read.schema("bucket int, file string, bits binary").parquet(f"{folder}/grams")
    read = grams.filter(c("bucket").isin(sorted({row[2] for row in wanted}))).join(F.broadcast(asked), "bucket")
    byte = F.conv(F.hex(F.substring(c("bits"), c("byte") + 1, F.lit(1))), 16, 10).cast("int")
    hits = read.filter(F.bit_get(byte, c("bit")) == 1)
    full = hits.groupBy("file", "literal").agg(F.count(F.lit(1)).alias("n"), F.first("places").alias("places"))
    return full.filter("n = places").select("file").distinct()


def candidates(spark: SparkSession, folder: str, criteria: Criteria | str, most_files: int = MOST_FILES) -> DataFrame:
    """The rows of the landed files that can hold a match, for `search` or `search_findings`.

    All rows if the pattern requires no literal of three bytes or if more than `most_files` files
    can hold it: a longer list would be as dear for the client as the files for the tasks.
    """
    rows = spark.read.parquet(f"{folder}/rows")
    files = candidate_files(spark, folder, criteria)
    if files is None:
        return rows
    names = [row["file"] for row in files.limit(most_files + 1).collect()]
    if len(names) > most_files:
        return rows
    if not names:
        return rows.filter(F.lit(False))
    return spark.read.schema(rows.schema).parquet(*[f"{folder}/rows/{name}" for name in sorted(names)])
