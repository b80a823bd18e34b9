"""JSON documents read by many tasks (S4): the array of one file is cut where its structure allows.

Text is read in pieces that end at a closing brace, which any split of a file can
begin with.  A first pass tells for each split how many quotes and brackets it
has; running sums over the splits give the state in which each begins.  The
second pass cuts elements inside the split, and only those that a split boundary
divides are put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from threatlake import session
from threatlake.functions import text
from threatlake.sources import logs

c = F.col

_SUMMARY = pa.schema([
    ("source_file", pa.string()), ("start", pa.int64()), ("file_bytes", pa.int64()), ("bytes", pa.int64()), ("parity", pa.int64()),
    ("first", pa.string()), ("depths", pa.list_(pa.int64())), ("commas", pa.list_(pa.map_(pa.int64(), pa.int64())))])
_FRAGMENTS = pa.schema([
    ("source_file", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("item", pa.int64()), ("whole", pa.bool_()),
    ("text", pa.string())])
#: Splits whose states are broadcast; a table of more is an error that asks for larger splits.
MAX_SPLITS = 2_000_000


def structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of brackets and commas outside strings, change of depth at each, parity of the quotes).

    A quote after an odd number of backslashes does not count.  `inside` says whether the bytes
    begin inside a string.
    """
    places = np.arange(len(data))
    slash = data == ord("\\")
    before = places - 1 - np.concatenate([[-1], np.maximum.accumulate(np.where(slash, -1, places))])[: len(data)]
    quote = (data == ord('"')) & (before % 2 == 0)
    total = np.cumsum(quote)
    outside = (total + inside) % 2 == 0
    opens, closes = (data == ord("[")) | (data == ord("{")), (data == ord("]")) | (data == ord("}"))
    found = np.flatnonzero(outside & (opens | closes | (data == ord(","))))
    return found, opens[found].astype(np.int64) - closes[found], int(total[-1]) % 2 if len(data) else 0


def _stretches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, bytes, bool]]:
    """(columns of a split, its next bytes, whether they are its last) in the order of the text.

    Every piece gets back the brace that ended it.
    """
    waiting: tuple[tuple, bytes] | None = None
    for batch in batches:
        if not len(batch):
            continue
        keys = list(zip(*[batch.column(n).to_pylist() for n in names], strict=True))
        pieces = batch.column("value").to_pylist()
        begin = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[begin]:
                if waiting is not None:
                    yield *waiting, waiting[0] != keys[begin]
                waiting = keys[begin], b"".join(p + b"}" for p in pieces[begin:i])
                begin = i
    if waiting is not None:
        yield *waiting, True


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split changes, if it begins outside (0) and if it begins inside (1) of a string."""
    first, size, parity, depths, commas = None, 0, 0, [0, 0], ({}, {})
    for key, body, last in _stretches(batches, ["source_file", "start", "file_bytes"]):
        if first is None:
            first = body.lstrip(b" \t\r\n")[:1].decode("latin-1") or None
        data = np.frombuffer(body, np.uint8)
        size += len(data)
        for h in (0, 1):
            _, change, quotes = structure(data, (h + parity) % 2 == 1)
            depth = depths[h] + np.cumsum(change)
            for d, n in zip(*np.unique(depth[change == 0], return_counts=True), strict=True):
                commas[h][int(d)] = commas[h].get(int(d), 0) + int(n)
            depths[h] = int(depth[-1]) if len(depth) else depths[h]
        parity = (parity + quotes) % 2
        if last:
            yield _batch([(*key, size, parity, first, depths, [list(m.items()) for m in commas])], _SUMMARY)
            first, size, parity, depths, commas = None, 0, 0, [0, 0], ({}, {})


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of the array, whole or in parts.  Item 0 is what is outside of it, with its bracket."""
    now, offset, inside, depth0, commas, opened = None, 0, 0, 0, 0, False
    names = ["source_file", "start", "inside", "depth", "commas_before", "is_array", "unended"]
    for key, body, last in _stretches(batches, names):
        if key[:2] != now:
            now, offset, opened = key[:2], 0, False
            inside, depth0, commas = key[2:5]
        if last and key[6]:
            body = body[:-1]
        rows: list[tuple] = []

        def emit(begin: int, end: int, item: int, whole: bool, body=body, rows=rows, offset=offset) -> None:
            if whole or end > begin:
                rows.append((*now, offset + begin, item, whole, body[begin:end].decode("utf-8", "ignore")))

        places, change, quotes = structure(np.frombuffer(body, np.uint8), inside == 1)
        depth = depth0 + np.cumsum(change)
        begin, item = 0, commas + 1 if depth0 > 0 or not key[5] else 0
        if key[5]:
            cuts = ((depth == 1) & (change >= 0)) | ((depth == 0) & (change < 0))
            for place, kind in zip(places[cuts].tolist(), change[cuts].tolist(), strict=True):
                emit(begin, place, item, opened and item > 0)
                commas += kind == 0
                if kind > 0 or (kind < 0 and body[place: place + 1] != b"]"):
                    emit(place, place + 1, 0, False)
                begin, item, opened = place + 1, 0 if kind < 0 else commas + 1, kind >= 0
        emit(begin, len(body), item, False)
        if begin < len(body):
            opened = False
        offset, inside = offset + len(body), (inside + quotes) % 2
        depth0 = int(depth[-1]) if len(depth) else depth0
        for i in range(0, len(rows), 4096):
            yield _batch(rows[i: i + 4096], _FRAGMENTS)


def _pieces(spark: SparkSession, path: str | list[str], most_tasks: int | None) -> DataFrame:
    scan = spark.read.option("lineSep", "}").text(path)
    pieces = scan.select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("file_bytes"), F.col("value").cast("binary").alias("value"))
    return pieces if most_tasks is None else pieces.coalesce(most_tasks)


def _states(splits: DataFrame) -> DataFrame:
    """The state in which each split begins, and what is known of its whole file."""
    file = Window.partitionBy("source_file")
    order = file.orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def running(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(before), F.lit(0))

    known = splits.withColumn("inside", running(c("parity")) % 2)
    known = known.withColumn("change", c("depths")[c("inside").cast("int")]).withColumn("depth", running(c("change")))
    own = F.coalesce(F.try_element_at(c("commas")[c("inside").cast("int")], 1 - c("depth")), F.lit(0))
    whole = file.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    unended = F.sum("bytes").over(whole) > c("file_bytes")
    return known.withColumn("commas_before", running(own)).withColumns({
        "kind": F.first("first", ignorenulls=True).over(whole),
        "unended": unended & (c("start") == F.max("start").over(whole)),
        "closed": F.sum("change").over(whole) + unended.cast("int") == 0}).select(
        "source_file", "start", "inside", "depth", "commas_before", "kind", "unended", "closed")


def _parsed(value: Column) -> Column:
    return F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")


def read_json_arrays(spark: SparkSession, path: str | list[str], max_splits: int = MAX_SPLITS, most_tasks: int | None = None) -> DataFrame:
    """raw_logs from files that each hold one JSON document, a document spread over the tasks of its splits.

    Gives the rows of `logs.read_json_documents`: an array has a row for each element that is not
    null, numbered by its place, an object one row, other values none.  A document that does not
    parse gives no row, nor does one with text after its end.  One element is one row, so an
    object as a document is too.  Files must not be compressed, since their sizes are compared.
    With `most_tasks` small splits share a task, one after the other.
    """
    pieces = _pieces(spark, path, most_tasks)
    summaries = session.land(pieces.mapInArrow(_summaries, from_arrow_schema(_SUMMARY)), "json-splits")
    n = summaries.count()
    if n > max_splits:
        raise ValueError(f"{n} splits; raise spark.sql.files.maxPartitionBytes")
    states = session.land(_states(summaries), "json-states")
    documents = states.filter(c("kind").isin("[", "{") & c("closed"))
    is_array = (c("kind") == "[").alias("is_array")
    placed = pieces.join(F.broadcast(documents.select(
        "source_file", "start", "inside", "depth", "commas_before", is_array, "unended")), ["source_file", "start"])
    cut = text.computed_once(placed.mapInArrow(_fragments, from_arrow_schema(_FRAGMENTS)), "items", F.when(
        c("whole"), _parsed(c("text"))))
    # `size` is null where a whole element does not parse, and -1 for parts.
    size = F.when(c("whole"), F.array_size("items")).otherwise(-1)
    landed = session.land(cut.select(
        "source_file", "start", "place", "item", "whole", size.alias("size"), F.get("items", F.lit(0)).alias("line"),
        F.when(~c("whole"), c("text")).alias("text")), "json-items")
    parts = landed.filter("not whole").groupBy("source_file", "item").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("start", "place", "text")))["text"], "").alias("text"))
    outside = parts.filter("item = 0").select("source_file", F.btrim("text", F.lit(" \t\n\r")).alias("outside"))
    joined = text.computed_once(parts.filter("item > 0"), "items", _parsed(c("text"))).select(
        "source_file", "item", F.array_size("items").alias("size"), F.get("items", F.lit(0)).alias("line"))
    rows = landed.filter("whole").select("source_file", "item", "size", "line").unionByName(joined)
    # Elements without text are allowed only as the sole one, in an empty array.
    bad = rows.groupBy("source_file").agg(
        F.bool_or(c("size").isNull() | (c("size") > 1)).alias("broken"), F.min("size").alias("least"), F.max("item").alias("most")).filter(
        "broken or (least = 0 and most > 1)").select("source_file")
    bad = bad.unionByName(outside.filter("outside <> '['").select("source_file"))
    kept = rows.filter("line is not null").join(bad, "source_file", "left_anti")
    return kept.select("source_file", c("item").alias("line_number"), "line", F.lit("volatility_json").alias("log_type"))
