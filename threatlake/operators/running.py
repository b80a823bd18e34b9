"""Ordered computations over keyed rows: running counts, trailing windows, context.

None of them puts all rows of a key into one task.  A key's rows are cut into
blocks of its order; work runs inside (key, block), and only one total per block
crosses between blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlake import catalog, schemas, session
from threatlake.functions import times

# Lines per block of a file, and seconds per block of a key's time line: ten seconds hold at most ten
# million distinct stamps, however busy the key.
LINE_BLOCK = 250_000
TIME_BLOCK = 10
# A wider gap in a file's line numbers begins a new stretch of lines; it matters for the cost only.
STRETCH_GAP = 1_000

# Functions for the workers travel with their code: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def running_sum(rows: DataFrame, keys: list[str], order: str, block: Column,
                values: list[str], unmerged: DataFrame | None = None) -> DataFrame:
    """Replaces each of `values` by its running sum within `keys` in `order`, self included.

    `order` is unique within `keys`; `block` does not decrease along it.  Block
    totals are summed on the map side, from `unmerged` if given: the same rows
    before a costly step that keeps their sums.
    """
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    source = rows if unmerged is None else unmerged
    totals = source.groupBy(*keys, block.alias("_block")).agg(*[F.sum(v).alias(f"_total_{v}") for v in values])
    totals = totals.select(*keys, "_block", *[
        F.coalesce(F.sum(f"_total_{v}").over(earlier), F.lit(0)).alias(f"_carry_{v}") for v in values])
    local = rows.withColumn("_block", block).withColumns({v: F.sum(v).over(inside) for v in values})
    joined = local.join(totals, [*keys, "_block"])
    joined = joined.withColumns({v: F.col(v) + F.col(f"_carry_{v}") for v in values})
    return joined.drop("_block", *[f"_carry_{v}" for v in values])


def ordinal(rows: DataFrame, out: str = "ordinal", block_lines: int = LINE_BLOCK) -> DataFrame:
    """1-based position within the file, by line number."""
    block = F.floor(F.col("line_number") / block_lines)
    return running_sum(keyed_rows(rows).withColumn(out, F.lit(1).cast("bigint")), ["source_file"], "line_number",
                       block, [out])


def keyed_rows(rows: DataFrame) -> DataFrame:
    """The rows; one without a file or line number is an error, as it would be lost in every join."""
    checked = {name: F.coalesce(name, F.raise_error(f"a row has no {name}").cast(rows.schema[name].dataType))
               for name in ("source_file", "line_number")}
    return rows.withColumns(checked)


# -- keys -------------------------------------------------------------------

def frequency_key(kind: Column, source_ip: Column, dest_ip: Column, process_name: Column) -> Column:
    return F.when(kind == schemas.NETWORK, F.concat(F.lit("net:"), source_ip, F.lit("->"), dest_ip)).when(
        kind == schemas.PROCESS, F.concat(F.lit("proc:"), process_name))


def frequency_source(kind: Column, protocol: Column, dest_port: Column, user: Column) -> Column:
    service = F.concat(protocol, F.lit(":"), F.coalesce(dest_port, F.lit(0)).cast("string"))
    return F.when(kind == schemas.NETWORK, service).when(
        kind == schemas.PROCESS, F.when(user != "", user).otherwise("UnknownUser"))


def with_frequency_key(events: DataFrame) -> DataFrame:
    """Adds `freq_key` and `freq_source`; keeps network and process events only."""
    c = F.col
    return events.filter(c("kind").isin(schemas.NETWORK, schemas.PROCESS)).withColumns({
        "freq_key": frequency_key(c("kind"), c("source_ip"), c("dest_ip"), c("process_name")),
        "freq_source": frequency_source(c("kind"), c("protocol"), c("dest_port"), c("user")),
    })


def running_frequency(events: DataFrame, block_lines: int = LINE_BLOCK) -> DataFrame:
    """(source_file, line_number, frequency): the key's count so far in the file."""
    keyed = with_frequency_key(events).select(
        "source_file", "line_number", "freq_key", "freq_source",
        F.lit(1).cast("bigint").alias("frequency"))
    block = F.floor(F.col("line_number") / block_lines)
    counted = running_sum(keyed, ["source_file", "freq_key", "freq_source"], "line_number", block,
                          ["frequency"])
    return counted.select("source_file", "line_number", "frequency")


# -- trailing time windows ----------------------------------------------------

def trailing_count(points: DataFrame, keys: list[str], counts: list[str], seconds: int,
                   block_seconds: int = TIME_BLOCK) -> DataFrame:
    """Counts of `[t - seconds, t]` for each distinct (keys, event_time) of `points`.

    `points` carries number columns `counts`.  Each value enters at its time and
    leaves just after its window ends, so one running sum gives every window; its
    cost does not grow with the window's content.  Rows of equal key and time are
    summed first, on the map side.
    """
    t = F.col("event_time")
    after = t + F.expr(f"interval {seconds} seconds 1 microsecond")
    enter = F.struct(t.alias("event_time"), *[F.col(c).alias(c) for c in counts], F.lit(1).alias("_asked"))
    leave = F.struct(after.alias("event_time"), *[(-F.col(c)).alias(c) for c in counts], F.lit(0).alias("_asked"))
    single = points.select(*keys, F.inline(F.array(enter, leave)))
    moves = single.groupBy(*keys, "event_time").agg(
        *[F.sum(c).alias(c) for c in counts], F.max("_asked").alias("_asked"))
    block = F.floor(times.seconds_of(F.col("event_time")) / block_seconds)
    summed = running_sum(moves, keys, "event_time", block, counts, unmerged=single)
    return summed.filter("_asked = 1").drop("_asked")


def correlation_points(events: DataFrame, *extra: str) -> DataFrame:
    """Each event under the keys it is correlated by.

    A network event stands under its address pair and its process name, a process
    event under its process name.  `n_net` / `n_proc` tell the kinds apart;
    `asks` says which of the two the event wants counted for itself.
    """
    c = F.col
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def point(key: Column, net: Column, proc: Column, want_net: Column, want_proc: Column) -> Column:
        return F.struct(key.alias("key"), net.alias("n_net"), proc.alias("n_proc"),
                        want_net.alias("want_net"), want_proc.alias("want_proc"))

    pair = point(F.concat(F.lit("pair:"), c("source_ip"), F.lit(":"), c("dest_ip")), one, zero, one, zero)
    named = point(F.concat(F.lit("name:"), c("process_name")), one, zero, zero, one)
    process = point(F.concat(F.lit("name:"), c("process_name")), zero, one, one, one)
    has_name = F.coalesce(c("process_name") != "", F.lit(False))
    # An event without a name is correlated by no name: a process event then by nothing.
    points = F.when((c("kind") == schemas.PROCESS) & has_name, F.array(process)).when(
        (c("kind") == schemas.NETWORK) & has_name, F.array(pair, named)).when(
        c("kind") == schemas.NETWORK, F.array(pair))
    known = events.filter(c("kind").isin(schemas.NETWORK, schemas.PROCESS) & c("event_time").isNotNull())
    return known.select("source_file", "line_number", "event_time", *extra, F.inline(points))


def correlation_count(events: DataFrame, seconds: int = catalog.CORRELATION_SECONDS,
                      block_seconds: int = TIME_BLOCK) -> DataFrame:
    """(source_file, line_number, correlated): events correlated with each event.

    A hot (key, time) only grows the event side of the join; adaptive skew join
    splits it, since the counted side has one row per (key, time).
    """
    points = correlation_points(events)
    counted = trailing_count(points, ["source_file", "key"], ["n_net", "n_proc"], seconds, block_seconds)
    counted = counted.withColumnsRenamed({"n_net": "w_net", "n_proc": "w_proc"})
    joined = points.join(counted, ["source_file", "key", "event_time"])
    hits = F.col("want_net") * F.col("w_net") + F.col("want_proc") * F.col("w_proc")
    return joined.groupBy("source_file", "line_number").agg(F.sum(hits).alias("correlated"))


def pair_count(events: DataFrame, seconds: int, out: str) -> DataFrame:
    """(source_file, line_number, out): connections of the same address pair in the
    trailing seconds, over all files (A10)."""
    points = events.filter((F.col("kind") == schemas.NETWORK) & F.col("event_time").isNotNull()).select(
        "source_file", "line_number", "event_time", "source_ip", "dest_ip",
        F.lit(1).cast("bigint").alias(out))
    keys = ["source_ip", "dest_ip"]
    counted = trailing_count(points, keys, [out], seconds)
    return points.drop(out).join(counted, [*keys, "event_time"]).select("source_file", "line_number", out)


def earliest_correlated(events: DataFrame, seconds: int = catalog.CORRELATION_SECONDS,
                        first: int = 5) -> DataFrame:
    """The first correlated events by time for each event (T3, U2): up to `first`
    rows (source_file, line_number, position, type, related_time, details).

    Per (key, time) at most `first` events can ever be shown, so only those are
    kept; they are ranked along the key's time line, and a window's first ones are
    found by rank with an equality join.
    """
    c = F.col
    detail_columns = ("source_ip", "dest_ip", "protocol", "bytes_transferred", "process_name", "pid", "user")
    wide = correlation_points(events, "kind", *detail_columns)
    keys = ["source_file", "key"]
    # Each key has a time line for either kind; an event asks for one or both of them.
    of_kind = wide.withColumn("key", F.concat("kind", F.lit("|"), "key"))
    wanted = F.concat(
        F.when(c("want_net") == 1, F.array(F.lit(schemas.NETWORK))).otherwise(F.array().cast("array<string>")),
        F.when(c("want_proc") == 1, F.array(F.lit(schemas.PROCESS))).otherwise(F.array().cast("array<string>")))
    asking = wide.select("source_file", "line_number", "event_time", "key", F.explode(wanted).alias("_kind")).select(
        "source_file", "line_number", "event_time", F.concat("_kind", F.lit("|"), "key").alias("key"))
    at_time = Window.partitionBy(*keys, "event_time").orderBy("line_number")
    kept = of_kind.withColumn("_n", F.row_number().over(at_time)).filter(c("_n") <= first)
    # Two steps read the kept events: their details are written as text, and the ranking is done, once.
    kept = session.land(kept.select(*keys, "event_time", "line_number", "_n", *_details()), "kept")
    both = _first_of_kind(asking, kept, keys, seconds, first)
    # Process events come before network events of the same time.
    by_event = Window.partitionBy("source_file", "line_number").orderBy(
        "related_time", c("type").desc(), "_related_line")
    ranked = both.withColumn("position", F.row_number().over(by_event)).filter(c("position") <= first)
    return ranked.drop("_related_line")


def _first_of_kind(asking: DataFrame, kept: DataFrame, keys: list[str], seconds: int, first: int) -> DataFrame:
    c = F.col
    block = F.floor(times.seconds_of(c("event_time")) / TIME_BLOCK)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    # Running number of kept events up to each time of interest.
    starts = asking.select(*keys, (c("event_time") - F.expr(f"interval {seconds} seconds 1 microsecond")
                                   ).alias("event_time"), zero.alias("n")).distinct()
    moves = kept.select(*keys, "event_time", one.alias("n")).unionByName(starts)
    moves = moves.groupBy(*keys, "event_time").agg(F.sum("n").alias("n"), F.sum("n").alias("_here"))
    # The sums are read for the kept events and for the begin of each window.
    upto = session.land(running_sum(moves, keys, "event_time", block, ["n"]), "ranks")
    ranked = kept.join(upto, [*keys, "event_time"]).select(
        *keys, (c("n") - c("_here") + c("_n")).alias("rank"), c("event_time").alias("related_time"),
        c("line_number").alias("_related_line"), "type", "details")
    ask = asking.select(*keys, "line_number", "event_time")
    ask = ask.withColumn("_from", c("event_time") - F.expr(f"interval {seconds} seconds 1 microsecond"))
    begin = upto.select(*keys, c("event_time").alias("_from"), c("n").alias("_begin"))
    ask = ask.join(begin, [*keys, "_from"]).withColumn(
        "rank", F.explode(F.sequence(c("_begin") + 1, c("_begin") + first)))
    found = ask.join(ranked, [*keys, "rank"]).filter(c("related_time") <= c("event_time"))
    return found.select("source_file", "line_number", "type", "related_time", "_related_line", "details")


def _details() -> list[Column]:
    """Type of a related event, and its details written as a dictionary."""
    def quoted(name: str) -> Column:
        return F.concat(F.lit(f"'{name}': '"), F.coalesce(F.col(name), F.lit("")), F.lit("'"))

    def plain(name: str, column: str) -> Column:
        return F.concat(F.lit(f"'{name}': "), F.coalesce(F.col(column).cast("string"), F.lit("None")))

    process = [quoted("process_name"), plain("pid", "pid"), quoted("user")]
    network = [quoted("source_ip"), quoted("dest_ip"), quoted("protocol"), plain("bytes", "bytes_transferred")]
    is_process = F.col("kind") == schemas.PROCESS
    body = F.when(is_process, F.concat_ws(", ", *process)).otherwise(F.concat_ws(", ", *network))
    return [F.when(is_process, "process").otherwise("network").alias("type"), F.concat(F.lit("{"), body, F.lit("}")).alias("details")]


# -- raw context ---------------------------------------------------------------

def preceding_lines(lines: DataFrame, wanted: Column, before: int = 5,
                    block_lines: int = LINE_BLOCK) -> DataFrame:
    """For the `wanted` lines, adds `previous`: up to `before` preceding lines of the file.

    Where each task holds stretches of files in order, as scans of text and of tables written by
    such scans do, no line is shuffled but the last ones of each stretch and the wanted ones
    within `before` lines of its begin.  That is tested on the bounds of the stretches.  Lines
    that were dealt out in any other way are put together by blocks of their numbers.
    """
    placed = keyed_rows(lines).select("*", wanted.alias("_wanted"))
    bounds = session.land(placed.select("source_file", "line_number").mapInArrow(_stretches(0), STRETCHES), "stretches")
    count, total = bounds.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # Very many short stretches are no order worth testing.
    if count * 20 <= total and _overlapping(bounds).isEmpty():
        return _within_stretches(placed, before)
    return _within_blocks(lines, wanted, before, block_lines)


def _overlapping(bounds: DataFrame) -> DataFrame:
    """Stretches that begin before an earlier one of their file ends; a row for each stretch is ordered, none for lines."""
    earlier = Window.partitionBy("source_file").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    return bounds.select("first", F.max("last").over(earlier).alias("_reached")).filter("first <= _reached")


STRETCHES = "source_file string, first bigint, last bigint, n bigint, tail array<string>"


class _Stretch:
    """Cuts a task's rows into stretches: lines of one file with rising numbers and no wide gap."""

    def __init__(self) -> None:
        self.file, self.number, self.first = None, None, None

    def cut(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where stretches begin in a batch, the number each row's stretch began with, and the numbers."""
        numbers = batch.column(batch.schema.get_field_index("line_number")).to_numpy(zero_copy_only=False)
        files = batch.column(batch.schema.get_field_index("source_file")).dictionary_encode()
        codes = files.indices.to_numpy(zero_copy_only=False)
        step = np.diff(numbers)
        fresh = np.concatenate([[True], (codes[1:] != codes[:-1]) | (step <= 0) | (step > STRETCH_GAP)])
        name = files.dictionary[int(codes[0])].as_py()
        goes_on = name == self.file and 0 < numbers[0] - self.number <= STRETCH_GAP
        fresh[0] = not goes_on
        first = np.where(fresh, numbers, 0)
        if goes_on:
            first[0] = self.first
        begins = np.flatnonzero(fresh | (np.arange(len(fresh)) == 0))
        first = np.repeat(first[begins], np.diff(np.append(begins, len(first))))
        self.file, self.number, self.first = files.dictionary[int(codes[-1])].as_py(), int(numbers[-1]), int(first[-1])
        return np.flatnonzero(fresh), first, numbers


def _stretches(before: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The stretches of a task, with their last `before` lines; see STRETCHES."""
    names = ["source_file", "first", "last", "n", "tail"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, open_row = _Stretch(), None
        for batch in batches:
            if not len(batch):
                continue
            begins, first, numbers = stretch.cut(batch)
            files, texts = batch.column(0), batch.column(2) if before else None
            edges = np.unique(np.concatenate([[0], begins, [len(batch)]])).tolist()
            fresh, done = set(begins.tolist()), []
            for a, b in zip(edges[:-1], edges[1:]):
                if open_row is not None and a in fresh:
                    done.append(open_row)
                    open_row = None
                n, kept = (open_row[3], open_row[4]) if open_row else (0, [])
                own = texts.slice(max(a, b - before), b - max(a, b - before)).to_pylist() if before else []
                open_row = (files[b - 1].as_py(), int(first[b - 1]), int(numbers[b - 1]), n + b - a, (kept + own)[-before:] if before else [])
            yield _batch(done, names, types)
        if open_row is not None:
            yield _batch([open_row], names, types)

    return run


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _with_local(before: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The wanted rows with `_first`, the begin of their stretch, and `_local`, the lines before them in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, held = _Stretch(), []
        for batch in batches:
            if not len(batch):
                continue
            begins, first, _ = stretch.cut(batch)
            texts = held + batch.column(batch.schema.get_field_index("line")).to_pylist()
            begin = np.zeros(len(batch), dtype=np.int64) - len(held)  # where each row's stretch begins
            begin[begins] = begins
            begin = np.maximum.accumulate(begin)
            rows = np.flatnonzero(batch.column(batch.schema.get_field_index("_wanted")).fill_null(False).to_numpy(zero_copy_only=False))
            local = [texts[max(begin[i], i - before) + len(held): i + len(held)] for i in rows]
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(first[rows]), pa.array(local, pa.list_(pa.string()))], [*kept.schema.names, "_first", "_local"])
            held = texts[max(begin[-1] + len(held), len(texts) - before):]

    return run


def _within_stretches(placed: DataFrame, before: int) -> DataFrame:
    c = F.col
    tails = session.land(placed.select("source_file", "line_number", "line").mapInArrow(_stretches(before), STRETCHES), "tails")
    # Every stretch has a line, so `before` of them are enough.
    earlier = Window.partitionBy("source_file").orderBy("first").rowsBetween(-before, -1)
    carry = tails.select(c("source_file").alias("_file"), c("first").alias("_begin"),
                         F.flatten(F.collect_list("tail").over(earlier)).alias("_carry"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    found = session.land(placed.mapInArrow(_with_local(before), f"{kept}, _first bigint, _local array<string>"), "wanted")
    whole = found.filter(F.size("_local") >= before).withColumn("previous", c("_local"))
    short = found.filter(F.size("_local") < before).join(carry, (c("source_file") == c("_file")) & (c("_first") == c("_begin")))
    merged = F.concat(c("_carry"), c("_local"))
    short = short.withColumn("previous", F.slice(merged, F.greatest(F.size(merged) - before + 1, F.lit(1)), before))
    drop = ("_wanted", "_first", "_local", "_file", "_begin", "_carry")
    return whole.drop(*drop).unionByName(short.drop(*drop))


def _within_blocks(lines: DataFrame, wanted: Column, before: int, block_lines: int) -> DataFrame:
    """`preceding_lines` of lines in any order.

    Inside a block a row frame does it.  The first lines of a block also need the
    tail of the blocks before: each block passes on its last `before` lines.
    """
    block = F.floor(F.col("line_number") / block_lines)
    rows = lines.withColumn("_block", block)
    inside = Window.partitionBy("source_file", "_block").orderBy("line_number")
    rows = rows.withColumn("_local", F.collect_list("line").over(inside.rowsBetween(-before, -1)))
    # The rank filter also runs before the shuffle, so a task sends `before` lines per block.
    last = Window.partitionBy("source_file", "_block").orderBy(F.desc("line_number"))
    tails = lines.select("source_file", block.alias("_block"), "line_number", "line")
    tails = tails.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= before)
    tails = tails.groupBy("source_file", "_block").agg(
        F.array_sort(F.collect_list(F.struct("line_number", "line")))["line"].alias("_tail"))
    earlier = Window.partitionBy("source_file").orderBy("_block").rowsBetween(-before, -1)
    carry = tails.select("source_file", "_block", F.flatten(F.collect_list("_tail").over(earlier)).alias("_carry"))
    local = F.col("_local")
    merged = F.concat(F.col("_carry"), local)
    size = F.size(merged)
    previous = F.slice(merged, F.greatest(size - before + 1, F.lit(1)), F.least(size, F.lit(before)))
    joined = rows.filter(wanted).join(carry, ["source_file", "_block"])
    return joined.withColumn("previous", F.when(F.size(local) >= before, local).otherwise(previous)).drop(
        "_block", "_local", "_carry")


def raw_context(line_number: Column, previous: Column) -> Column:
    text = F.concat(F.lit("Raw Log Context (Lines around "), line_number.cast("string"), F.lit("):\n"),
                    F.concat_ws("\n", previous))
    return F.when(F.size(previous) > 0, text).otherwise("No recent raw log context available.")
