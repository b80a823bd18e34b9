"""The scan on streams.

Every function takes a streaming DataFrame and returns one; the caller starts
the query.  State expires by event time behind a watermark; late rows are
dropped and counted in the query's progress (`numRowsDroppedByWatermark`).
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from threatlake import catalog, schemas, session
from threatlake.functions import scoring
from threatlake.operators import alarms, extract, lookups, running
from threatlake.plans import scan
from threatlake.sources import logs

DELAY = "5 minutes"
LIFETIME_MS = 3_600_000
RETAINED_MS = catalog.CORRELATION_SECONDS * 1000
SECOND_MS = 1000


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Changes instead of snapshots after each micro-batch, no count of all rows beside them, no space set aside.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def own_session(spark: SparkSession, state_partitions: int | None = None, rocksdb: bool = False) -> SparkSession:
    """A session for streams, so that their settings are not the caller's.

    The number of state partitions is fixed when a query first starts and is not coalesced at
    run time; by default there is one per core of the cluster.
    """
    own = session.prepare(spark.newSession())
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.sparkContext.defaultParallelism))
    if rocksdb:
        for name, value in STATE_SETTINGS.items():
            own.conf.set(name, value)
    return own


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the first byte of each row's split by the row's number, see `read_text_stream`."""
    last, before = None, 0
    for batch in batches:
        if not len(batch):
            continue
        starts = batch.column("line_number").to_numpy()
        files = batch.column("source_file").dictionary_encode()
        codes = files.indices.to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])]))
        place = np.arange(1, len(batch) + 1) - np.repeat(begins, np.diff(np.append(begins, len(batch))))
        split = (files.dictionary[int(codes[0])].as_py(), int(starts[0]))
        if split == last:
            place[: begins[1] if len(begins) > 1 else len(batch)] += before
        last, before = (files.dictionary[int(codes[-1])].as_py(), int(starts[-1])), int(place[-1])
        yield batch.set_column(batch.schema.get_field_index("line_number"), "line_number", pa.array(starts + place + (starts > 0)))


def read_text_stream(spark: SparkSession, path: str, log_type: str = "generic", most_tasks: int | None = None) -> DataFrame:
    """raw_logs of files as they arrive in a folder, each line with a number of its own.

    A file's lines are numbered inside the split that they are read from, upwards from its first
    byte.  A split has at most as many lines as bytes, so the numbers of a file are unique and in
    the order of its lines, whatever task or batch reads them, and a retried batch gives the same.
    In the first split they are the line numbers; later ones leave gaps.

    With `most_tasks` small splits share a task, so a batch of many small files does not become as
    many tasks and files of the sink.
    """
    lines = spark.readStream.text(path)
    raw = lines.select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("line_number"),
        logs.drop_bad_bytes(F.col("value")).alias("line"), F.lit(log_type).alias("log_type"))
    if most_tasks is not None:
        raw = raw.coalesce(most_tasks)
    return raw.mapInArrow(_placed, "source_file string, line_number bigint, line string, log_type string")


def findings(lines: DataFrame, default_year: int | None = None) -> DataFrame:
    """Findings of each line alone (R1); append mode, no state."""
    return scan.stateless_findings(logs.clean_lines(lines), default_year)


def _timed(lines: DataFrame, default_year: int | None) -> DataFrame:
    parsed = extract.parse_events(logs.clean_lines(lines), default_year)
    known = parsed.filter(F.col("kind").isin(schemas.NETWORK, schemas.PROCESS) & F.col("event_time").isNotNull())
    return known.withColumn("event_time", F.col("event_time").cast("timestamp"))


def events(lines: DataFrame, default_year: int | None = None, delay: str = DELAY) -> DataFrame:
    """Timed network and process events with a watermark.

    A watermark needs a `timestamp` column, so the event time is one here; with
    the session in UTC it reads the same as the batch's `timestamp_ntz`.
    """
    return _timed(lines, default_year).withWatermark("event_time", delay)


def landed_events(lines: DataFrame, default_year: int | None = None, delay: str = DELAY) -> tuple[DataFrame, Callable[[], None]]:
    """`events` by way of a table, and what to call to bring the table up to the input at hand.

    Each line is parsed once, by a query without state, however many branches of a query read the
    events; each branch reads only its columns.
    """
    spark, parsed = lines.sparkSession, _timed(lines, default_year)
    folder, state = session.new_folder(spark, "events"), session.new_folder(spark, "events-state")

    def feed() -> None:
        (parsed.writeStream.format("parquet").outputMode("append").option("path", folder).option(
            "checkpointLocation", state).trigger(availableNow=True).start()).awaitTermination()

    feed()
    return spark.readStream.schema(parsed.schema).parquet(folder).withWatermark("event_time", delay), feed


def _retention_key() -> Column:
    pair = F.concat(F.lit("pair:"), F.col("source_ip"), F.lit(":"), F.col("dest_ip"))
    name = F.concat(F.lit("name:"), F.col("process_name"))
    return F.when(F.col("kind") == schemas.NETWORK, pair).otherwise(name)


def retained(stream: DataFrame) -> DataFrame:
    """Events per address pair or process in the last 300 seconds, each minute (R2)."""
    window = F.window("event_time", f"{catalog.CORRELATION_SECONDS} seconds", "1 minute")
    return stream.groupBy(window.alias("w"), "source_file", _retention_key().alias("key")).agg(
        F.count(F.lit(1)).alias("events")).select(
        F.col("w")["end"].alias("window_end"), "source_file", "key", "events")


def late_rows(query: StreamingQuery) -> DataFrame:
    """(batch_id, watermark, late_rows): what each batch that is still reported dropped as late, zeros included (R2)."""
    rows = [(int(p["batchId"]), (p["eventTime"] or {}).get("watermark"),
             sum(int(op["numRowsDroppedByWatermark"]) for op in p["stateOperators"])) for p in query.recentProgress]
    return SparkSession.active().createDataFrame(rows, "batch_id bigint, watermark string, late_rows bigint")


class _Retained(StatefulProcessor):
    """How many events of a key are at most 300 seconds older than each of its closed times, and the oldest of them.

    Sees one row for each time, however many events it has, and keeps the times of 300 seconds.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._times = handle.getListState("times", "us bigint, n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = list(self._times.get()) if self._times.exists() else []
        new = pd.concat(list(rows)).sort_values("us")
        us = np.array([t for t, _ in old] + new["us"].tolist(), dtype=np.int64)
        total = np.concatenate([[0], np.cumsum([n for _, n in old] + new["events"].tolist())]).astype(np.int64)
        first = np.searchsorted(us, us - RETAINED_MS * 1000)
        kept = range(int(first[-1]), len(us))
        self._times.put([(int(us[i]), int(total[i + 1] - total[i])) for i in kept])
        if old:
            self._handle.deleteTimer(old[-1][0] // 1000 + RETAINED_MS + SECOND_MS)
        # The next times can begin a second before the watermark.
        self._handle.registerTimer(int(us[-1]) // 1000 + RETAINED_MS + SECOND_MS)
        own = slice(len(old), None)
        yield pd.DataFrame({
            "source_file": key[0], "key": key[1], "block_end": new["block_end"].to_numpy(), "us": us[own], "events": new["events"].to_numpy(),
            "retained": (total[1:] - total[first])[own], "oldest_us": us[first][own]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self._times.clear()
        return iter(())

    def close(self) -> None:
        pass


def retained_events(stream: DataFrame) -> DataFrame:
    """(source_file, key, event_time, events, retained, oldest): what is retained at each event (R2).

    Events of an address pair or a process stay for 300 seconds after their own time, to the
    microsecond; events of one time see the same ones.  They are counted by time before the
    shuffle, so a busy key weighs by its distinct times; state expires by a timer.  Late rows are
    dropped and counted by `late_rows`.  A key with a missing part is empty.

    Needs the RocksDB state store: `own_session(spark, rocksdb=True)`.
    """
    c = F.col
    times = stream.select("source_file", F.coalesce(_retention_key(), F.lit("")).alias("key"), "event_time").groupBy(
        F.window("event_time", "1 second").alias("w"), "source_file", "key", F.unix_micros("event_time").alias("us")).agg(
        F.count(F.lit(1)).alias("events"))
    found = times.select("source_file", "key", F.window_time("w").alias("block_end"), "us", "events").groupBy(
        "source_file", "key").transformWithStateInPandas(
        statefulProcessor=_Retained(), outputStructType=RETAINED, outputMode="Append", timeMode="EventTime", eventTimeColumnName="block_end")
    return found.select("source_file", "key", F.timestamp_micros("us").alias("event_time"), "events", "retained",
                        F.timestamp_micros("oldest_us").alias("oldest"))


class _Counter(StatefulProcessor):
    """How many events of a key come before each of its closed time blocks; forgotten an hour after the last.

    Sees one row for each block, however many events the block has, and keeps two numbers.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._count = handle.getValueState("count", "n bigint, last_us bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, last = self._count.get() if self._count.exists() else (0, None)
        before = last
        blocks = pd.concat(list(rows)).sort_values("block_end")
        bases = []
        for events, first_us, last_us in blocks[["events", "first_us", "last_us"]].itertuples(index=False, name=None):
            if last is not None and first_us - last > LIFETIME_MS * 1000:
                n = 0
            bases.append(n)
            n, last = n + int(events), int(last_us)
        self._count.update((n, last))
        if before is not None:
            self._handle.deleteTimer(before // 1000 + LIFETIME_MS)
        self._handle.registerTimer(last // 1000 + LIFETIME_MS)
        yield pd.DataFrame({"k_file": key[0], "k_key": key[1], "k_source": key[2], "k_end": blocks["block_end"].to_numpy(), "base": bases})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self._count.clear()
        return iter(())

    def close(self) -> None:
        pass


# The counter travels with its code: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RETAINED = "source_file string, key string, block_end timestamp, us bigint, events bigint, retained bigint, oldest_us bigint"
BASES = "k_file string, k_key string, k_source string, k_end timestamp, base bigint"



def running_counters(stream: DataFrame) -> DataFrame:
    """Running count of each event's key, forgotten after an hour without one.

    A key's events are cut into blocks of ten seconds of event time, counted before they are
    shuffled.  Once the watermark closes a block, the counter of its key gives the number of
    events before it, and a join on the block adds that to each event's place inside.  So only
    the events of ten seconds meet in one row, a busy key weighs on the counter by its blocks, and
    the result does not depend on the order of arrival.  A missing part of a key counts as empty.

    Needs the RocksDB state store: `own_session(spark, rocksdb=True)`.
    """
    c = F.col
    keys = ["source_file", "freq_key", "freq_source"]
    keyed = running.with_frequency_key(stream).select(
        "source_file", *[F.coalesce(k, F.lit("")).alias(k) for k in keys[1:]], "line_number", "event_time")
    block = F.window("event_time", f"{running.TIME_BLOCK} seconds")
    blocks = keyed.groupBy(block.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("events"), F.min(F.unix_micros("event_time")).alias("first_us"), F.max(F.unix_micros("event_time")).alias("last_us"))
    bases = blocks.select(*keys, F.window_time("w").alias("block_end"), "events", "first_us", "last_us").groupBy(
        *keys).transformWithStateInPandas(statefulProcessor=_Counter(), outputStructType=BASES, outputMode="Append",
                                          timeMode="EventTime", eventTimeColumnName="k_end")
    # The places inside a block: its events in the order of their times.
    places = keyed.groupBy(block.alias("w"), *keys).agg(F.array_sort(F.collect_list(F.struct("event_time", "line_number"))).alias("rows"))
    places = places.select(*keys, F.window_time("w").alias("block_end"), "rows")
    joined = places.join(bases, (c("source_file") == c("k_file")) & (c("freq_key") == c("k_key")) & (
        c("freq_source") == c("k_source")) & (c("block_end") == c("k_end")))
    return joined.select(*keys, "base", F.posexplode(c("rows")["line_number"]).alias("_place", "line_number")).select(
        *keys, "line_number", (c("base") + c("_place") + 1).alias("frequency"))


def hourly_baseline(stream: DataFrame) -> DataFrame:
    """Events per source for each event type and hour."""
    hour = F.window("event_time", "1 hour")
    counts = alarms.event_type(stream).groupBy(hour.alias("w"), "event_type", "event_source").agg(
        F.count(F.lit(1)).alias("events"))
    return counts.groupBy("w", "event_type").agg(
        (F.sum("events") / F.count(F.lit(1))).alias("baseline")).select(
        F.col("w")["start"].alias("hour"), "event_type", "baseline")


def stream_deviation(stream: DataFrame) -> DataFrame:
    """(hour, event_type, event_source, events, baseline, score): each hour's sources against the hour before.

    The baseline of an hour is in force through the next one, as it is refreshed hourly.  A type
    that did not occur in the hour before has no baseline.  The watermark closes an hour, its
    baseline version is then joined to the next hour's counts and dropped behind it.
    """
    c = F.col
    hourly = alarms.event_type(stream).groupBy(F.window("event_time", "1 hour").alias("w"), "event_type", "event_source").agg(
        F.count(F.lit(1)).alias("events"))
    start = F.unix_seconds(c("w")["start"])
    versions = hourly.groupBy("w", "event_type").agg((F.sum("events") / F.count(F.lit(1))).alias("baseline")).select(
        F.window_time("w").alias("closed"), (start + 3600).alias("next_hour"), c("event_type").alias("known_type"), "baseline")
    counts = hourly.select(F.window_time("w").alias("ends"), start.alias("this_hour"), c("w")["start"].alias("hour"),
                           "event_type", "event_source", "events")
    # Both times are the last microsecond of an hour, so exactly one version lies in the range.  The range
    # lets state expire; the hour is a key too, so that a row meets that version only and not all of its type.
    one_hour = F.expr("interval 1 hour")
    in_force = (c("closed") >= c("ends") - one_hour) & (c("closed") <= c("ends") - one_hour)
    met = counts.join(versions, (c("event_type") == c("known_type")) & (c("this_hour") == c("next_hour")) & in_force, "left_outer")
    return met.select("hour", "event_type", "event_source", "events", "baseline",
                      scoring.deviation_score(c("baseline"), c("events")).alias("score"))


def rate_alarms(stream: DataFrame, limit: int = catalog.MAX_CONNECTIONS_PER_MINUTE) -> DataFrame:
    """Pairs with more connections than allowed in a minute, sliding by ten seconds."""
    window = F.window("event_time", "1 minute", "10 seconds")
    known = stream.filter(F.col("kind") == schemas.NETWORK)
    return known.groupBy(window.alias("w"), "source_ip", "dest_ip").agg(
        F.count(F.lit(1)).alias("connections")).filter(F.col("connections") > limit).select(
        F.col("w")["start"].alias("window_start"), "source_ip", "dest_ip", "connections")


def network_with_process(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Network events with the process activity of the 300 seconds before.

    Process events are first counted per second, so an event meets at most 301
    rows however busy the process is.  The join is on stretches of 300 seconds: a second
    stands in its own and in the next, an event in its own, so it looks through two
    stretches and not through all seconds of the process.
    """
    c = F.col

    def stretch(time: str) -> Column:
        return F.floor(F.unix_seconds(time) / catalog.CORRELATION_SECONDS)

    process = stream.filter((c("kind") == schemas.PROCESS) & (c("process_name") != ""))
    second = F.window("event_time", "1 second")
    counts = process.groupBy(second.alias("w"), "source_file", "process_name").agg(
        F.count(F.lit(1)).alias("process_events"))
    counts = counts.select(
        F.window_time("w").alias("second_end"), c("w")["start"].alias("second"),
        c("source_file").alias("p_file"), c("process_name").alias("p_name"), "process_events")
    counts = counts.withColumn("p_stretch", F.explode(F.array(stretch("second"), stretch("second") + 1)))
    network = stream.filter((c("kind") == schemas.NETWORK) & (c("process_name") != "")).select(
        "source_file", "line_number", "process_name", "event_time", stretch("event_time").alias("stretch"))
    # `second_end` is the last microsecond of the second.
    near = (c("second_end") <= c("event_time") + F.expr("interval 1 second")) & (
        c("second_end") >= c("event_time") - F.expr(f"interval {catalog.CORRELATION_SECONDS} seconds"))
    joined = network.join(counts, (c("source_file") == c("p_file")) & (c("process_name") == c("p_name")) & (
        c("stretch") == c("p_stretch")) & near)
    inside = (c("second") <= c("event_time")) & (
        c("second") >= c("event_time") - F.expr(f"interval {catalog.CORRELATION_SECONDS} seconds"))
    return joined.filter(inside).select(
        "source_file", "line_number", "process_name", "event_time", "second", "process_events")


class AlarmLimits(NamedTuple):
    """More than so many raise an alarm; so many distinct ports already do."""

    scanned_ports: int = catalog.LIMIT_SCANNED_PORTS
    failed_logins: int = catalog.LIMIT_FAILED_LOGINS
    transfer_mb: int = catalog.LIMIT_TRANSFER_MB
    connections: int = catalog.LIMIT_CONNECTIONS_PER_MINUTE
    dns_queries: int = catalog.LIMIT_DNS_PER_MINUTE


def threshold_alarms(stream: DataFrame, limits: AlarmLimits = AlarmLimits()) -> DataFrame:
    """(alarm, source_ip, detail, window_start, value): all threshold alarms A11-A14 on the stream.

    Port scans and failed logins per five minutes, transfers of a connection per hour, connections,
    DNS queries and uses of a service per minute.  `detail` is the connection or the service; a
    service has no source.  Each event is parsed once for each of the three window lengths.
    """
    c = F.col
    network = c("kind") == schemas.NETWORK
    nobody, nothing = F.lit(None).cast("string"), F.lit(None).cast("int")

    def point(condition: Column, alarm: str, least: Column, source: Column = c("source_ip"), detail: Column = nobody,
              item: Column = nothing, amount: Column = F.lit(1)) -> Column:
        return F.when(condition, F.struct(
            F.lit(alarm).alias("alarm"), source.alias("source_ip"), detail.alias("detail"), least.cast("bigint").alias("least"),
            item.cast("int").alias("item"), amount.cast("bigint").alias("amount")))

    def over(events: DataFrame, window: str, *points: Column) -> DataFrame:
        """The sums, or numbers of distinct items, that reach their limit.

        Items are told apart in a first aggregate, of one row for each item and window: for
        ports that is exact and bounded.  Both combine rows before they shuffle.
        """
        counted = events.select("event_time", F.explode(F.array_compact(F.array(*points))).alias("p")).select("event_time", "p.*")
        keys = ["alarm", "source_ip", "detail", "least"]
        items = counted.groupBy(F.window("event_time", window).alias("w"), *keys, "item").agg(F.sum("amount").alias("amount"))
        totals = items.groupBy("w", *keys).agg(F.count("item").alias("items"), F.sum("amount").alias("amount"))
        value = F.when(c("alarm") == "port_scan", c("items")).otherwise(c("amount"))
        return totals.withColumn("value", value).filter(c("value") >= c("least")).select(
            "alarm", "source_ip", "detail", c("w")["start"].alias("window_start"), "value")

    def above(limit: int | Column) -> Column:
        return (limit if isinstance(limit, Column) else F.lit(limit)) + 1

    service = c("service")
    connection = F.concat_ws(" ", F.concat_ws(":", c("source_ip"), c("source_port").cast("string")), F.lit("->"),
                             F.concat_ws(":", c("dest_ip"), c("dest_port").cast("string")), c("protocol"))
    minute = over(
        lookups.with_service(stream), "1 minute",
        point(network, "connection_rate", above(limits.connections)),
        point(network & alarms.is_dns_query(), "dns_rate", above(limits.dns_queries)),
        point(network & service["per_minute_limit"].isNotNull(), "service_rate", above(service["per_minute_limit"]),
              source=nobody, detail=service["service"]))
    minutes = over(
        stream, "5 minutes",
        point(network & c("dest_port").isNotNull(), "port_scan", F.lit(limits.scanned_ports), item=c("dest_port")),
        point(c("status") == "Failed", "failed_logins", above(limits.failed_logins)))
    hour = over(stream, "1 hour", point(
        network, "large_transfer", above(limits.transfer_mb * 1024 * 1024), detail=connection, amount=F.coalesce("bytes_transferred", F.lit(0))))
    return minute.unionByName(minutes).unionByName(hour)


# A line far behind all others: its time closes every window before it.
CLOSING_LINE = (" EventID=5156 Application Name: C:\\end.exe Source Address: 0.0.0.0 Source Port: 1 Dest Address: 0.0.0.0 "
                "Dest Port: 1 Protocol: 6")


def closable(lines: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """raw_logs that can be closed: the stream, and what to call once its input is complete.

    Closing adds one line of the year 2199, so the watermark passes all windows; the line's own
    windows stay open and are never written.
    """
    spark = lines.sparkSession
    folder = session.new_folder(spark, "closing")
    schema = "source_file string, line_number bigint, line string, log_type string"
    nothing = spark.createDataFrame([], schema)
    nothing.write.parquet(folder)

    def close() -> None:
        row = ("closing", 1, "2199-01-01 00:00:00" + CLOSING_LINE, "generic")
        spark.createDataFrame([row], schema).write.mode("append").parquet(folder)

    return lines.union(spark.readStream.schema(schema).parquet(folder)), close


def run_available(stream: DataFrame, label: str, close: Callable[[], None] | None = None) -> DataFrame:
    """Runs an append-mode query over the input at hand into a parquet table and reads it.

    Windows that the watermark has not passed stay open; with `close` (of `closable`) the input
    is closed after it and the query runs on, so they are written too.
    """
    spark = stream.sparkSession
    stream = stream.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp"
                             else F.col(f.name) for f in stream.schema.fields])
    out, state = session.new_folder(spark, label), session.new_folder(spark, f"{label}-state")
    for step in (None, close) if close else (None,):
        if step:
            step()
        (stream.writeStream.format("parquet").outputMode("append").option("path", out).option(
            "checkpointLocation", state).trigger(availableNow=True).start()).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
