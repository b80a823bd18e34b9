"""Streams: batch equality, late rows, expiring counters."""

import random

import pytest
from pyspark.sql import functions as F

from threatlake import session
from threatlake.plans import scan
from threatlake.sources import logs
from threatlake.streaming import streams


def write(spark, folder, name, rows):
    path = folder / name
    path.write_text("\n".join(rows) + "\n")


def ssh(clock, ip="45.1.1.1"):
    return f"Jan 02 {clock} h sshd[1]: Failed password for u from {ip} port 4000 ssh2"


def test_stream_of_files_equals_batch(spark, tmp_path):
    rows = [ssh("03:00:00"), "", "nmap port scan", "plain", '{"process_name":"evil.exe","pid":1,"cmdline":"mimikatz"}', "x" * 3000]
    write(spark, tmp_path, "a.log", rows)
    stream = streams.findings(streams.read_text_stream(spark, str(tmp_path)), 2024)
    got = sorted((r["content"], r["severity"]) for r in streams.run_available(stream, "t").collect())
    batch = scan.stateless_findings(logs.clean_lines(logs.read_text(spark, str(tmp_path))), 2024)
    assert got == sorted((r["content"], r["severity"]) for r in batch.collect())
    assert len(got) == 3


def test_a_stream_has_settings_of_its_own(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name), spark.conf.get("spark.sql.shuffle.partitions")
    own = streams.own_session(spark, 3, rocksdb=True)
    assert own.conf.get(name) == streams.ROCKSDB and own.conf.get("spark.sql.shuffle.partitions") == "3"
    assert before == (spark.conf.get(name), spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.shared_folder(own) == session.shared_folder(spark)


@pytest.mark.parametrize("split", ["100", "1000", "1m"])
def test_streamed_lines_have_numbers_in_their_order(spark, tmp_path, split):
    rnd = random.Random(2)
    want = {}
    for name in ("a.log", "b.log", "c.log"):
        want[name] = [rnd.choice(["", "x", "é" * rnd.randrange(90)]) + f"#{i}" if rnd.random() < 0.8 else "" for i in range(400)]
        write(spark, tmp_path, name, want[name])
    own = streams.own_session(spark)
    for key, value in (("files.maxPartitionBytes", split), ("files.openCostInBytes", split), ("execution.arrow.maxRecordsPerBatch", "7")):
        own.conf.set(f"spark.sql.{key}", value)
    found = {}
    for r in streams.run_available(streams.read_text_stream(own, str(tmp_path)), "n").collect():
        found.setdefault(r.source_file.rsplit("/", 1)[-1], []).append((r.line_number, r.line))
    assert {name: [line for _, line in sorted(rows)] for name, rows in found.items()} == want
    assert all(len({n for n, _ in rows}) == len(rows) for rows in found.values())
    if split == "1m":
        assert sorted(n for n, _ in found["a.log"]) == list(range(1, 401))


@pytest.fixture
def rocksdb(spark):
    return streams.own_session(spark, 2, rocksdb=True)


def test_counters_continue_and_expire(spark, tmp_path, rocksdb):
    out, state = session.new_folder(spark, "out"), session.new_folder(spark, "state")
    for i, clocks in enumerate((["03:00:00", "03:10:00"], ["03:20:00"], ["06:00:00"], ["06:01:00"], ["23:00:00"])):
        write(spark, tmp_path, f"{i}.log", [ssh(c) for c in clocks])  # the last one closes the blocks before it
        # One file per run; the folder name stands for the log's name.
        lines = streams.read_text_stream(rocksdb, str(tmp_path)).withColumn("source_file", F.lit("f"))
        query = streams.running_counters(streams.events(lines, 2024)).writeStream.format("parquet").outputMode(
            "append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted(r["frequency"] for r in spark.read.parquet(out).collect())
    # The count runs on over batches; after a gap of hours it starts anew.
    assert got == [1, 1, 2, 2, 3]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    out, state = session.new_folder(spark, "out"), session.new_folder(spark, "state")
    dropped = 0
    for i, clock in enumerate(["03:00:00", "05:00:00", "03:00:30", "08:00:00"]):
        write(spark, tmp_path, f"{i}.log", [ssh(clock)])
        lines = streams.read_text_stream(spark, str(tmp_path)).withColumn("source_file", F.lit("f"))
        query = streams.retained(streams.events(lines, 2024)).writeStream.format("parquet").outputMode("append").option(
            "path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        dropped += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped > 0
    counts = {r["window_end"].strftime("%H:%M"): r["events"] for r in spark.read.parquet(out).collect()}
    assert counts["03:05"] == 1 and max(counts.values()) == 1


def test_retention_to_the_second(spark, tmp_path, rocksdb):
    """Counts go over batches, drop an event 300 seconds after it, and leave out late rows, which are counted."""
    out, state = session.new_folder(spark, "out"), session.new_folder(spark, "state")
    late = 0
    batches = [["03:00:01", "03:00:00", "03:00:01"], ["03:05:00", "03:05:01", "03:05:02"], ["03:10:01", "03:10:03"], ["06:00:00"],
               ["03:10:04"], ["06:05:01"], ["12:00:00"]]
    for i, clocks in enumerate(batches):
        write(spark, tmp_path, f"{i}.log", [ssh(c) for c in clocks])
        lines = streams.read_text_stream(rocksdb, str(tmp_path)).withColumn("source_file", F.lit("f"))
        query = streams.retained_events(streams.events(lines, 2024)).writeStream.format("parquet").outputMode("append").option(
            "path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        late += streams.late_rows(query).agg(F.sum("late_rows")).first()[0]
    got = [(r.event_time.strftime("%H:%M:%S"), r.events, r.retained, r.oldest.strftime("%H:%M:%S"))
           for r in spark.read.parquet(out).orderBy("event_time").collect()]
    assert got == [
        ("03:00:00", 1, 1, "03:00:00"), ("03:00:01", 2, 3, "03:00:00"), ("03:05:00", 1, 4, "03:00:00"), ("03:05:01", 1, 4, "03:00:01"),
        ("03:05:02", 1, 3, "03:05:00"), ("03:10:01", 1, 3, "03:05:01"), ("03:10:03", 1, 2, "03:10:01"), ("06:00:00", 1, 1, "06:00:00"),
        ("06:05:01", 1, 1, "06:05:01")]
    assert late == 1


def test_counters_do_not_depend_on_arrival(spark, tmp_path, rocksdb):
    """One busy key, its rows out of order and over several files, and a pause of over an hour."""
    rows = [ssh(f"03:{i // 60:02d}:{i % 60:02d}") for i in range(0, 240)] + [ssh(f"04:{i:02d}:01") for i in range(4, 7)] + [ssh("04:04:01")]
    found = []
    for seed in range(2):
        folder = tmp_path / str(seed)
        folder.mkdir()
        random.Random(seed).shuffle(rows)
        for i in range(3):
            write(spark, folder, f"{i}.log", rows[i::3])
        lines, close = streams.closable(streams.read_text_stream(rocksdb, str(folder)).withColumn("source_file", F.lit("f")))
        timed = streams.events(lines, 2024)
        numbered = timed.withColumn("line_number", F.unix_timestamp("event_time"))
        counted = streams.run_available(streams.running_counters(numbered), "t", close=close)
        found.append([r["frequency"] for r in counted.orderBy("line_number", "frequency").collect()])
    assert found[0] == found[1] == [*range(1, 241), 1, 2, 3, 4]


def test_a_busy_key_reaches_the_counter_as_blocks(spark):
    import pandas as pd
    end = pd.to_datetime(["2024-01-01 00:00:10", "2024-01-01 00:00:20", "2024-01-01 02:00:10"])
    us = [int(t.timestamp() * 1e6) for t in end]
    chunk = pd.DataFrame({"block_end": end, "events": [2_000_000, 5, 7], "first_us": us, "last_us": us})

    class Handle:
        def deleteTimer(self, at): pass
        def registerTimer(self, at): self.at = at

    class Value:
        def exists(self): return False
        def update(self, value): self.value = value

    counter = streams._Counter()
    counter._handle, counter._count = Handle(), Value()
    out, = counter.handleInputRows(("f", "k", "s"), iter([chunk.iloc[[2]], chunk.iloc[[0, 1]]]), None)
    assert out["base"].tolist() == [0, 2_000_000, 0] and counter._count.value == (7, us[2])
