"""Blocked computations against brute force, with one hot key and tiny blocks."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from threatlake import session
from threatlake.operators import alarms, extract, report, running, triage
from threatlake.plans import scan


@pytest.fixture(scope="module")
def rows():
    """Half of all events share one pair and process; times repeat and are out of order."""
    rnd = random.Random(11)
    start = datetime.datetime(2024, 1, 1)
    out = []
    for n in range(1, 701):
        file = "hot.log" if rnd.random() < 0.8 else "b.log"
        t = start + datetime.timedelta(seconds=rnd.choice([0, 1, 299, 300, 301, rnd.randint(0, 1500)]),
                                       microseconds=rnd.choice([0, 0, 1, 500000]))
        name = "evil.exe" if rnd.random() < 0.5 else f"p{rnd.randint(0, 3)}"
        if rnd.random() < 0.6:
            src, dst = ("45.1.1.1", "10.0.0.1") if rnd.random() < 0.6 else (f"10.0.0.{rnd.randint(1, 3)}", "10.0.0.9")
            out.append((file, n, "NETWORK", t, src, dst, rnd.choice([80, 443]), "TCP", name if rnd.random() < 0.7 else "", None, 0, None, 7))
        elif rnd.random() < 0.9:
            out.append((file, n, "PROCESS", t, None, None, None, None, name, "u" if rnd.random() < 0.5 else "", None, 5, None))
        else:
            out.append((file, n, "GENERIC", None, None, None, None, None, None, None, None, None, None))
    return out


SCHEMA = ("source_file string, line_number bigint, kind string, event_time timestamp_ntz, source_ip string, dest_ip string, "
          "dest_port int, protocol string, process_name string, user string, source_port int, pid int, bytes_transferred bigint")


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def test_running_frequency(events, rows):
    seen, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        if r[2] == "GENERIC":
            continue
        key = (r[0], r[4], r[5], r[7], r[6]) if r[2] == "NETWORK" else (r[0], r[8], r[9] or "UnknownUser")
        seen[key] = seen.get(key, 0) + 1
        want[(r[0], r[1])] = seen[key]
    for block in (3, 50, 10**6):
        got = {(r[0], r[1]): r[2] for r in running.running_frequency(events, block).collect()}
        assert got == want


def related(a, rows, seconds=300):
    low = a[3] - datetime.timedelta(seconds=seconds)
    inside = [b for b in rows if b[0] == a[0] and b[3] is not None and low <= b[3] <= a[3]]
    same = [b for b in inside if a[8] and b[8] == a[8]]
    if a[2] == "NETWORK":
        return [b for b in same if b[2] == "PROCESS"] + [b for b in inside if b[2] == "NETWORK" and b[4:6] == a[4:6]]
    return [b for b in same if b[2] == "PROCESS"] + [b for b in same if b[2] == "NETWORK"]


def test_correlation_count(events, rows):
    want = {(r[0], r[1]): len(related(r, rows)) for r in rows if r[3] is not None}
    for block in (1, 60, 10**6):
        got = {(r[0], r[1]): r[2] for r in running.correlation_count(events, block_seconds=block).collect()}
        assert got == want


def test_first_correlated(events, rows):
    want = {}
    for r in rows:
        if r[3] is not None:
            first = sorted(related(r, rows), key=lambda b: (b[3], b[2] != "PROCESS", b[1]))[:5]
            want[(r[0], r[1])] = [(b[2].lower(), b[3]) for b in first]
    got = {}
    for r in running.earliest_correlated(events).orderBy("position").collect():
        got.setdefault((r["source_file"], r["line_number"]), []).append((r["type"], r["related_time"]))
    assert got == want


def test_pair_rate_spans_files(events, rows):
    nets = [r for r in rows if r[2] == "NETWORK"]
    want = {(a[0], a[1]): sum(b[4:6] == a[4:6] and a[3] - datetime.timedelta(seconds=60) <= b[3] <= a[3] for b in nets) for a in nets}
    got = {(r[0], r[1]): r["connections"] for r in alarms.connection_rate(events).collect()}
    assert got == want


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_preceding_lines(spark, block):
    rnd = random.Random(5)
    kept = [(f, n) for f in ("a", "b") for n in range(1, 120) if rnd.random() < 0.3]
    df = spark.createDataFrame([(f, n, f"{f}{n}", n % 2 == 0) for f, n in kept],
                               "source_file string, line_number bigint, line string, wanted boolean")
    got = {(r["source_file"], r["line_number"]): r["previous"]
           for r in running.preceding_lines(df, F.col("wanted"), 5, block).collect()}
    want = {}
    for f in ("a", "b"):
        numbers = [n for g, n in kept if g == f]
        for i, n in enumerate(numbers):
            if n % 2 == 0:
                want[(f, n)] = [f"{f}{m}" for m in numbers[max(0, i - 5):i]]
    assert got == want


def contexts(rows, before=5):
    """(file, number, line, wanted) rows in order, brute force."""
    return {(f, n): [r[2] for r in rows[:i] if r[0] == f][-before:] for i, (f, n, _, w) in enumerate(rows) if w}


@pytest.mark.parametrize("parts, at_once", [(1, 10_000), (3, 7), (11, 64)])
def test_context_of_ordered_tables_leaves_the_lines_where_they_are(spark, monkeypatch, parts, at_once):
    rnd = random.Random(6)
    rows = [(f, n, f"{f}{n}", rnd.random() < 0.1) for f in ("a", "b", "c") for n in range(1, 900) if rnd.random() < 0.6 and not 300 < n < 1400 + len(f)]
    rows += [("d", n, f"d{n}", True) for n in (1, 2, 5000, 5001, 9000)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "source_file string, line_number bigint, line string, wanted boolean")
    df = session.land(df, "ordered")
    monkeypatch.setattr(running, "_within_blocks", None)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, at_once)
    try:
        got = running.preceding_lines(df, F.col("wanted"))
        found = {(r["source_file"], r["line_number"]): r["previous"] for r in got.collect()}
    finally:
        spark.conf.unset(name)
    assert found == contexts(rows) and got.columns == [*df.columns, "previous"]


def test_context_of_lines_dealt_out_in_any_way(spark, monkeypatch):
    rows = [("a", n, f"a{n}", n % 9 == 0) for n in range(1, 2000)]
    df = session.land(spark.createDataFrame(rows, "source_file string, line_number bigint, line string, wanted boolean").repartition(4), "dealt")
    monkeypatch.setattr(running, "_within_stretches", None)
    found = {(r["source_file"], r["line_number"]): r["previous"] for r in running.preceding_lines(df, F.col("wanted")).collect()}
    assert found == contexts(rows)


def test_ordinals_and_bundles(spark):
    rows = [(f, n * 7, "text", 3, [("t", "C", f"d{n}", 3)]) for f in ("a", "b") for n in range(1, 124)]
    df = spark.createDataFrame(rows, "source_file string, line_number bigint, content string, severity int, "
                               "indicators array<struct<type:string,category:string,description:string,severity:int>>")
    got = running.ordinal(df, "o", 40).filter("source_file = 'b'").orderBy("line_number").collect()
    assert [r["o"] for r in got] == list(range(1, 124))
    bundles = triage.evidence_bundles(df, 50, 40).orderBy("source_file", "bundle").collect()
    assert [b["findings"] for b in bundles] == [50, 50, 23] * 2
    assert bundles[0]["text"].startswith("Finding (Severity 3):\ntext\nIndicators: d1\nFinding (Severity 3):")
    assert sum(b["text"].count("Indicators:") for b in bundles) == len(rows)


def test_hot_pair_scan_keeps_every_row(spark, lines):
    n = 3000
    raw = lines([("hot", i, f"Jan 02 03:00:0{i % 2} h sshd[1]: Failed password for u from 45.67.1.2 port 4000 ssh2")
                 for i in range(1, n + 1)])
    scored = scan.score_events(extract.parse_events(raw, 2024))
    total = scored.agg(F.count("*"), F.max("frequency"), F.max("correlated"), F.min("correlated")).first()
    assert tuple(total) == (n, n, n, n // 2)


# -- plans ---------------------------------------------------------------------------

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_map_stages_do_not_shuffle(spark, lines):
    from threatlake.operators import matching
    raw = lines([("a", 1, "nmap port")])
    for df in (matching.best_rule(raw), matching.file_findings(raw), extract.parse_events(raw, 2024), scan.stateless_findings(raw, 2024)):
        assert "Exchange hashpartitioning" not in plan(df)


def test_examples_rank_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1, "x", 5)], "source_file string, line_number bigint, content string, severity int")
    text = plan(report.examples(df))
    assert text.count("WindowGroupLimit") == 2


def test_counting_shuffles_only_narrow_columns(spark, events):
    wide = events.withColumn("line", F.lit("x" * 50).cast("string"))
    for df in (running.running_frequency(wide), running.correlation_count(wide)):
        assert "line#" not in "".join(x for x in plan(df).splitlines() if "Exchange" in x)


def test_search_reaches_the_parquet_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from threatlake.operators import search
    text = plan(search.search(df.select("doc_id", "text"), search.Criteria("The", case_sensitive=True), "text"))
    assert "StringContains(text,The)" in text and "ReadSchema: struct<doc_id:bigint,text:string>" in text
