from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threatlake.operators import report, search, triage

SAMPLE = ["2024-01-15 10:30:45 TCP 192.168.1.10 -> 8.8.8.8 SYN", "2024-01-15 10:31:00 UDP packet from 192.168.1.11",
          "2024-01-15 10:32:15 Malformed packet found near error code 404", "   "]


@pytest.fixture
def sample(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLE, 1)], "n int, line string")


def numbers(df):
    return sorted(r["n"] for r in df.collect())


def test_sample_searches(sample):
    assert numbers(search.search(sample, "Packet")) == [2, 3]
    assert numbers(search.search(sample, search.Criteria("Packet", case_sensitive=True))) == []
    ips = search.Criteria(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", use_regex=True, case_sensitive=True,
                          start=datetime(2024, 1, 15, 10, 30), end=datetime(2024, 1, 15, 10, 31, 30))
    assert numbers(search.search(sample, ips)) == [1, 2]
    assert numbers(search.search(sample, "")) == [1, 2, 3]


def test_time_range_is_inclusive_and_lets_unknown_times_pass(spark):
    rows = ["2024-01-15 10:30:45 a", "2024-01-15T10:30:45.5 b", "Jan 15 10:30:45 c", "no time d", "2024-99-15 10:30:45 e",
            "2024-01-15 10:30:44 f", "2024-01-15 10:30:45.1234567 g"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "n int, line string")
    at = datetime(2024, 1, 15, 10, 30, 45)
    assert numbers(search.search(df, search.Criteria("", start=at, end=at, default_year=2024))) == [0, 2, 3, 4, 6]
    assert numbers(search.search(df, search.Criteria("", start=at, default_year=2024))) == [0, 1, 2, 3, 4, 6]


def test_unicode_case_and_bad_pattern(spark):
    df = spark.createDataFrame([(1, "CAFÉ crème")], "n int, line string")
    assert numbers(search.search(df, search.Criteria("café", use_regex=True))) == [1]
    assert numbers(search.search(df, "crÈME")) == [1]
    with pytest.raises(ValueError, match="Invalid regex"):
        search.Criteria("(", use_regex=True)


def test_pages_go_on_and_rows_without_a_key_are_errors(spark):
    rows = [("f", i, "c", 3, datetime(2024, 1, 1)) for i in range(1, 1100)]
    found = spark.createDataFrame(rows, FINDING)
    assert [r["line_number"] for r in report.page(found, 21).collect()] == list(range(1001, 1051))
    assert [r["line_number"] for r in report.next_page(found, "f", 1000).collect()] == list(range(1001, 1051))
    lost = spark.createDataFrame([("f", None, "c", 3, datetime(2024, 1, 1))], FINDING)
    texts = spark.createDataFrame([("f", 1, "CONFIDENCE: 1")], "source_file string, line_number bigint, text string")
    for broken in (triage.refine(lost, texts), report.numbered(lost.select("source_file", "line_number"))):
        with pytest.raises(Exception, match="a row has no line_number"):
            broken.collect()


def test_verdict_text(spark):
    texts = ["A: 1\nB: 2", "junk\n\nmore junk\nA : x : y\n cont inued\n\n end\nB:\nA: last", "no keys at all", "", "A:1\r\nB: two \r\n three",
             "\n\n  A:  1  \n\n\nB: http://x\n", "X: 1\nplain\nplain2\nY:2", "first line\nK: v"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    got = {r["n"]: r["v"] for r in df.select("n", triage.parse_verdict(F.col("t")).alias("v")).collect()}
    assert got == {
        0: {"A": "1", "B": "2"}, 1: {"A": "last", "B": ""}, 2: {}, 3: {}, 4: {"A": "1", "B": "two\nthree"},
        5: {"A": "1", "B": "http://x"}, 6: {"X": "1\nplain\nplain2", "Y": "2"}, 7: {"K": "v"}}


FINDING = "source_file string, line_number bigint, content string, severity int, event_time timestamp_ntz"


def test_second_pass(spark):
    t = datetime(2024, 1, 1)
    found = spark.createDataFrame([("f", i, "c", 3, t) for i in range(1, 8)], FINDING)
    texts = {1: "IS_FALSE_POSITIVE: true\nCONFIDENCE: 0.8", 2: "IS_FALSE_POSITIVE: true\nCONFIDENCE: 0.79\nREVISED_SEVERITY: 1",
             3: "IS_FALSE_POSITIVE: false\nCONFIDENCE: 1\nREVISED_SEVERITY: high", 4: "IS_FALSE_POSITIVE: TRUE\nCONFIDENCE: very",
             5: "nothing to read", 6: "REVISED_SEVERITY: 5"}
    verdicts = spark.createDataFrame([("f", k, v) for k, v in texts.items()], "source_file string, line_number bigint, text string")
    got = {r["line_number"]: (r["revised_severity"], r["is_false_positive"]) for r in triage.refine(found, verdicts).collect()}
    assert got == {2: (1, True), 3: (3, False), 4: (3, False), 5: (3, None), 6: (5, False), 7: (3, None)}


def test_groups_and_threats(spark):
    times = [datetime(2024, 1, 1, 0, 0, 10), datetime(2024, 1, 1, 0, 4, 59), datetime(2024, 1, 1, 0, 5), None]
    found = spark.createDataFrame([("f", i, "c", 3, t) for i, t in enumerate(times)], FINDING)
    groups = triage.groups(found)
    assert [(r["findings"], r["first_line"], r["last_line"]) for r in groups.collect()] == [(2, 0, 1)]
    for text, want in (("CORRELATED_THREAT: x\nCONFIDENCE: 0.71\nSEVERITY: bad", [("x", 3)]), ("CONFIDENCE: 0.7", [])):
        verdicts = groups.select("source_file", "bucket", F.lit(text).alias("text"))
        assert [(r["content"], r["severity"]) for r in triage.correlated_threats(groups, verdicts).collect()] == want


def test_triage_treats_silence_as_false_positive(spark):
    t = datetime(2024, 1, 1)
    found = spark.createDataFrame([("f", 1, "c", 3, t), ("f", 2, "c", 3, t), ("f", 3, "c", 1, t), ("f", 4, "c", 2, t)], FINDING)
    schema = "source_file string, line_number bigint, text string"
    verdicts = spark.createDataFrame([("f", 1, "IS_FALSE_POSITIVE: false"), ("f", 2, "CONFIDENCE: 1"), ("f", 3, "IS_FALSE_POSITIVE: no"),
                                      ("f", 4, "IS_FALSE_POSITIVE: no")], schema)
    details = spark.createDataFrame([("f", i, "THREAT: x\nACTIONS: a , b") for i in (1, 2, 3)], schema)
    got = triage.triage(found, verdicts, details).collect()
    assert [(r["line_number"], r["threat"], r["severity"], r["actions"]) for r in got] == [(1, "x", 3, ["a", "b"])]


def test_prompts_and_cache(spark):
    prompts = spark.createDataFrame([("p1",), ("p2",), ("p2",), ("p3",)], "prompt string")
    cache = spark.createDataFrame([("p1", "s"), ("p3", "")], "prompt string, summary string").select(
        triage.cache_key(F.col("prompt"), 200).alias("cache_key"), "summary")
    assert [r["prompt"] for r in triage.cache_misses(prompts, cache).orderBy("prompt").collect()] == ["p2", "p3"]
    text = prompts.limit(1).select(triage.full_prompt(F.col("prompt"), "odd").alias("t")).first()["t"]
    assert text.startswith("Provide a comprehensive analysis") and text.endswith("\n\np1")
