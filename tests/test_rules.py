"""Every rule fires on its own line, and literal gates change nothing."""

import random
import re

import pytest
from pyspark.sql import functions as F

from threatlake import catalog
from threatlake.functions import scoring, text
from threatlake.operators import matching
from threatlake.sources import carrier


def python_match(rule, line):
    # Java's word, digit and space classes are ASCII here.
    hit = re.search(rule.pattern, line, re.IGNORECASE | re.ASCII if line.isascii() else re.IGNORECASE)
    tokens = rule.min_tokens and len(re.findall(catalog.SHORT_NUMBER, line)) >= rule.min_tokens
    return bool(hit or tokens)


def random_lines(n=400):
    rnd = random.Random(7)
    words = ("failed invalid ssh login password from 192.168.1.1 45.6.7.8 nmap port scan dns query to google.com c2 domain: x "
             "GET POST eval( admin upload of large multiple data file sudo escalation access denied syn flood beacon command "
             "and control bash spawn delete etc ET EXPLOIT Cls: Exploit Vulnerability CVE-2024-12345 Severity: 9.8 10.0 High "
             "Misconfiguration Default Password tcp ntp client smb negotiate 1 22 333 4444 55555 666666 bulk copy 5 GB to "
             "10.1.1.1 unusual traffic observed source: error authentication failure outbound connection suspicious").split()
    return [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("rules", [catalog.ROOT_RULES, catalog.SCAN_RULES, catalog.THREAT_RULES],
                         ids=["root", "scan", "threat"])
def test_rules_match_as_in_python(spark, rules):
    pool = random_lines() + list(carrier.RULE_LINES + carrier.BENIGN_LINES + carrier.OTHER_LINES)
    pool += ["FAİLED ſsh login", "maſſcan port", "É nmap port é"]
    lines = spark.createDataFrame([(i, line) for i, line in enumerate(pool)], "id int, line string")
    got = {(r["id"], r["rule_id"]) for r in matching.rule_hits(lines, rules).collect()}
    want = {(i, r.rule_id) for i, line in enumerate(pool) for r in rules if python_match(r, line)}
    ascii_only = {i for i, line in enumerate(pool) if line.isascii()}
    assert {g for g in got if g[0] in ascii_only} == {w for w in want if w[0] in ascii_only}
    # Letters that fold to ASCII pass the gate.
    if rules is catalog.ROOT_RULES:
        assert (len(pool) - 2, 1) in got


def test_gates_change_nothing(spark):
    lines = spark.createDataFrame([(line,) for line in random_lines(300) + ["maſſcan port"]], "line string")
    for rule in catalog.ROOT_RULES + catalog.SCAN_RULES + catalog.THREAT_RULES:
        gated = matching.rule_condition(F.col("line"), rule)
        plain = matching.rule_condition(F.col("line"), rule._replace(hints=()))
        assert lines.filter(gated != plain).count() == 0, rule.description


@pytest.mark.parametrize("i", range(20))
def test_each_root_rule_has_its_line(spark, i):
    lines = spark.createDataFrame([(carrier.RULE_LINES[i],), ("quiet text",)], "line string")
    hits = {r["rule_id"] for r in matching.rule_hits(lines, catalog.ROOT_RULES).collect()}
    assert i + 1 in hits
    assert matching.rule_hits(lines.filter("line = 'quiet text'"), catalog.ROOT_RULES).count() == 0


def test_short_number_count_equals_the_regex(spark):
    rnd = random.Random(3)
    pool = ["".join(rnd.choice("0123456789 a.:") for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    rule = catalog.SCAN_RULES[0]
    lines = spark.createDataFrame([(line,) for line in pool], "line string")
    got = {r["line"] for r in lines.filter(matching.rule_condition(F.col("line"), rule)).collect()}
    assert got == {line for line in pool if re.search(r"(?:\b\d{1,5}\b.*){5,}", line)}


def test_best_rule_prefers_severity_then_order(spark):
    lines = spark.createDataFrame([("Failed ssh login from 45.6.7.8 nmap port",), ("GET /login eval(",)], "line string")
    got = [r["rule"]["rule_id"] for r in matching.best_rule(lines).orderBy("line").collect()]
    assert got == [2, 9]


def test_external_syn_and_longest_first(spark):
    lines = spark.createDataFrame([("tcp syn 45.6.7.8",), ("tcp syn 10.0.0.1",), ("https GET /x 10.0.0.1",),
                                   ("http GET /admin 10.0.0.1",)], "line string")
    got = {r["line"]: r["benign"] and r["benign"]["description"] for r in matching.benign_rule(lines).collect()}
    assert got == {"tcp syn 45.6.7.8": "External TCP SYN", "tcp syn 10.0.0.1": "Internal TCP SYN",
                   "https GET /x 10.0.0.1": "Internal HTTPS request", "http GET /admin 10.0.0.1": None}


def test_user_rules_and_bad_patterns(spark):
    table = spark.createDataFrame([(1, "d", "C", 3, "a+b"), (2, "e", "C", 5, "zz")],
                                  "rule_id int, description string, category string, severity int, pattern string")
    rules = matching.rules_from_table(table)
    lines = spark.createDataFrame([("xAAB",), ("none",)], "line string")
    assert [r["rule_id"] for r in matching.rule_hits(lines, rules).collect()] == [1]
    with pytest.raises(ValueError):
        matching.rules_from_table(table.withColumn("pattern", F.lit("(")))


def test_patterns_are_checked_by_the_engine_that_runs_them(spark):
    for bad in ("(?P<a>the)", "(", "[z-a]", "a{2,1}"):
        with pytest.raises(ValueError, match="Invalid regex"):
            matching.check_pattern(bad)
    for good in ("(?<a>the)", "(?<=a|bc)d", r"\p{IsGreek}+"):
        matching.check_pattern(good)


def test_unicode_white_space_counts_on_other_lines(spark):
    rule = catalog.Rule(1, "user", "d", "C", 3, r"failed\s+login\b", ("failed",))
    rows = ["failed login x", "failed\u00a0login é", "FAILED\u2003LOGIN.", "failedlogin"]
    lines = spark.createDataFrame([(r,) for r in rows], "line string")
    assert {r["line"] for r in lines.filter(matching.rule_condition(F.col("line"), rule)).collect()} == set(rows[:3])


def test_benign_rules_are_tried_in_catalogue_order(spark):
    cases = {"dns query db.internal dns response NXDOMAIN": "Internal DNS query", "dns query google.com db.local": "Common External DNS query",
             "tcp syn ack 10.0.0.7": "Internal TCP handshake ACK", "https GET /a http GET /b 10.0.0.7": "Internal HTTPS request",
             "arp who-has 10.0.0.1 arp reply 10.0.0.1": "Internal ARP request", "dhcp offer discover": "DHCP discover"}
    lines = spark.createDataFrame([(x,) for x in cases], "line string")
    assert {r["line"]: r["benign"]["description"] for r in matching.benign_rule(lines).collect()} == cases


def test_many_rules_share_masks(spark):
    rules = tuple(catalog.Rule(i, "user", f"rule {i}", "C", 1 + i % 5, rf"\bw{i}\b") for i in range(130))
    lines = spark.createDataFrame([("w0 w61 w62 w129",), ("none",)], "line string")
    found = matching.file_findings(lines, rules).collect()
    assert len(found) == 1
    assert [x["description"] for x in found[0]["indicators"]] == ["rule 0", "rule 61", "rule 62", "rule 129"]
    assert found[0]["severity"] == 5


def test_later_family_replaces_equal_keys():
    a, b = catalog.THREAT_RULES[0], catalog.THREAT_RULES[1]
    merged = dict(matching.merged_families({"k": a, "x": a}, {"k": b}))
    assert merged == {"k": b, "x": a}
    assert len(matching.merged_families()) == 11


def test_masks_run_in_generated_code():
    assert text.regex("a").startswith("(?iud)")


ACCENTED = "né {} ü"


@pytest.mark.parametrize("space", [" ", "\u00a0", "\u2003"])
def test_white_space_beyond_ascii_hides_nothing(spark, space):
    rows = [(1, f"http GET{space}/x 10.0.0.1", f"net{space}user", f"unknown{space}tmp.exe"), (2, "nothing", "dir", "a.exe")]
    for wrap in ("{}", ACCENTED):
        df = spark.createDataFrame([(i, wrap.format(line), wrap.format(cmd), name) for i, line, cmd, name in rows],
                                   "line_number int, line string, cmd string, name string")
        got = matching.benign_rule(df).select(
            "line_number", "benign.description", scoring.command_risk(scoring.command_hits(F.col("cmd"))).alias("risk"),
            scoring.simple_process_risk(F.col("name"), F.col("cmd")).alias("simple")).orderBy("line_number").collect()
        assert [tuple(r) for r in got] == [(1, "Internal HTTP request", 3.5, 2.0), (2, None, 1.0, 0.0)]


def test_case_folding_beyond_ascii_passes_the_gate(spark):
    # The long s folds to s but is its own lower case, so no literal search may stand before the regex.
    df = spark.createDataFrame([("\u017fmb negotiate 10.0.0.7",)], "line string")
    assert matching.benign_rule(df).first().benign.description == "Internal SMB negotiation"


def test_exported_patterns_find_what_the_rules_find(spark):
    from threatlake.sources import sinks
    lines = ["SCAN the port", "1 22 333 4444 55555", "Wrong login", "authentication failure", "nothing 1 2 3 4"]
    exported = {r.description: re.compile(r.pattern) for r in sinks.exported_rules(spark).collect()}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_number int, line string")
    got = {r.line_number: {i.description for i in r.indicators} for r in matching.all_indicators(df).collect()}
    assert got == {i: {d for d, p in exported.items() if p.search(x)} for i, x in enumerate(lines)}
