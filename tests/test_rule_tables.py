"""Rule tables by automaton give what every rule gives by itself."""

import random
import re

import pytest
from pyspark.sql import functions as F

from threatlake import catalog
from threatlake.operators import matching, rule_tables
from threatlake.sources import carrier

SCHEMA = "rule_id int, description string, category string, severity int, pattern string"


@pytest.mark.parametrize("pattern, literals", [
    (r"failed\s+password", ["password"]), (r"\bport 4444\b", ["port 4444"]), (r"a(?:bcd|efg)h", []), (r"foo|BAR+x", ["foo", "bar"]),
    (r"foo|\d+", []), (r"abcd?e", ["abc"]), (r"abcd{0,2}", ["abc"]), (r"abcd{2}efg", ["abcd"]), (r"10\.0\.0\.1", ["10.0.0.1"]),
    (r"(one|two) three", [" three"]), (r"[a-z]+ing the", ["ing the"]), (r"[^]]abc", []), (r"[a[bc]]def", []), (r"(?x)a b c d", []),
    (r"\Qabc.d\E", []), (r"\x41bcd", []), (r"", []), (r"[\]x]tail", ["tail"]), (r"(a|b)*stem(c)?", ["stem"]), (r"né abc", [" abc"]),
    (r"(?i)Select.*from", ["select"]), (r"((ab)c|d)efgh{1,3}?", ["efgh"]), (r"ab*?cde++f", ["cde"])])
def test_mandatory_literals(pattern, literals):
    assert rule_tables.mandatory_literals(pattern) == literals


def test_literals_are_in_every_match():
    rnd = random.Random(3)
    atoms = ["ab", "c", r"\.", "[xy]", r"\d", ".", "(de|f)", "g?", "h*", "i+", "j{2}", "k{0,1}", "|", "lmn", r"\b", "[^a]"]
    checked = 0
    for _ in range(3000):
        pattern = "".join(rnd.choice(atoms) for _ in range(rnd.randint(1, 7)))
        literals = rule_tables.mandatory_literals(pattern, least=1)
        lines = ["".join(rnd.choice(["ab", "c", ".", "x", "4", "de", "f", "g", "h", "i", "jj", "k", "lmn", " "]) for _ in range(9)) for _ in range(9)]
        for line in lines:
            if literals and re.search(pattern, line, re.IGNORECASE):
                checked += 1
                assert any(x in line for x in literals), (pattern, line)
    assert checked > 500


def pairs(df):
    return sorted((r.line_number, r.rule_id) for r in df.collect())


@pytest.mark.parametrize("pass_bytes", [1 << 20, 900])
def test_hits_are_those_of_unrolled_rules(spark, lines, pass_bytes):
    pool = [*carrier.RULE_LINES, *carrier.BENIGN_LINES, *carrier.OTHER_LINES, *carrier.COMMANDS, "FAİLED ſsh login", "maſſcan port", "", "x" * 200_000 + " nmap scan",
            "Key tok", "ıdle İdle"]
    rules = [(r.rule_id, r.description, r.category, r.severity, r.pattern) for r in catalog.ROOT_RULES]
    rules += [(900, "key", "X", 1, "key tok"), (901, "idle", "X", 1, "^idle idle$"), (902, "digits", "X", 1, r"\d{3}"), (903, "none", "X", 1, None),
              (903, "twice", "X", 1, "nmap"), (903, "twice", "X", 1, "nmap")]
    df = lines([("f", i, line) for i, line in enumerate(pool)] + [("f", 999, None)]).withColumn("severity", F.lit("clash"))
    table = spark.createDataFrame(rules, SCHEMA)
    got = rule_tables.table_hits(df, table, pass_bytes)
    listed = table.filter("pattern is not null")
    unrolled = matching.rule_hits(df.filter("line is not null"), matching.rules_from_table(listed))
    assert pairs(got) == pairs(unrolled) and {900, 901, 902, 903} < {r for _, r in pairs(got)}
    assert got.columns == ["source_file", "line_number", "line", "log_type", "rule_id", "description", "category", "severity", "pattern"]
    assert {type(r.severity) for r in got.collect()} == {int}


def test_empty_and_invalid_tables(spark, lines):
    df = lines([("f", 1, "abc")])
    table = spark.createDataFrame([(1, "d", "c", 1, "abc")], SCHEMA)
    assert rule_tables.table_hits(df, table.limit(0)).count() == 0
    assert rule_tables.table_hits(df.limit(0), table).count() == 0
    with pytest.raises(ValueError, match="Invalid regex"):
        rule_tables.table_hits(df, spark.createDataFrame([(1, "d", "c", 1, "a(b")], SCHEMA))


def test_plan_does_not_grow(spark, lines):
    df = lines([("f", 1, "abc 17 x")])
    table = spark.range(3000).selectExpr("cast(id as int) rule_id", "'d' description", "'c' category", "1 severity", "concat('abc ', id, ' ') pattern")
    hits = rule_tables.table_hits(df, table)
    assert pairs(hits) == [(1, 17)]
    assert len(hits._jdf.queryExecution().optimizedPlan().toString()) < 20_000
