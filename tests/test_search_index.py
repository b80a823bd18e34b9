"""Search over an indexed table gives the rows of a search over all of it, from fewer files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatlake import session
from threatlake.operators import search, search_index
from threatlake.operators.search import Criteria

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFG0123456789-. "
ODD = ["Straße Kelvin KELVIN", "İstanbul port", "ſecret paſſword", "dısk full", "ÉCOLE écolE", "ΣΑΣ σας",
       "Привет Мир", "a\x00b null byte", "", None, "   ", "x", "the same line", "the same line"]


@pytest.fixture(scope="module")
def landed(spark):
    rnd = random.Random(11)
    rows = [(i, "".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 40)))) for i in range(3000)]
    rows += [(3000 + i, x) for i, x in enumerate(ODD)] + [(4000, "long " + "filler " * 400_000 + "needle-at-end")]
    table = spark.createDataFrame(rows, "n bigint, line string").repartition(12, F.col("n"))
    folder = session.new_folder(spark, "indexed")
    search_index.land_indexed(table, folder, rows_per_file=100)
    return folder, rows


def found(spark, folder, criteria):
    return sorted(r.n for r in search.search(search_index.candidates(spark, folder, criteria), criteria).collect())


def test_terms_in_any_case(spark, landed):
    folder, rows = landed
    whole = spark.createDataFrame(rows, "n bigint, line string")
    rnd = random.Random(5)
    terms = ["kelvin", "istanbul", "i̇stanbul", "secret", "ſecret", "disk", "école", "ÉCOLE", "σας", "ΣΑΣ", "мир", "straße", "x", "",
             "the same line", "needle-at-end", "not anywhere", "b null", "same line\n"]
    lines = [x for _, x in rows[:3000] if len(x) > 8]
    for _ in range(10):
        line = rnd.choice(lines)
        begin = rnd.randint(0, len(line) - 8)
        terms.append(line[begin: begin + 7].swapcase())
    for term in terms:
        for sensitive in (False, True):
            criteria = Criteria(term, case_sensitive=sensitive)
            assert found(spark, folder, criteria) == sorted(r.n for r in search.search(whole, criteria).collect()), (term, sensitive)


@pytest.mark.parametrize("pattern", [
    r"needle-\w+-end", r"k[e]lvin", r"kelvin", r"secret\s+password", r"istanbul|disk\s", r"the same (line|word)", r"\d{3}-", r"", r"port$",
    r"(?-i)Kelvin", r"no such thing|nor this"])
def test_patterns(spark, landed, pattern):
    folder, rows = landed
    whole = spark.createDataFrame(rows, "n bigint, line string")
    for sensitive in (False, True):
        criteria = Criteria(pattern, use_regex=True, case_sensitive=sensitive)
        assert found(spark, folder, criteria) == sorted(r.n for r in search.search(whole, criteria).collect())


def test_rare_terms_leave_most_files_unread(spark, landed):
    folder, _ = landed
    everything = len(spark.read.parquet(f"{folder}/rows").inputFiles())
    assert everything >= 24  # at most 100 rows each
    assert len(search_index.candidates(spark, folder, "needle-at-end").inputFiles()) == 1
    assert len(search_index.candidates(spark, folder, Criteria(r"secret\s+password", use_regex=True)).inputFiles()) <= 2
    assert not search_index.candidates(spark, folder, "not anywhere").inputFiles()
    # Nothing to go by, or too many files: all are read.
    for criteria in ("", "ab", Criteria(r"\d+", use_regex=True), Criteria("Привет", case_sensitive=True)):
        assert len(search_index.candidates(spark, folder, criteria).inputFiles()) == everything
    assert len(search_index.candidates(spark, folder, "the same line", most_files=0).inputFiles()) == everything


def test_index_reads_the_wanted_buckets(spark, landed):
    plan = search_index.candidate_files(spark, landed[0], "needle-at-end")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(bucket" in plan


def test_findings_are_searched_as_json(spark):
    rows = [(i, {"category": f"kind{i % 7}", "text": f"item number {i} of many"}) for i in range(400)]
    findings = spark.createDataFrame(rows, "severity int, content map<string,string>").repartition(8, F.col("severity"))
    folder = session.new_folder(spark, "indexed")
    search_index.land_indexed(findings, folder, F.to_json(F.struct("*")))
    for term in ("Number 37 of", '"severity":399', "kind3", "absent term"):
        got = search.search_findings(search_index.candidates(spark, folder, term), term)
        assert sorted(r.severity for r in got.collect()) == sorted(
            r.severity for r in search.search_findings(findings, term).collect())
    assert len(search_index.candidates(spark, folder, '"severity":399').inputFiles()) == 1


def test_empty_table_and_own_column_names(spark):
    empty = spark.createDataFrame([], "file string, text string, bucket int, bits binary")
    folder = session.new_folder(spark, "indexed")
    search_index.land_indexed(empty, folder, "text")
    assert search_index.candidates(spark, folder, "anything").count() == 0
    assert search_index.candidates(spark, folder, "").columns == empty.columns
    clash = spark.createDataFrame([("f", "some words here", 1, b"1")], empty.schema)
    folder = session.new_folder(spark, "indexed")
    search_index.land_indexed(clash, folder, "text")
    assert search_index.candidates(spark, folder, "Words").collect() == clash.collect()


def test_places_of_windows_meet_those_of_the_whole():
    data = np.frombuffer(bytes(random.Random(2).choices(range(256), k=5000)), dtype=np.uint8)
    for size in search_index.GRAMS:
        whole = set(search_index.gram_places(data, size).tolist())
        parts = [search_index.gram_places(data[i: i + 100 + max(search_index.GRAMS) - 1], size) for i in range(0, 5000, 100)]
        assert set(np.concatenate(parts).tolist()) == whole
        plain = [int.from_bytes(bytes([size]) + data[i: i + size].tobytes(), "big") for i in range(5001 - size)]
        assert len(set(plain)) >= len(whole)
    assert len(search_index.gram_places(data[:2], 3)) == 0
