import json
import os

import pytest
from pyspark.sql import functions as F

from threatlake import catalog, session
from threatlake.operators import matching
from threatlake.plans import scan
from threatlake.sources import logs, sinks


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    want = set()
    for f in range(3):
        text = []
        for i in range(1, 4001 + f * 1000):
            body = "" if i % 97 == 0 else f"file {f} line {i} " + "x" * (i % 60)
            text.append(body)
            want.add((f"f{f}.log", i, body))
        (folder / f"f{f}.log").write_text("\n".join(text) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        scan_df = spark.read.text(str(folder))
        assert scan_df.rdd.getNumPartitions() > 10
        numbered = logs.read_text(spark, str(folder)).select("source_file", "line_number", "line")
        assert {(os.path.basename(r[0]), r[1], r[2]) for r in numbered.collect()} == want
        # However many splits there are, no exchange carries text.
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange" in x and "Broadcast" not in x and "value" in x]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbering_does_not_shuffle_the_text(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    plan = logs.read_text(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line and "Broadcast" not in line:
            assert "value" not in line


def test_hygiene(lines):
    rows = [("a", 1, ""), ("a", 2, "  \t "), ("a", 3, "\x00\x00"), ("a", 4, " x\x00y "), ("a", 5, "z" * 2047),
            ("a", 6, "z" * 2048), ("a", 7, " ok ")]
    got = {r["line_number"]: r["line"] for r in logs.clean_lines(lines(rows)).collect()}
    assert got == {4: "xy", 5: "z" * 2047, 6: "z" * 2048, 7: "ok"}
    limited = logs.clean_lines(lines(rows), catalog.MAX_LINE_LENGTH)
    assert {r["line_number"] for r in limited.collect()} == {4, 5, 7}


def test_bad_bytes_are_ignored(spark, tmp_path):
    raw = b"caf\xc3\xa9 \xff\xfe ok\nreal \xef\xbf\xbd mark\n\xc3 end\n"
    (tmp_path / "b.log").write_bytes(raw)
    got = [r["line"] for r in logs.read_text(spark, str(tmp_path)).orderBy("line_number").collect()]
    assert got == raw.decode("utf-8", errors="ignore").splitlines()


def test_json_documents(spark, tmp_path):
    files = {"array.json": [{"b": 1, "a": "dns query blocked"}, 5, "text"], "object.json": {"z": 1, "a": {"k": [1, 2]}}}
    for name, doc in files.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=2))
    (tmp_path / "number.json").write_text("17")
    (tmp_path / "broken.json").write_text("[1, 2")
    rows = logs.read_json_documents(spark, str(tmp_path)).collect()
    got = sorted((os.path.basename(r["source_file"]), r["line_number"], r["line"]) for r in rows)
    assert got == [("array.json", 1, '{"b":1,"a":"dns query blocked"}'), ("array.json", 2, "5"), ("array.json", 3, "text"),
                   ("object.json", 1, '{"z":1,"a":{"k":[1,2]}}')]


def test_dispatch_by_extension_and_type(spark, tmp_path):
    (tmp_path / "a.pcap").write_text("p1\np2\n")
    (tmp_path / "b.json").write_text('[{"x": 1}]')
    (tmp_path / "c.log").write_text("g1\n")
    (tmp_path / "D.PCAPNG").write_text("p3\n")
    (tmp_path / "noext").write_text("g2\ng3\n")
    got = {r["log_type"]: r["n"] for r in logs.read_logs(spark, str(tmp_path)).groupBy("log_type").agg(
        F.count("*").alias("n")).collect()}
    assert got == {"wireshark": 3, "volatility_json": 1, "generic": 3}
    numbered = {(os.path.basename(r["source_file"]), r["line_number"], r["line"]) for r in logs.read_logs(spark, str(tmp_path)).collect()}
    assert {("noext", 1, "g2"), ("noext", 2, "g3"), ("c.log", 1, "g1"), ("a.pcap", 2, "p2")} <= numbered
    only = logs.read_logs(spark, str(tmp_path / "b.json")).collect()
    assert [(r["log_type"], r["line"]) for r in only] == [("volatility_json", '{"x":1}')]
    assert logs.read_logs(spark, str(tmp_path / "c.log"), "volatility_text").first()["log_type"] == "volatility_text"
    with pytest.raises(ValueError):
        logs.read_logs(spark, str(tmp_path), "syslog")


def test_packet_sample_is_all_port_scan(lines):
    flags = ("[SYN] Seq=0", "[FIN,PSH,URG] Seq=1000", "flags: none Seq=2000", "ttl:10 Seq=4000",
             "fragment offset=1400 overlap Seq=5000", "ICMP type 15 code 99", "Payload: SELECT * FROM users WHERE 1=1;")
    rows = [("cap", i, f"2024-03-20 10:15:0{i}.123 192.168.1.100:12345 -> 10.0.0.50:80 {f} Win=1024 Len={i}")
            for i, f in enumerate(flags)]
    found = matching.file_findings(lines(rows)).collect()
    assert len(found) == len(rows)
    assert {(r["severity"], r["indicators"][0]["category"]) for r in found} == {(4, "RECON")}


def test_findings_and_rules_are_written(spark, lines, tmp_path):
    raw = lines([("a", 1, "nmap port"), ("a", 2, "nothing"), ("a", 3, "Vulnerability CVE-2024-12345 Severity: High")])
    found = scan.scan(raw, 2024, context=True)
    sinks.write_findings(found, str(tmp_path / "f"))
    back = {r["line_number"]: r for r in spark.read.parquet(str(tmp_path / "f")).collect()}
    assert sorted(back) == [1, 3] and back[3]["severity"] == 5
    assert back[1]["context"] == "No recent raw log context available."
    assert back[3]["context"] == "Raw Log Context (Lines around 3):\nnmap port\nnothing"
    sinks.write_report(found, str(tmp_path / "r"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "r")).collect())
    assert "- Vulnerability Finding: Critical Severity" in text
    sinks.export_rules(spark, str(tmp_path / "rules"))
    assert spark.read.json(str(tmp_path / "rules")).count() == 14


def test_landing_needs_a_shared_folder(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
