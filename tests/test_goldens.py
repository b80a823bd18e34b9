"""Worked examples of the scoring, from the formulas by hand."""

import pytest

from threatlake.operators import extract
from threatlake.plans import scan

CASES = {
    "ssh_failed_night": ("Jan 02 03:00:00 h sshd[1]: Failed password for u from 45.67.1.2 port 4000 ssh2", 5.2875, 4, "dynamic"),
    "ssh_failed_day": ("Jan 02 10:00:00 h sshd[1]: Failed password for u from 45.67.1.2 port 4000 ssh2", 2.4675, 3, "rule"),
    "ssh_accepted_maintenance": ("Jan 07 23:00:00 h sshd[1]: Accepted password for u from 192.168.1.5 port 4000 ssh2", 1.7625, 2, "dynamic"),
    "smb_internal": ('{"timestamp":"2024-01-03 12:00:00","src_ip":"10.0.0.5","dst_ip":"10.0.0.6","dst_port":445,"protocol":"tcp"}', 0.126, 1, None),
    "odd_port_unknown_process": ('{"timestamp":"2024-01-03 20:00:00","src_ip":"10.0.0.5","dst_ip":"45.67.1.2","dst_port":4444,"protocol":"tcp","process_name":"evil.exe"}', 5.81625, 4, "dynamic"),
    "odd_port_no_process": ('{"timestamp":"2024-01-03 20:00:00","src_ip":"10.0.0.5","dst_ip":"45.67.1.2","dst_port":4444,"protocol":"tcp"}', 0.7425, 1, None),
    "mimikatz_night": ("2024-01-02 20:00:00 EventID=4688 New Process Name: C:\\x\\powershell.exe Creator Process Name: C:\\Windows\\explorer.exe Process Command Line: mimikatz", 7.5, 5, "dynamic"),
    "mimikatz_day": ("2024-01-02 10:00:00 EventID=4688 New Process Name: C:\\x\\powershell.exe Creator Process Name: C:\\Windows\\explorer.exe Process Command Line: mimikatz", 5.0, 4, "dynamic"),
    "lsass_trusted": ('{"time":"2024-01-02 20:00:00","process_name":"lsass.exe","pid":4,"user":"SYSTEM","path":"C:\\\\Windows\\\\System32\\\\lsass.exe"}', 0.5, 1, None),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [(name, 1, line, "generic") for name, (line, *_) in CASES.items()]
    raw = spark.createDataFrame(rows, "source_file string, line_number bigint, line string, log_type string")
    scored = scan.score_events(extract.parse_events(raw, 2024))
    risks = {r["source_file"]: (r["risk"], r["dynamic_severity"]) for r in scored.collect()}
    found = {r["source_file"]: r["verdict_source"] for r in scan.scan(raw, 2024).collect()}
    return risks, found


@pytest.mark.parametrize("name", CASES)
def test_risk_severity_and_choice(results, name):
    _, risk, severity, source = CASES[name]
    risks, found = results
    assert risks[name][0] == pytest.approx(risk, abs=1e-9)
    assert risks[name][1] == severity
    assert found.get(name) == source


def test_command_line_risk(spark):
    from pyspark.sql import functions as F

    from threatlake.functions import scoring
    commands = {"whoami -a; wget http://a": 3.0, "nc -l 1; regedit add": 5.0, "notepad": 1.0,
                r"C:\temp\a.exe": 4.8, "mimikatz": 5.0}
    df = spark.createDataFrame([(k,) for k in commands], "c string").withColumn("h", scoring.command_hits(F.col("c")))
    got = {r["c"]: r["r"] for r in df.select("c", scoring.command_risk(F.col("h")).alias("r")).collect()}
    assert got == pytest.approx(commands)


def test_benign_threshold_is_a_parameter(lines):
    line = ('{"timestamp":"2024-01-03 20:00:00","src_ip":"10.0.0.5","dst_ip":"45.67.1.2","dst_port":4444,'
            '"protocol":"tcp","app_name":"ntp client"}')
    parsed = extract.parse_events(lines([("a", 1, line)]), 2024)
    assert scan.score_events(parsed).first()["suppressed"]
    kept = scan.score_events(parsed, suppress_below=0.1).first()
    assert not kept["suppressed"]
    assert kept["risk"] == pytest.approx(5.81625 * 0.2)
