import datetime

from pyspark.sql import functions as F

from threatlake.functions import events as ev
from threatlake.functions import net, text, times
from threatlake.operators import extract, lookups
from threatlake.sources import reference


# Addresses and where they belong, written out by hand from the registries of special addresses.
PLACES = {
    "localhost": "127.0.0.1 ::1",
    "internal": """0.0.0.0 0.1.2.3 10.0.0.1 10.255.255.255 127.0.0.2 127.9.9.9 169.254.0.1 169.254.255.255 172.16.0.1 172.31.255.255
        192.0.0.8 192.0.0.170 192.0.2.1 192.168.0.1 192.168.255.255 198.18.0.1 198.19.255.255 198.51.100.7 203.0.113.7 240.0.0.1
        255.255.255.255 :: fe80::1 febf::1 fc00:: fdff::1 2001:db8::1 2001::1 2001:1ff::1 64:ff9b:1::1 100::1 2001:10::1
        ::ffff:10.0.0.1 ::ffff:a00:1""",
    "special": "100.64.0.1 100.127.1.1",
    "external": """1.2.3.4 8.8.8.8 9.255.255.255 11.0.0.0 45.67.89.1 100.63.255.255 100.128.1.1 126.255.255.255 128.0.0.1 169.253.1.1
        169.255.1.1 172.15.255.255 172.32.0.1 191.255.1.1 192.0.0.9 192.0.0.10 192.0.1.1 192.167.255.255 192.169.0.0 198.17.255.255
        198.20.0.0 198.51.99.1 203.0.112.255 203.0.114.0 224.0.0.1 239.255.255.255 2606:4700::1111 2001:200::1 2001:4:112::1
        2001:20::1 2001:30::1 64:ff9b::1 2001:db9::1 3fff::1 ::ffff:100.64.0.1 ff02::1 ::ffff:8.8.8.8 1:2:3:4:5:6:7:8""",
    "unknown": """1.2.3 01.2.3.4 1.2.3.4.5 256.1.1.1 self a.b.c.d 1:2:3:4:5:6:7 1::2::3 12345:: g::1 :1:2 1:2:3:4:5:6:7: ::1.2.3.400 :::""",
}


def test_locations(spark):
    expected = {ip: place for place, listed in PLACES.items() for ip in listed.split()} | {"": "unknown"}
    df = spark.createDataFrame([(ip,) for ip in expected], "ip string")
    got = {r["ip"]: r["l"] for r in net.with_location(df, "ip", "l").collect()}
    assert {ip: (got[ip], place) for ip, place in expected.items() if got[ip] != place} == {}


def test_timestamps(spark):
    d = datetime.datetime
    cases = {
        "2024-01-05 10:11:12": d(2024, 1, 5, 10, 11, 12), "2024-1-5 1:2:3": d(2024, 1, 5, 1, 2, 3),
        "2024-01-05T10:11:12": d(2024, 1, 5, 10, 11, 12), "2024-01-05 10:11:12.5": d(2024, 1, 5, 10, 11, 12, 500000),
        "2024-01-05T10:11:12.123456Z": d(2024, 1, 5, 10, 11, 12, 123456), "Jan 05 10:11:12": d(2023, 1, 5, 10, 11, 12),
        "jan  5 10:11:12": d(2023, 1, 5, 10, 11, 12), "2024/01/05 10:11:12": d(2024, 1, 5, 10, 11, 12),
        "01/05/2024 10:11:12": d(2024, 1, 5, 10, 11, 12), "05/Jan/2024:10:11:12 +0200": d(2024, 1, 5, 8, 11, 12),
        " 2024-01-05 10:11:12 ": d(2024, 1, 5, 10, 11, 12), "2024-13-05 10:11:12": None, "2024-01-05": None, "": None,
        "2024-01-05T10:11:12Z": None, "Foo 05 10:11:12": None, "2024-01-05 25:11:12": None, "1704448272": None,
    }
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    got = {r["s"]: r["t"] for r in df.select("s", times.parse_timestamp(F.col("s"), 2023).alias("t")).collect()}
    assert got == cases


def test_time_factors(spark):
    d = datetime.datetime
    cases = {d(2024, 1, 7, 22): 0.5, d(2024, 1, 8, 3, 59): 0.5, d(2024, 1, 8, 4): 1.5, d(2024, 1, 4, 23): 0.5, d(2024, 1, 5, 0, 59): 0.5,
             d(2024, 1, 5, 1): 1.5, d(2024, 1, 5, 8): 0.7, d(2024, 1, 5, 17, 59): 0.7, d(2024, 1, 5, 18): 1.5, d(2024, 1, 6, 12): 1.5}
    df = spark.createDataFrame([(t,) for t in cases], "t timestamp_ntz")
    got = {r["t"]: r["m"] for r in df.select("t", times.time_multiplier(F.col("t")).alias("m")).collect()}
    assert got == cases


def test_fixed_decimals_round_like_python(spark):
    values = [1.005, 2.675, 0.125, 2.5, 1234567.891, 0.0, 5.2875, 0.7425]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r["s"] for r in df.select(text.fixed(F.col("v"), 2).alias("s")).collect()]
    assert got == [f"{v:.2f}" for v in values]


def test_json_events(spark, lines):
    rows = [
        '{"timestamp":1704448272.5,"src_ip":"1.1.1.1","dst_ip":"2.2.2.2","dst_port":"80","protocol":"udp","app_name":"x","bytes_sent":5,"bytes_received":6,"action":"deny"}',
        '{"src_ip":"1.1.1.1","dst_ip":"2.2.2.2","dst_port":"http","protocol":"udp"}',
        '{"src_ip":"1.1.1.1","dst_ip":"2.2.2.2","dst_port":80,"protocol":"tcp","bytes":"many"}',
        '{"command_line":"whoami -a","process_id":7,"parent_process_id":"9","exe":"/bin/x","time":"2024-01-05T10:00:00"}',
        '{"process_name":"p","pid":3,"parent_pid":0,"cmdline":"c","username":"u"}',
        '{"process_name":"p","cmdline":"no pid"}',
        '{"process_name":"p","pid":"x"}', '{"broken": ', '[1]', 'word only', 'word',
    ]
    got = extract.parse_events(lines([("f", i, r) for i, r in enumerate(rows)])).orderBy("line_number").collect()
    assert [r["kind"] for r in got] == ["NETWORK", "GENERIC", "GENERIC", "PROCESS", "PROCESS"] + ["GENERIC"] * 6
    first = got[0]
    assert (first["dest_port"], first["source_port"], first["protocol"], first["process_name"], first["bytes_transferred"],
            first["status"]) == (80, 0, "UDP", "x", 11, "deny")
    assert first["event_time"] == datetime.datetime(2024, 1, 5, 9, 51, 12, 500000)
    assert (got[3]["pid"], got[3]["parent_pid"], got[3]["path"], got[3]["process_name"]) == (7, 9, "/bin/x", "")
    assert (got[4]["parent_pid"], got[4]["user"]) == (None, "u")
    assert [got[i]["source"] for i in (9, 10)] == ["word", "unknown"]


def test_windows_paths_with_spaces(spark, lines):
    line = ("2024-01-05 10:00:00 EventID=4688 New Process Name: C:\\Program Files\\Big App\\run it.exe Token Elevation Type: %%1936 "
            "Creator Process ID: 0x1 Creator Process Name: C:\\Windows\\explorer.exe Process Command Line: run it: now")
    net_line = ("2024-01-05 10:00:00 EventID=5156 Application Name: C:\\Program Files\\Big App\\run it.exe Direction: Out "
                "Source Address: 10.0.0.1 Source Port: 5 Dest Address: 8.8.8.8 Dest Port: 53 Protocol: 17")
    a, b = extract.parse_events(lines([("f", 1, line), ("f", 2, net_line)])).orderBy("line_number").collect()
    assert (a["process_name"], a["path"], a["command_line"]) == ("run it.exe", "C:\\Program Files\\Big App\\run it.exe", "run it: now")
    assert (b["process_name"], b["protocol"], b["dest_port"], b["status"]) == ("run it.exe", "UDP", 53, "Allowed")


def test_packet_fields(spark, lines):
    rows = ["2024-03-20 10:15:02.000 192.168.1.200:54321 -> 10.0.0.51:80 [FIN,PSH,URG] Seq=1000 Win=0 Len=15",
            "2024-03-20 10:15:03.000 192.168.1.200:54322 -> 10.0.0.51:443 flags: none Seq=2000 Win=0 Len=0",
            "2024-03-20 10:15:06.000 192.168.1.100:12352 -> 10.0.0.52:443 fragment offset=1400 overlap Seq=5000 Win=1024 Len=1500",
            "2024-03-20 10:15:08.000 192.168.1.100:12354 -> 10.0.0.52:0 ICMP type 15 code 99 Len=100",
            "2024-03-20 10:15:11.000 192.168.1.100:12357 -> 10.0.0.53:1433 Payload: SELECT * FROM users WHERE 1=1; Len=30", "no packet"]
    got = extract.parse_packets(lines([("f", i, r) for i, r in enumerate(rows)])).orderBy("line_number").collect()
    assert [(r["protocol"], r["flags"], r["fragment_offset"], r["payload"]) for r in got] == [
        ("TCP", "FIN,PSH,URG", None, None), ("TCP", "none", None, None), ("TCP", None, 1400, None), ("ICMP", None, None, None),
        ("TCP", None, None, "SELECT * FROM users WHERE 1=1;")]


def test_networks_of_any_table(spark):
    rows = [("a", *net.cidr_bounds("10.0.0.0/7")), ("b", *net.cidr_bounds("10.1.0.0/16")), ("c", *net.cidr_bounds("0.0.0.0/0"))]
    networks = spark.createDataFrame(rows, "network string, lo bigint, hi bigint")
    ips = spark.createDataFrame([("11.5.0.1",), ("10.1.2.3",), ("x",)], "ip string")
    got = sorted((r["ip"], r["network"]) for r in lookups.with_network_of_table(ips, "ip", networks).collect() if r["network"])
    assert got == [("10.1.2.3", "a"), ("10.1.2.3", "b"), ("10.1.2.3", "c"), ("11.5.0.1", "a"), ("11.5.0.1", "c")]
    assert reference.cidrs(spark).count() == 5


def test_globs():
    assert ev.SSH_LOGIN.startswith("(?sd)")
