"""Steps that grew faster than their input: each is held to its shape, and its results to the plain form."""

from pyspark.sql import functions as F

from threatlake import session
from threatlake.functions import net
from threatlake.operators import extract, matching, rule_tables, triage
from threatlake.plans import scan
from threatlake.sources import json_arrays, logs
from threatlake.streaming import streams


def text_stream(spark, folder, rows, name="a.log"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(rows) + "\n")
    return streams.read_text_stream(streams.own_session(spark), str(folder))


def ssh(clock, user="u"):
    return f"Jan 02 {clock} h sshd[1]: Failed password for {user} from 45.1.1.1 port 4000 ssh2"


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_events_are_parsed_once_and_spread(spark, tmp_path):
    from checks import streams as queries
    from checks.tables import Tables
    lines = text_stream(spark, tmp_path / "in", [ssh("03:00:00"), "plain", ssh("03:00:01")])
    events, feed = streams.landed_events(lines, 2024)
    assert "rlike" not in plan(events).lower() and "regexp" not in plan(events).lower()
    assert streams.run_available(events.select("line_number"), "first").count() == 2
    text_stream(spark, tmp_path / "in", [ssh("03:00:02")], "b.log")
    feed()
    assert streams.run_available(events.select("line_number"), "second").count() == 3
    spark.range(10).selectExpr("id event_id", "current_timestamp() ts", "id user_id", "'a' event_type", "1.0D value", "'' props").coalesce(
        1).write.parquet(str(tmp_path / "t" / "events.parquet"))
    rows = queries.derived_stream(Tables(spark, str(tmp_path / "t")))
    assert "Repartition" in plan(rows)


def test_deviation_joins_on_the_hour(spark, tmp_path):
    lines = text_stream(spark, tmp_path / "in", [ssh("03:00:00")])
    assert "this_hour" in plan(streams.stream_deviation(streams.events(lines, 2024)))


def test_process_seconds_of_the_stretch_before_are_found(spark, tmp_path):
    def process(clock):
        return f'{{"@timestamp":"2024-01-01 {clock}","process_name":"a.exe","pid":1,"username":"u","cmdline":"x"}}'

    network = ("2024-01-01 00:10:00 EventID=5156 Application Name: C:\\a.exe Source Address: 10.0.0.1 Source Port: 1 "
               "Dest Address: 10.0.0.2 Dest Port: 80 Protocol: 6")
    times = ["00:04:59", "00:05:00", "00:09:59", "00:10:00", "00:10:01", "00:04:59"]
    lines, close = streams.closable(text_stream(spark, tmp_path / "in", [network, *map(process, times)]))
    joined = streams.network_with_process(streams.events(lines, 2024))
    assert "p_stretch" in plan(joined)
    found = streams.run_available(joined, "near", close=close).collect()
    assert sorted(r.second.strftime("%H:%M:%S") for r in found) == ["00:05:00", "00:09:59", "00:10:00"]


def test_small_splits_share_a_task(spark, tmp_path):
    folder = tmp_path / "in"
    for i in range(40):
        text_stream(spark, folder, [f"{i} {j} " + "x" * 50 for j in range(40)], f"{i}.log")
    own = streams.own_session(spark)
    for name in ("maxPartitionBytes", "openCostInBytes"):
        own.conf.set(f"spark.sql.files.{name}", "500")
    apart, shared = (streams.run_available(streams.read_text_stream(own, str(folder), most_tasks=n), "s") for n in (None, 3))
    assert len(shared.inputFiles()) <= 3 < len(apart.inputFiles())
    assert shared.count() == 1600 and not shared.exceptAll(apart).count()


def test_numbers_of_lines_whose_splits_share_a_task(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"{i}.log").write_text("\n".join(f"{i} {j} " + "x" * 50 for j in range(1, 41)) + "\n")
    own = spark.newSession()
    for name in ("maxPartitionBytes", "openCostInBytes"):
        own.conf.set(f"spark.sql.files.{name}", "500")
    apart, shared = (logs.read_text(own, str(tmp_path), most_tasks=n) for n in (None, 3))
    assert shared.rdd.getNumPartitions() <= 3 < apart.rdd.getNumPartitions()
    assert shared.filter("line not like concat('% ', line_number, ' %')").isEmpty()
    assert not shared.exceptAll(apart).count() and shared.count() == 800


def test_a_long_rule_table_is_not_read_by_the_client(spark, monkeypatch):
    lines = spark.range(400).selectExpr("'f' source_file", "id line_number", "concat('abc ', id, ' é tail ', id % 7) line")
    rules = spark.range(3000).selectExpr("id rule_id", "concat('c ', id, ' . tail|ail ', id, '$') pattern").unionByName(
        spark.sql("select 9999 rule_id, '9{2}' pattern"))
    short = sorted(map(tuple, rule_tables.table_hits(lines, rules).collect()))

    def refuse(*_):
        raise AssertionError("the whole table at once")

    monkeypatch.setattr(rule_tables, "_automaton", refuse)
    found = rule_tables.table_hits(lines, rules, pass_bytes=1000)
    assert sorted(map(tuple, found.collect())) == short and len(short) > 700


def test_arrays_whose_splits_share_a_task(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"{i}.json").write_text("[" + ", ".join(f'{{"a":{j},"b":"x}}{i}"}}' for j in range(60)) + "]")
    own = spark.newSession()
    for name in ("maxPartitionBytes", "openCostInBytes"):
        own.conf.set(f"spark.sql.files.{name}", "200")
    apart, shared = (json_arrays.read_json_arrays(own, str(tmp_path), most_tasks=n) for n in (None, 3))
    assert shared.count() == 720 and not shared.exceptAll(apart).count()
    assert json_arrays._pieces(own, str(tmp_path), 3).rdd.getNumPartitions() <= 3


def test_verdict_text_is_split_once(spark):
    rows = spark.createDataFrame([("A: 1\nB: 2\nmore\nA: 3",), ("",), (None,)], "text string")
    parsed = rows.select(triage.parse_verdict(F.col("text")).alias("v"))
    assert plan(parsed).count("split(") == 1
    assert [r.v for r in parsed.collect()] == [{"B": "2\nmore", "A": "3"}, {}, None]


def test_verdicts_meet_without_a_join(spark, lines):
    rows = [ssh("03:00:00"), "Failed ssh login for root from 45.67.89.123", "plain",
            "2024-01-01 03:00:00 EventID=4688 New Process Name: C:\\temp\\evil.exe Creator Process Name: C:\\a.exe "
            "Process Command Line: mimikatz"]
    raw = lines([("a", n, row) for n, row in enumerate(rows, 1)])
    parsed = session.land(matching.best_rule(extract.parse_events(raw, 2024)), "parsed")
    scored = session.land(scan.score_events(parsed), "scored")
    found = scan.choose_verdicts(parsed, scored)
    assert "Join" not in plan(found)
    sources = {r.line_number: r.verdict_source for r in found.collect()}
    dynamic = {r.line_number for r in scan.dynamic_findings(scored).collect()}
    ruled = {r.line_number for r in parsed.filter("rule is not null").collect()}
    assert set(sources) == dynamic | ruled and {2, 4} <= set(sources) and 3 not in sources
    assert sources[2] == "rule" and sources[4] == "dynamic"


def test_rules_and_parsers_stand_in_projections(spark, lines):
    found = matching.best_rule(extract.parse_events(lines([("a", 1, "plain")]), 2024))
    generators = [row for row in plan(found).splitlines() if "Generate" in row]
    assert generators and not any("CASE" in row for row in generators)


def test_address_steps_carry_other_columns_as_one_value(spark):
    rows = spark.createDataFrame([("a", 1, "10.0.0.1", "x", None), ("a", 2, "::1", None, 5), ("a", 3, None, "z", 6)],
                                 "source_file string, line_number bigint, ip string, line string, n int")
    found = net.with_location(rows, "ip", "location")
    assert found.columns == [*rows.columns, "location"]
    steps = [row for row in plan(found).splitlines() if "_digits" in row]
    assert steps and not any(" line#" in row.split("_rest")[0] for row in steps[1:])
    got = {tuple(r) for r in found.collect()}
    assert got == {("a", 1, "10.0.0.1", "x", None, "internal"), ("a", 2, "::1", None, 5, "localhost"), ("a", 3, None, "z", 6, None)}


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def events_table(spark, tmp_path, rows=1200):
    from checks.tables import Tables
    spark.range(rows).selectExpr("id event_id", "current_timestamp() ts", "id % 50 user_id", "'a' event_type", "1.0D value", "'' props").coalesce(
        1).write.parquet(str(tmp_path / "t" / "events.parquet"))
    return Tables(spark, str(tmp_path / "t"))


def test_lines_are_made_after_the_deal_and_in_order(spark, tmp_path, monkeypatch):
    from checks import load, registry
    from threatlake.operators import running
    load()
    t = events_table(spark, tmp_path)
    text = optimized(t.derived)
    assert text.index("EventID=4688") < text.index("RepartitionByExpression")
    monkeypatch.setattr(running, "_within_blocks", None)
    assert registry.QUERIES["w1_raw_context"](spark, t.sf_dir).count() > 0


def test_wide_events_are_not_sorted_for_their_scores(lines):
    events = matching.best_rule(extract.parse_events(lines([("a", 1, ssh("03:00:00"))]), 2024))
    physical = scan.with_dynamics(events)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("ShuffledHashJoin") == 2


def test_packet_fields_share_one_regex_run(lines):
    rows = lines([("a", 1, "2024-01-01 00:00:01.5 10.0.0.1:5 -> 10.0.0.2:80 [ACK] Seq=7 Win=1 Len=9"), ("a", 2, "x -> y")])
    packets = extract.parse_packets(rows)
    assert optimized(packets).count("regexp_replace(line") == 1
    found = packets.collect()
    assert [(r.line_number, r.source_ip, r.dest_port, r.seq, r.length) for r in found] == [(1, "10.0.0.1", 80, 7, 9)]


def test_event_formats_run_one_regex_each(lines):
    parsed = extract.parse_events(lines([("a", 1, ssh("03:00:00"))]), 2024)
    assert optimized(parsed).count("regexp_replace(line") == 3
    assert parsed.first().kind == "NETWORK"


def test_other_forms_of_lines_need_neither_the_lines_nor_a_join(spark, tmp_path):
    from checks import aggregates
    t = events_table(spark, tmp_path)
    assert "EventID" not in optimized(t.places)
    text = optimized(aggregates.packet_events(t))
    assert "Join" not in text and "EventID" not in text


def test_folders_are_listed_twice_for_all_types(spark, tmp_path):
    for name in ("a.PCAP", "b.pcapng", "c.log", "d"):
        (tmp_path / name).write_text(name + " one\n" + name + " two\n")
    (tmp_path / "e.JSON").write_text('[{"a":1},{"a":2}]')
    found = logs.read_logs(spark, str(tmp_path))
    # The scan of lines stands in the plan twice, once for its splits.
    assert plan(found).count("Relation [") == 3
    rows = [(r.source_file.rsplit("/", 1)[1], r.line_number, r.log_type) for r in found.collect()]
    assert sorted(rows) == sorted((name, n, kind) for name, kind in (
        ("a.PCAP", "wireshark"), ("b.pcapng", "wireshark"), ("c.log", "generic"), ("d", "generic"), ("e.JSON", "volatility_json")) for n in (1, 2))


def test_alarm_lines_read_the_table_once(spark, tmp_path):
    from checks import streams as queries
    rows = queries.alarm_lines(queries.derived_stream(events_table(spark, tmp_path)))
    assert plan(rows).count("Repartition") == 1


def test_json_fields_are_read_in_one_pass(lines):
    rows = [f'{{"timestamp":{t},"src_ip":"10.0.0.1","dst_ip":"10.0.0.2","dst_port":{port},"protocol":"tcp","bytes":{sent}}}'
            for t, port, sent in (('"2024-01-01 00:00:00"', "80.5", "8e1"), ("1704067200", '"80"', "null"), ('"x"', "true", "7"), ("null", "[80]", "7"))]
    parsed = extract.parse_events(lines([("a", n, row) for n, row in enumerate(rows, 1)]), 2024)
    assert optimized(parsed).count("variant_get(") < 50
    found = [(r.kind, r.event_time and str(r.event_time), r.dest_port, r.bytes_transferred) for r in parsed.orderBy("line_number").collect()]
    day = "2024-01-01 00:00:00"
    assert found == [("NETWORK", day, 80, 80), ("NETWORK", day, 80, 0), ("NETWORK", None, 1, 7), ("GENERIC", None, None, None)]


def test_literals_of_rules_are_searched_once(lines):
    from threatlake import catalog
    literals = {hint for rule in catalog.ROOT_RULES for hint in rule.hints}
    raw = lines([("a", 1, "Failed ssh login for root from 45.67.89.123")])
    assert optimized(matching.best_rule(raw)).lower().count("contains(") == len(literals)


def test_lines_are_cleaned_once(lines):
    raw = lines([("a", n, row) for n, row in enumerate(("", " \x00 ", "\x00", " a\x00b ", None), 1)])
    cleaned = logs.clean_lines(raw)
    assert optimized(cleaned).count("replace(") == 1
    assert [(r.line_number, r.line) for r in cleaned.collect()] == [(4, "ab")]


def test_address_steps_are_few_and_shared(spark):
    rows = spark.createDataFrame([("1.1.1.1", "::ffff:10.0.0.1"), ("FE80::1%eth0", "1::2::3")], "a string, b string")
    found = net.with_locations(rows, {"a": "x", "b": "y"})
    assert plan(found).count("Project [") <= 3
    assert {tuple(r) for r in found.collect()} == {("1.1.1.1", "::ffff:10.0.0.1", "external", "internal"), ("FE80::1%eth0", "1::2::3", "internal", "unknown")}


def test_related_events_are_ranked_once(lines):
    from threatlake.operators import running
    events = extract.parse_events(lines([("a", n, ssh(f"03:0{n}:00")) for n in range(1, 9)]), 2024)
    found = running.earliest_correlated(events)
    # The ranks along a key and the rows of one time are landed: only the places per event are left to rank.
    assert plan(found).count("Window [") == 1
    shown = {(r.line_number, r.position): r.related_time.strftime("%M") for r in found.collect()}
    assert [shown[8, p] for p in range(1, 6)] == ["03", "04", "05", "06", "07"] and (1, 2) not in shown


def test_small_splits_hold_for_the_text_only(spark, tmp_path, monkeypatch):
    from checks import load, registry
    load()
    t, name, sizes = events_table(spark, tmp_path), "spark.sql.files.maxPartitionBytes", {}

    def watched(step):
        def call(df, label, *rest, **more):
            sizes[label] = df.sparkSession.conf.get(name)
            return step(df, label, *rest, **more)
        return call

    monkeypatch.setattr(session, "land", watched(session.land))
    monkeypatch.setattr(streams, "run_available", watched(streams.run_available))
    found = [registry.QUERIES[query](spark, t.sf_dir) for query in ("r1_stream_bundles", "w1_split_context")]
    usual = spark.conf.get(name)
    assert {df.sparkSession.conf.get(name) for df in found} == {usual}
    assert sizes == {"r1b": "8k", "ruled": "16k"} | {label: usual for label in ("r1b-ordinals", "stretches", "tails", "wanted")}


def test_a_setting_is_put_back(spark):
    own = spark.newSession()
    for name in ("spark.sql.files.maxPartitionBytes", "threatlake.unknown"):
        before = own.conf.get(name, None)
        try:
            with session.setting(own, name, "7"):
                assert own.conf.get(name) == "7"
                raise KeyError
        except KeyError:
            assert own.conf.get(name, None) == before


def test_verdicts_do_not_pass_through_the_client(spark, tmp_path):
    from checks import load, registry
    load()
    findings = spark.createDataFrame([("a", n, 3) for n in (1, 2, 3)], "source_file string, line_number bigint, severity int")
    verdicts = spark.createDataFrame([("a", 1, "IS_FALSE_POSITIVE: true\nCONFIDENCE: 0.9"), ("a", 2, "CONFIDENCE: 0.9\nREVISED_SEVERITY: 5")],
                                     "source_file string, line_number bigint, text string")
    refined = triage.refine(findings, verdicts)
    assert "Broadcast" not in refined._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.line_number, r.revised_severity, r.judged) for r in refined.collect()) == [(2, 5, True), (3, 3, False)]
    bundles = registry.QUERIES["r1_stream_bundles"](spark, events_table(spark, tmp_path).sf_dir)
    assert optimized(bundles).count("strategy=merge") == 2
