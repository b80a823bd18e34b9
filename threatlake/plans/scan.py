"""The whole scan: raw lines to findings.

One map pass parses and rule-matches every line.  Frequency and correlation are
computed on narrow key columns and meet the wide events once, on the unique
(file, line).  The raw text is shuffled only for the preceding-lines context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake import catalog, schemas, session
from threatlake.functions import net, scoring, text, times
from threatlake.operators import extract, lookups, matching, running

LINE_KEY = ["source_file", "line_number"]


def _is_known() -> Column:
    return F.col("kind").isin(schemas.NETWORK, schemas.PROCESS)


def with_dynamics(events: DataFrame) -> DataFrame:
    """Network and process events with `frequency` and `correlated`.

    All events of the input count, whether or not they are suppressed later.
    """
    frequency = running.running_frequency(events)
    correlated = running.correlation_count(events)
    known = events.filter(_is_known())
    # Hash joins on the narrow sides, which have one row a line: the wide events are not sorted.
    joined = known.join(frequency.hint("shuffle_hash"), LINE_KEY, "left").join(correlated.hint("shuffle_hash"), LINE_KEY, "left")
    # An event without a time correlates with nothing.
    return joined.withColumn("correlated", F.coalesce("correlated", F.lit(0).cast("bigint")))


def score_events(events: DataFrame, suppress_below: float = catalog.BENIGN_SUPPRESS_BELOW) -> DataFrame:
    """Scores of network and process events, before any threshold.

    Benign network events stay in, flagged `suppressed`.
    """
    return score_known(with_dynamics(events), suppress_below)


def score_known(events: DataFrame, suppress_below: float = catalog.BENIGN_SUPPRESS_BELOW) -> DataFrame:
    """Scores of events that carry `frequency` and `correlated`; a map stage without a shuffle."""
    c = F.col
    is_net = c("kind") == schemas.NETWORK
    df = lookups.with_trust(lookups.with_service(lookups.with_trusted(events)))
    df = net.with_locations(df, {"source_ip": "source_location", "dest_ip": "dest_location"})
    df = df.withColumn("time_factor", times.time_multiplier(c("event_time")))
    df = matching.benign_rule(df.withColumn("_traffic", F.when(is_net, c("line"))), "_traffic").drop("_traffic")
    service = c("service")
    args = (c("source_location"), c("dest_location"), service["service"], service["risk_factor"],
            service["internal_only"], c("time_factor"))
    benign_factor, benign_text = matching.benign_verdict(c("frequency"), c("benign"))
    df = df.withColumns({
        "connection_risk": F.when(is_net, scoring.connection_risk(*args)),
        "connection_reasons": F.when(is_net, scoring.connection_reasons(
            *args, c("dest_port"), c("protocol"))),
        "benign_factor": benign_factor,
        "benign_text": benign_text,
        "correlation_factor": scoring.correlation_factor(c("correlated")),
        "frequency_factor": scoring.frequency_factor(c("kind"), c("source_location"), c("frequency")),
        "_hits": F.when(~is_net, scoring.command_hits(c("command_line"))),
        "trust_multiplier": F.when(is_net, scoring.network_trust_multiplier(c("trust"))).otherwise(
            scoring.process_trust_multiplier(c("trust"))),
    })
    df = df.withColumns({
        "suppressed": F.coalesce(matching.suppressed(c("benign"), c("benign_factor"), suppress_below), F.lit(False)),
        "command_risk": F.when(~is_net, scoring.command_risk(c("_hits"))),
        "command_reasons": F.when(~is_net, scoring.command_reasons(c("_hits"))),
    }).drop("_hits")
    df = df.withColumn("unmitigated_risk", F.when(is_net, scoring.network_unmitigated(
        c("connection_risk"), c("trust_multiplier"), c("correlation_factor"), c("frequency_factor"),
        c("benign_factor"))).otherwise(scoring.process_unmitigated(
            c("trust_multiplier"), c("command_risk"), c("correlation_factor"), c("frequency_factor"),
            c("time_factor"))))
    df = df.withColumn("mitigated", F.when(is_net, scoring.network_mitigates(
        c("connection_risk"), c("trust"), c("unmitigated_risk"))).otherwise(scoring.process_mitigates(
            c("trust"), c("command_risk"), c("unmitigated_risk"))))
    df = df.withColumn("risk", F.when(is_net, scoring.network_risk(
        c("connection_risk"), c("trust_multiplier"), c("correlation_factor"), c("frequency_factor"),
        c("benign_factor"), c("unmitigated_risk"), c("mitigated"))).otherwise(scoring.process_risk(
            c("command_risk"), c("correlation_factor"), c("frequency_factor"), c("time_factor"),
            c("unmitigated_risk"), c("mitigated"))))
    return df.withColumn("dynamic_severity", F.when(
        is_net, scoring.severity(c("risk"), catalog.NETWORK_CUTOFFS)).otherwise(
        scoring.severity(c("risk"), catalog.PROCESS_CUTOFFS)))


def _contributors(is_net: Column) -> Column:
    c = F.col
    empty = F.array().cast("array<string>")

    def note(cond: Column, *parts: Column | str) -> Column:
        value = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        return F.when(cond, F.array(value)).otherwise(empty)

    corr = note(c("correlation_factor") > 1.01, "Correlation Boost (x", text.fixed(c("correlation_factor"), 2), ")")
    freq = note(c("frequency_factor") > 1.01, "Frequency Boost (x", text.fixed(c("frequency_factor"), 2), ")")
    network = F.concat(
        c("connection_reasons"), F.when(c("trust") < 0.8, c("trust_reasons")).otherwise(empty), corr, freq,
        note(c("benign").isNotNull(), "Benign Pattern Risk Adjustment (x", text.fixed(c("benign_factor"), 2), ": ",
             c("benign_text"), ")"),
        note(c("mitigated"), c("mitigation_reason")))
    process = F.concat(
        c("trust_reasons"),
        F.when(c("command_risk") > 1.0, c("command_reasons")).otherwise(F.array(F.lit("Low command line risk."))),
        corr, freq,
        note(c("time_factor") > 1.01, "Off-Hours Execution (x", text.fixed(c("time_factor"), 2), ")"),
        note(c("mitigated"), c("mitigation_reason")))
    return F.when(is_net, network).otherwise(process)


def _risk_factors(is_net: Column) -> Column:
    c = F.col
    joined = F.concat_ws("; ", c("connection_reasons"))
    decision = F.concat(F.lit("Final Severity: "), c("dynamic_severity").cast("string"),
                        F.lit(" based on Calculated Risk: "), text.fixed(c("risk"), 2))
    f = scoring.factor
    no = F.lit(False)
    return text.collect_when([
        (F.lit(True), f("SeverityDecision", "SUMMARY", decision, c("dynamic_severity"))),
        (is_net, f("BaseConnectionRisk", "NETWORK", joined, c("connection_risk"))),
        (~is_net | (c("process_name") != ""),
         f("ProcessTrust", "PROCESS", F.concat_ws("; ", c("trust_reasons")), c("trust"))),
        (F.coalesce(c("command_risk") > 1.0, no),
         f("CommandLineRisk", "PROCESS", F.concat_ws("; ", c("command_reasons")), c("command_risk"))),
        (c("correlation_factor") > 1.01, f("CorrelationFactor", "BEHAVIOR", F.concat(
            c("correlated").cast("string"), F.lit(" correlated events")), c("correlation_factor"))),
        (c("frequency_factor") > 1.01, f("FrequencyFactor", "BEHAVIOR", F.concat(
            F.lit("Event frequency: "), c("frequency").cast("string")), c("frequency_factor"))),
        (~is_net & (c("time_factor") > 1.01),
         f("TimeContextFactor", "BEHAVIOR", F.lit("Execution time factor"), c("time_factor"))),
        (is_net & c("benign").isNotNull(), f("BenignPatternMatch", "BASELINE", c("benign_text"), c("benign_factor"))),
        (c("mitigated"), f("RiskMitigation", "BASELINE", c("mitigation_reason"), F.lit(0.0))),
    ], schemas.RISK_FACTORS)


def _heads(is_net: Column) -> Column:
    c = F.col

    def row(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])

    risk = text.fixed(c("risk"), 2)
    network = F.array(
        row("Network Event Analysis (Severity: ", c("dynamic_severity"), ", Risk Score: ", risk, "):"),
        row("Source IP: ", c("source_ip"), " (", c("source_location"), ")"),
        row("Destination IP: ", c("dest_ip"), " (", c("dest_location"), ")"),
        row("Protocol: ", c("protocol")), row("Ports: ", c("source_port"), " -> ", c("dest_port")),
        row("Frequency: ", c("frequency"), " occurrences"))
    process = F.array(
        row("Process Event Analysis (Severity: ", c("dynamic_severity"), ", Risk Score: ", risk, "):"),
        row("Process: ", c("process_name")), row("PID: ", c("pid")), row("User: ", c("user")),
        row("Path: ", c("path")), row("Command Line: ", c("command_line")),
        row("Frequency: ", c("frequency"), " occurrences"))
    return F.when(is_net, network).otherwise(process)


def _with_reasons(scored: DataFrame, is_net: Column) -> DataFrame:
    c = F.col
    df = scored.withColumn("mitigation_reason", F.when(c("mitigated"), F.when(
        is_net, scoring.network_mitigation_reason(c("connection_risk"), c("trust"), c("unmitigated_risk"))).otherwise(
        scoring.process_mitigation_reason(c("trust"), c("command_risk"), c("unmitigated_risk")))))
    return df.withColumn("reasons", _contributors(is_net))


def _of_rule(rule: Column) -> tuple[Column, Column]:
    """Indicators and risk factors of a rule's verdict."""
    indicator = F.array(F.struct(
        F.lit("PatternMatch").alias("type"), rule["category"].alias("category"),
        rule["description"].alias("description"), rule["severity"].alias("severity"))).cast(schemas.INDICATORS)
    factor = F.array(F.struct(
        F.lit("PatternMatch").alias("name"), rule["category"].alias("category"),
        rule["description"].alias("description"), rule["severity"].cast("double").alias("score"),
        F.lit(None).cast("map<string,string>").alias("context"))).cast(schemas.RISK_FACTORS)
    return indicator, factor


def dynamic_findings(scored: DataFrame, least: int = 2, related: DataFrame | None = None) -> DataFrame:
    """Findings of scored events: indicators, risk factors and context.

    `related` (from `running.earliest_correlated`) adds the first correlated
    events to the context.
    """
    c = F.col
    is_net = c("kind") == schemas.NETWORK
    df = text.keep_where(scored, ~c("suppressed") & (c("dynamic_severity") >= least))
    df = _with_reasons(df, is_net)
    listed = None
    if related is not None:
        df = _with_related(df, related)
        listed = c("related")
    context = scoring.context_text([F.lit("")], c("reasons"), c("correlated"), listed)
    return df.select(
        *LINE_KEY, "line", "kind", "event_time", "risk", c("dynamic_severity").alias("severity"),
        c("correlated").alias("event_count"), "reasons",
        scoring.indicators_of(c("reasons"), ~is_net).alias("indicators"),
        _risk_factors(is_net).alias("risk_factors"),
        F.concat(F.array_join(_heads(is_net), "\n"), context).alias("context"))


def _with_related(events: DataFrame, related: DataFrame) -> DataFrame:
    # At most five short rows per event.
    rows = related.groupBy(*LINE_KEY).agg(F.array_sort(F.collect_list(
        F.struct("position", "type", "related_time", "details"))).alias("related"))
    return events.join(rows, LINE_KEY, "left")


def prefers_dynamic(dynamic_severity: Column, rule: Column) -> Column:
    """Whether the dynamic verdict wins over the rule verdict of the same line."""
    weak = rule["category"].isin("AUTH", "NETWORK", "BASELINE") & (rule["severity"] <= 2)
    return dynamic_severity.isNotNull() & (
        rule.isNull() | (dynamic_severity >= rule["severity"]) | weak)


def choose_verdicts(parsed: DataFrame, scored: DataFrame, least: int = 2, related: DataFrame | None = None,
                    before: DataFrame | None = None) -> DataFrame:
    """Rule and dynamic verdicts to one finding per line (J10); context may be NULL.

    `parsed` are all lines with their rule, `scored` those of them that `score_events` keeps.
    A scored row still has its line's rule, so the verdicts meet without a join and no text is
    shuffled.  `before` (from `running.preceding_lines`) gives rule findings their context;
    for `related` see `dynamic_findings`.
    """
    c = F.col
    is_net, rule = c("kind") == schemas.NETWORK, c("rule")
    indicator, factor = _of_rule(rule)
    raw = F.lit(None).cast("string")
    if before is not None:
        raw = running.raw_context(c("line_number"), F.coalesce("previous", F.array().cast("array<string>")))
        scored = scored.join(before, LINE_KEY, "left")
    context = scoring.context_text([F.lit("")], c("reasons"), c("correlated"), None)
    if related is not None:
        scored = _with_related(scored, related)
        context = scoring.context_text([F.lit("")], c("reasons"), c("correlated"), c("related"))
    found = F.when(~c("suppressed") & (c("dynamic_severity") >= least), c("dynamic_severity"))
    df = scored.withColumn("_dynamic", found)
    df = df.withColumn("_wins", prefers_dynamic(c("_dynamic"), rule))
    df = _with_reasons(text.keep_where(df, c("_wins") | rule.isNotNull()), is_net)
    wins = c("_wins")
    known = df.select(
        *LINE_KEY, c("line").alias("content"),
        F.when(wins, c("_dynamic")).otherwise(rule["severity"]).alias("severity"), F.when(wins, c("risk")).alias("risk"),
        F.when(wins, scoring.indicators_of(c("reasons"), ~is_net)).otherwise(indicator).alias("indicators"),
        F.when(wins, _risk_factors(is_net)).otherwise(factor).alias("risk_factors"),
        F.coalesce(F.when(wins, F.concat(F.array_join(_heads(is_net), "\n"), context)), raw).alias("context"), "event_time",
        F.when(wins, c("correlated")).otherwise(F.lit(1).cast("bigint")).alias("event_count"),
        F.when(wins, "dynamic").otherwise("rule").alias("verdict_source"))
    others = parsed.filter(~F.coalesce(_is_known(), F.lit(False)) & rule.isNotNull())
    if before is not None:
        others = others.join(before, LINE_KEY, "left")
    return known.unionByName(others.select(
        *LINE_KEY, c("line").alias("content"), rule["severity"].alias("severity"), F.lit(None).cast("double").alias("risk"),
        indicator.alias("indicators"), factor.alias("risk_factors"), raw.alias("context"), "event_time",
        F.lit(1).cast("bigint").alias("event_count"), F.lit("rule").alias("verdict_source")))


def stateless_findings(lines: DataFrame, default_year: int | None = None) -> DataFrame:
    """Findings from each line alone, with all their columns: rules, and scores of an event seen once.

    No shuffle and no state, so it also runs on a stream.
    """
    c = F.col
    one = F.lit(1).cast("bigint")
    parsed = matching.best_rule(extract.parse_events(lines, default_year))
    scored = score_known(parsed.withColumns({"frequency": one, "correlated": one}))
    known = _is_known() & ~c("suppressed") & (c("dynamic_severity") >= 2)
    scored = scored.withColumn("_dynamic", F.when(known, c("dynamic_severity")))
    wins = prefers_dynamic(c("_dynamic"), c("rule"))
    kept = text.keep_where(scored.withColumn("_wins", wins), c("_wins") | c("rule").isNotNull())
    is_net = c("kind") == schemas.NETWORK
    kept = _with_reasons(kept, is_net)
    indicator, factor = _of_rule(c("rule"))
    context = F.concat(F.array_join(_heads(is_net), "\n"), scoring.context_text([F.lit("")], c("reasons"), c("correlated"), None))
    return kept.select(
        *LINE_KEY, c("line").alias("content"), "event_time", "kind",
        F.when(c("_wins"), c("_dynamic")).otherwise(c("rule")["severity"]).alias("severity"),
        F.when(c("_wins"), c("risk")).alias("risk"),
        F.when(~c("_wins"), c("rule")["category"]).alias("category"),
        F.when(c("_wins"), scoring.indicators_of(c("reasons"), ~is_net)).otherwise(indicator).alias("indicators"),
        F.when(c("_wins"), _risk_factors(is_net)).otherwise(factor).alias("risk_factors"),
        F.when(c("_wins"), context).alias("context"), c("correlated").alias("event_count"),
        F.when(c("_wins"), "dynamic").otherwise("rule").alias("verdict_source"))


def scan(lines: DataFrame, default_year: int | None = None, context: bool = False,
         related: bool = False, land: bool = True,
         suppress_below: float = catalog.BENIGN_SUPPRESS_BELOW) -> DataFrame:
    """raw_logs (cleaned) -> findings, severity 1 and up.

    With `land` the parsed lines are written once to the shared folder and the
    later steps read only the columns they need; without it each step parses
    again.  `context` adds the preceding lines to rule findings, `related` the
    first correlated events to dynamic ones.
    """
    parsed = matching.best_rule(extract.parse_events(running.keyed_rows(lines), default_year))
    if land:
        parsed = session.land(parsed, "parsed")
    scored = score_events(parsed, suppress_below)
    first = running.earliest_correlated(parsed) if related else None
    before = None
    if context:
        before = running.preceding_lines(
            parsed.select(*LINE_KEY, "line", F.col("rule").isNotNull().alias("_ruled")), F.col("_ruled"))
        before = before.select(*LINE_KEY, "previous")
    return choose_verdicts(parsed, scored, related=first, before=before)
