"""Risk scoring as column expressions.

Factors are multiplied in one fixed order, so equal inputs give bit-equal scores.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatlake import catalog, schemas
from threatlake.functions import text

STRINGS = "array<string>"


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _steps(value: Column, steps: tuple, top: float) -> Column:
    out = None
    for bound, factor in steps:
        cond = value <= bound
        out = F.when(cond, F.lit(factor)) if out is None else out.when(cond, F.lit(factor))
    return out.otherwise(F.lit(top))


# -- baseline scores --------------------------------------------------------------

def connection_risk(source_location: Column, dest_location: Column, service: Column,
                    service_risk: Column, internal_only: Column, time_factor: Column) -> Column:
    """Risk of a connection, 1.0 = baseline, floor 0.1."""
    inside = (source_location == "internal") & (dest_location == "internal")
    exposed = internal_only & (dest_location != "internal")
    by_service = F.when(service.isNull(), catalog.UNKNOWN_SERVICE_RISK).when(
        exposed, service_risk * catalog.INTERNAL_ONLY_PENALTY).otherwise(service_risk)
    direction = F.when((source_location == "external") & (dest_location == "internal"), 1.5).when(
        (source_location == "internal") & (dest_location == "external"), 1.1).otherwise(1.0)
    risk = F.when(inside, 0.3).otherwise(1.0) * by_service * direction * time_factor
    return F.greatest(F.lit(0.1), risk)


def connection_reasons(source_location: Column, dest_location: Column, service: Column,
                       service_risk: Column, internal_only: Column, time_factor: Column,
                       dest_port: Column, protocol: Column) -> Column:
    src, dst = source_location, dest_location
    port = F.coalesce(dest_port, F.lit(0)).cast("string")
    return text.collect_when([
        ((src == "internal") & (dst == "internal"), F.lit("Internal communication")),
        (service.isNotNull(), _join("Known service: ", service, " (Risk Factor: ",
                                    text.fixed(service_risk, 2), ")")),
        (service.isNotNull() & internal_only & (dst != "internal"),
         _join("WARN: Internal-only service '", service, "' accessed from ", dst)),
        (service.isNull(), _join("WARN: Connection on uncommon port ", port, "/", protocol)),
        ((src == "external") & (dst == "internal"), F.lit("External to internal connection")),
        ((src == "internal") & (dst == "external"), F.lit("Internal to external connection")),
        ((src == "external") & (dst == "external"), F.lit("External to external connection")),
        (time_factor != 1.0, _join("Time factor applied: ", text.fixed(time_factor, 2))),
    ], STRINGS)


def path_matches(path: Column, globs: tuple[str, ...]) -> Column:
    """Case-insensitive glob match; `*` is the only wildcard in the catalogue."""
    cond = F.lit(False)
    for glob in globs:
        if "*" in glob:
            escaped = "".join(".*" if ch == "*" else "\\Q" + ch + "\\E" for ch in glob.lower())
            cond = cond | F.lower(path).rlike("(?s)^" + escaped + "$")
        else:
            cond = cond | (F.lower(path) == glob.lower())
    return cond


def trust_score(base: Column, bad_path: Column, bad_user: Column, bad_ports: Column) -> Column:
    """Trust of a known process less its penalties, within 0 and 1.

    `base` is NULL for an unknown process.
    """
    def penalty(cond: Column, amount: float) -> Column:
        return F.when(cond, F.lit(amount)).otherwise(F.lit(0.0))

    total = (penalty(bad_path, catalog.PENALTY_PATH) + penalty(bad_user, catalog.PENALTY_USER)
             + penalty(bad_ports, catalog.PENALTY_PORTS))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - total))
    return F.when(base.isNull(), F.lit(catalog.UNKNOWN_PROCESS_TRUST)).otherwise(clamped)


def trust_reasons(base: Column, description: Column, path: Column, path_ok: Column, user: Column,
                  user_ok: Column, unexpected: Column) -> Column:
    """Reasons behind `trust_score`; a check that was not made is NULL."""
    ports = F.concat_ws(", ", F.array_sort(unexpected).cast("array<string>"))
    known = base.isNotNull()
    return text.collect_when([
        (~known, F.lit("Unknown process")),
        (known, _join("Known process: ", description, " (Base Trust: ", text.fixed(base, 2), ")")),
        (known & (path_ok == False), _join("PENALTY: Running from non-standard path: ", path)),  # noqa: E712
        (known & path_ok, F.lit("Path matches trusted definition.")),
        (known & (user_ok == False), _join("PENALTY: Running as unexpected user: ", user)),  # noqa: E712
        (known & user_ok, F.lit("User matches trusted definition.")),
        (known & (F.size(unexpected) > 0), _join("PENALTY: Using unexpected ports: {", ports, "}")),
        (known & unexpected.isNotNull() & (F.size(unexpected) == 0),
         F.lit("Ports match trusted definition.")),
    ], STRINGS)


def command_hits(command: Column) -> Column:
    """One boolean per command rule, in catalogue order."""
    given = F.coalesce(command, F.lit(""))
    return text.by_alphabet(given, lambda form: F.array(*[given.rlike(form(r.pattern)) for r in catalog.COMMAND_RULES]))


def command_risk(hits: Column) -> Column:
    """Highest matched weight; with several, plus a share of all but the last match."""
    rules = catalog.COMMAND_RULES
    zero = F.lit(0.0)
    total, count = zero, F.lit(0)
    for i, r in enumerate(rules):
        total = total + F.when(hits[i], r.weight).otherwise(zero)
        count = count + F.when(hits[i], 1).otherwise(0)
    last = top = None
    for i, r in reversed(list(enumerate(rules))):
        last = F.when(hits[i], r.weight) if last is None else last.when(hits[i], r.weight)
    for i, r in sorted(enumerate(rules), key=lambda e: -e[1].weight):
        top = F.when(hits[i], r.weight) if top is None else top.when(hits[i], r.weight)
    extra = (total - last) * catalog.COMMAND_EXTRA_SHARE
    several = F.least(F.lit(catalog.COMMAND_RISK_CAP), top + extra)
    return F.when(count == 0, 1.0).when(count == 1, top).otherwise(several)


def command_reasons(hits: Column) -> Column:
    return text.collect_when(
        [(hits[i], F.lit(r.description)) for i, r in enumerate(catalog.COMMAND_RULES)], STRINGS)


# -- dynamic factors ----------------------------------------------------------------

def correlation_factor(count: Column) -> Column:
    return _steps(count, catalog.CORRELATION_STEPS, catalog.CORRELATION_TOP)


def frequency_factor(kind: Column, source_location: Column, frequency: Column) -> Column:
    """1.0 to 3.0 by how often the key was seen; limits depend on kind and location (F8)."""
    factors = catalog.FREQUENCY_FACTORS

    def steps(limits: tuple[int, ...]) -> Column:
        return _steps(frequency, tuple(zip(limits, factors[:4], strict=True)), factors[4])

    return F.when(kind == schemas.PROCESS, steps(catalog.FREQUENCY_PROCESS)).when(
        source_location == "internal", steps(catalog.FREQUENCY_INTERNAL)).otherwise(
        steps(catalog.FREQUENCY_OTHER))


def _boost(factor: Column) -> Column:
    return F.when(factor > 1.01, factor).otherwise(F.lit(1.0))


def network_trust_multiplier(trust: Column) -> Column:
    return F.when(trust < 0.6, 1.0 + (1.0 - trust) * 1.5).when(
        trust < 0.8, 1.0 + (1.0 - trust) * 0.5).otherwise(1.0)


def network_unmitigated(connection: Column, multiplier: Column, correlation: Column,
                        frequency: Column, benign: Column) -> Column:
    return connection * multiplier * _boost(correlation) * _boost(frequency) * benign


def network_mitigates(connection: Column, trust: Column, unmitigated: Column) -> Column:
    return ((connection < 0.5) | (trust >= 0.9)) & (unmitigated > 1.0)


def network_risk(connection: Column, multiplier: Column, correlation: Column, frequency: Column,
                 benign: Column, unmitigated: Column, mitigates: Column) -> Column:
    """Combined risk of a network event after mitigation."""
    damped = 1.0 + (correlation - 1.0) * 0.1 + (frequency - 1.0) * 0.1
    base = connection * multiplier * benign
    mitigated = F.greatest(F.lit(0.5), F.least(base * damped, unmitigated * 0.3))
    return F.when(mitigates, mitigated).otherwise(unmitigated)


def network_mitigation_reason(connection: Column, trust: Column, unmitigated: Column) -> Column:
    return _join(
        "MITIGATION: Risk reduced from ", text.fixed(unmitigated, 2), " due to ",
        F.concat_ws(" ", F.when(trust >= 0.9, _join("high process trust (", text.fixed(trust, 2), ")")),
                    F.when(connection < 0.5, _join("low base connection risk (", text.fixed(connection, 2), ")"))),
        ".")


def process_trust_multiplier(trust: Column) -> Column:
    return 1.0 + (1.0 - trust) * (1.0 - trust) * 1.5


def process_unmitigated(multiplier: Column, command: Column, correlation: Column, frequency: Column,
                        time_factor: Column) -> Column:
    base = F.greatest(multiplier, command)
    return base * _boost(correlation) * _boost(frequency) * _boost(time_factor)


def process_mitigates(trust: Column, command: Column, unmitigated: Column) -> Column:
    return (trust >= 0.9) & (command < 2.5) & (unmitigated > 1.0)


def process_risk(command: Column, correlation: Column, frequency: Column, time_factor: Column,
                 unmitigated: Column, mitigates: Column) -> Column:
    """Combined risk of a process event after mitigation."""
    damped = (1.0 + (correlation - 1.0) * 0.05 + (frequency - 1.0) * 0.05 + (time_factor - 1.0) * 0.1)
    base = F.greatest(F.lit(1.0), command)
    mitigated = F.greatest(F.lit(0.5), F.least(base * damped, unmitigated * 0.25))
    return F.when(mitigates, mitigated).otherwise(unmitigated)


def process_mitigation_reason(trust: Column, command: Column, unmitigated: Column) -> Column:
    return _join("MITIGATION: Risk reduced from ", text.fixed(unmitigated, 2),
                 " due to high process trust (", text.fixed(trust, 2), ") and low/moderate cmd risk (",
                 text.fixed(command, 1), ").")


def severity(risk: Column, cutoffs: tuple[float, ...]) -> Column:
    """1 to 5 by exclusive upper bounds."""
    out = None
    for level, bound in enumerate(cutoffs, 1):
        cond = risk < bound
        out = F.when(cond, F.lit(level)) if out is None else out.when(cond, F.lit(level))
    return out.otherwise(F.lit(len(cutoffs) + 1))


def severity_band(level: Column) -> Column:
    """high, medium or low."""
    return F.when(level >= 4, "high").when(level >= 2, "medium").otherwise("low")


def deviation_score(baseline: Column, current: Column) -> Column:
    """Frequency against its baseline, 0 to 5."""
    deviation = (current - baseline) / baseline
    return F.when(F.coalesce(baseline, F.lit(0.0)) == 0.0, F.when(current > 10, 5.0).otherwise(0.0)).otherwise(
        _steps(deviation, catalog.DEVIATION_STEPS, catalog.DEVIATION_TOP))


# -- explanations -------------------------------------------------------------------

def indicators_of(reasons: Column, with_command: Column) -> Column:
    """Indicators from the first four reasons, mitigation notes left out."""
    # One step for each value that is used again: within a step it would be computed for each use.
    def head(reason: Column) -> Column:
        short = F.trim(F.substring_index(reason, "(", 1))
        return F.struct(F.replace(F.replace(short, F.lit("Boost"), F.lit("")), F.lit("Factor"), F.lit("")).alias("kind"), reason.alias("reason"))

    def named(x: Column) -> Column:
        return F.struct(F.when(x["kind"] == "", "Context").otherwise(x["kind"]).alias("kind"), x["reason"].alias("reason"))

    def one(x: Column) -> Column:
        kind = x["kind"]
        process = kind.contains("Process") | kind.contains("Trust") | (with_command & kind.contains("Command"))
        network = kind.contains("Connection") | kind.contains("Port") | kind.contains("Service")
        category = F.when(kind.contains("Pattern"), "BASELINE").when(process, "PROCESS").when(
            network, "NETWORK").otherwise("BEHAVIOR")
        return F.struct(kind.alias("type"), category.alias("category"), x["reason"].alias("description"),
                        F.lit(None).cast("int").alias("severity"))

    shown = F.filter(F.slice(reasons, 1, 4), lambda r: ~r.startswith("MITIGATION"))
    return F.transform(F.transform(F.transform(shown, head), named), one)


def factor(name: str, category: str, description: Column, score: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"),
                    description.alias("description"), score.cast("double").alias("score"),
                    F.lit(None).cast("map<string,string>").alias("context"))


def related_text(related: Column) -> Column:
    """Numbered lines of the first related events (position, type, related_time, details)."""
    def one(e: Column) -> Column:
        return _join(e["position"].cast("string"), ". ", e["type"], " at ",
                     F.date_format(e["related_time"], "yyyy-MM-dd HH:mm:ss"), " - Details: ", e["details"])
    return F.transform(related, one)


def context_text(head: list[Column], reasons: Column, correlated: Column, related: Column | None) -> Column:
    """Context of a dynamic finding."""
    listed = F.transform(reasons, lambda r: F.concat(F.lit("- "), r))
    empty = F.array().cast(STRINGS)
    tail = F.when(correlated > 0, F.array(F.lit(""), _join("Related Events (", correlated.cast("string"), "):")))
    parts = [F.array(*head), F.array(F.lit(""), F.lit("Analysis Reasons:")), listed, F.coalesce(tail, empty)]
    if related is not None:
        parts.append(F.coalesce(related_text(related), empty))
    return F.array_join(F.concat(*parts), "\n")


# -- the simple scorer ----------------------------------------------------------------

def simple_process_risk(name: Column, command: Column) -> Column:
    """0.2 for a benign name, else by name and arguments."""
    odd_name = F.when(text.matches(name, catalog.SUSPICIOUS_NAME), 2.0).otherwise(0.0)
    odd_args = F.when(text.matches(F.coalesce(command, F.lit("")), catalog.SUSPICIOUS_ARGS), 1.5).otherwise(0.0)
    return F.when(F.lower(name).isin(*catalog.BENIGN_PROCESSES), 0.2).otherwise(odd_name + odd_args)


def is_uncommon_port(port: Column, protocol: Column) -> Column:
    common = F.lit(False)
    for name, ports in catalog.COMMON_PORTS.items():
        common = common | ((F.lower(protocol) == name) & port.isin(*ports))
    return ~F.coalesce(common, F.lit(False))


def simple_network_risk(uncommon: Column, high_rate: Column, after_hours: Column) -> Column:
    """+1.0 uncommon port, +1.5 high rate, x1.2 outside business hours."""
    base = F.when(uncommon, 1.0).otherwise(0.0) + F.when(high_rate, 1.5).otherwise(0.0)
    return base * F.when(after_hours, catalog.TIME_WEIGHTS["after_hours"]).otherwise(1.0)


def simple_severity(total: Column) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(1), total.cast("int")))


def simple_confidence(total: Column) -> Column:
    return F.least(F.lit(1.0), total / 5.0)


def explanation(factors: Column) -> Column:
    """Text from factors with a positive score."""
    def one(f: Column) -> Column:
        notes = F.array_join(F.transform(
            F.map_entries(f["context"]), lambda kv: F.concat(kv["key"], F.lit(": "), kv["value"])), ", ")
        tail = F.when(F.coalesce(notes, F.lit("")) != "", F.concat(F.lit(" - "), notes)).otherwise("")
        return _join(f["category"], ": ", f["description"], " (Score: ", text.fixed(f["score"], 1), tail, ")")

    positive = F.filter(factors, lambda f: f["score"] > 0)
    joined = F.array_join(F.transform(positive, one), "\n")
    return F.when(joined != "", joined).otherwise("No significant risk factors identified.")


def suggested_actions(process: Column, name: Column, odd_args: Column, network: Column,
                      uncommon: Column, high_rate: Column, after_hours: Column, level: Column) -> Column:
    """F18; `process` / `network` are the factor scores, NULL when absent."""
    bad_process, bad_network = F.coalesce(process > 1.5, F.lit(False)), F.coalesce(network > 1.0, F.lit(False))
    actions = text.collect_when([
        (bad_process, _join("Investigate process ", name)),
        (bad_process & odd_args, F.lit("Review process command line arguments")),
        (bad_network & uncommon, F.lit("Review network connections on non-standard ports")),
        (bad_network & high_rate, F.lit("Investigate high-frequency connections")),
        (bad_network & after_hours, F.lit("Review after-hours network activity")),
        (level >= 4, F.lit("Escalate to security team for immediate review")),
        (level == 3, F.lit("Monitor system for additional suspicious activity")),
    ], STRINGS)
    return F.when(F.size(actions) > 0, actions).otherwise(F.array(F.lit("No immediate action required")))


# -- declared weights -------------------------------------------------------------------

def severity_multiplier(repeated: Column, several: Column, unusual_port: Column,
                        suspicious_process: Column, external: Column) -> Column:
    """Product of the declared multipliers that apply."""
    m = catalog.SEVERITY_MULTIPLIERS
    pairs = ((repeated, "repeated_events"), (several, "multiple_indicators"), (unusual_port, "unusual_port"),
             (suspicious_process, "suspicious_process"), (external, "external_connection"))
    out = F.lit(1.0)
    for cond, name in pairs:
        out = out * F.when(cond, F.lit(m[name])).otherwise(F.lit(1.0))
    return out
