"""Rules against lines (J1-J3), benign traffic (Q11), severity gates (Q10).

The theta join "every line x every rule" is unrolled: each rule becomes one
constant-pattern condition, so matching is a single map stage without a shuffle.
A literal gate in front of each regex rejects most lines by a byte search.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake import catalog, schemas
from threatlake.catalog import Rule
from threatlake.functions import text


def rule_condition(line: Column, rule: Rule, lowered: Column | None = None) -> Column:
    """Whether `line` matches `rule`.

    Lines with non-ASCII characters skip the literal gate: there, case folding
    in the regex knows more letters than `lower`, and classes such as white space
    more characters.
    """
    has_hint = text.has_any(F.lower(line) if lowered is None else lowered, rule.hints)
    return F.when(text.is_plain_ascii(line), _condition(line, rule, has_hint, text.regex)).otherwise(
        _condition(line, rule, has_hint, text.unicode_regex))


def _condition(line: Column, rule: Rule, has_hint: Column, form: Callable[[str], str]) -> Column:
    cond = line.rlike(form(rule.pattern))
    if rule.hints and form is text.regex:
        cond = has_hint & cond
    if rule.min_tokens:
        tokens = F.size(F.regexp_extract_all(line, F.lit(f"({catalog.SHORT_NUMBER})"), F.lit(1)))
        cond = cond | (tokens >= rule.min_tokens)
    return cond


def _indicator(kind: str | None, rule: Rule) -> Column:
    return F.struct(
        F.lit(kind or rule.description).alias("type"), F.lit(rule.category).alias("category"),
        F.lit(rule.description).alias("description"), F.lit(rule.severity).alias("severity"))


def best_first(rules: tuple[Rule, ...]) -> list[Rule]:
    """Highest severity first, catalogue order within a severity."""
    return sorted(rules, key=lambda r: -r.severity)


def best_rule(lines: DataFrame, rules: tuple[Rule, ...] = catalog.ROOT_RULES,
              out: str = "rule") -> DataFrame:
    """Adds the best matching rule as a struct, NULL when none matches.

    Conditions are tried in verdict order, so the first hit ends the search.
    """
    line, has_hint = F.col("line"), _hint_tests(rules)

    def first_hit(form: Callable[[str], str]) -> Column:
        hit = None
        for rule in best_first(rules):
            value = F.struct(
                F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.category).alias("category"),
                F.lit(rule.description).alias("description"), F.lit(rule.severity).alias("severity"),
                F.lit(rule.confidence).alias("confidence"))
            cond = _condition(line, rule, has_hint(rule), form)
            hit = F.when(cond, value) if hit is None else hit.when(cond, value)
        return hit

    kept = [name for name in lines.columns if name != out]
    staged = _with_hints(lines, "line", rules)
    return text.computed_once(staged, out, text.by_alphabet(line, first_hit)).select(*kept, out)


_BITS = 62


def _literals(rules: tuple) -> list[str]:
    return list(dict.fromkeys(hint for rule in rules for hint in rule.hints))


def _with_hints(lines: DataFrame, column: str, rules: tuple) -> DataFrame:
    """Adds `_hints0`, ...: which of all the rules' literals the lower-cased column holds, as bit masks.

    Rules share literals, and the rules of a catalogue are tried in turn: each literal is searched once.
    """
    low, words = F.lower(column), {}
    literals, zero = _literals(rules), F.lit(0).cast("bigint")
    for start in range(0, len(literals), _BITS):
        word = zero
        for bit, literal in enumerate(literals[start:start + _BITS]):
            word = word.bitwiseOR(F.when(low.contains(literal), F.lit(1 << bit).cast("bigint")).otherwise(zero))
        words[f"_hints{start // _BITS}"] = word
    return lines.withColumns(words)


def _hint_tests(rules: tuple) -> Callable[[NamedTuple], Column]:
    """Whether one of a rule's literals was found by `_with_hints`."""
    places = {literal: i for i, literal in enumerate(_literals(rules))}

    def test(rule: NamedTuple) -> Column:
        bits: dict[int, int] = {}
        for hint in rule.hints:
            word, bit = divmod(places[hint], _BITS)
            bits[word] = bits.get(word, 0) | 1 << bit
        cond = F.lit(not bits)
        for word, mask in bits.items():
            cond = cond | (F.col(f"_hints{word}").bitwiseAND(F.lit(mask).cast("bigint")) != 0)
        return cond

    return test


def _masks(line: Column, low: Column, rules: tuple[Rule, ...]) -> Column:
    """Matching rules as bit masks, `_BITS` rules per number."""
    words = []
    for start in range(0, len(rules), _BITS):
        word = F.lit(0).cast("bigint")
        for bit, rule in enumerate(rules[start:start + _BITS]):
            cond = rule_condition(line, rule, low)
            word = word + F.when(cond, F.lit(1 << bit).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        words.append(word)
    return F.array(*words)


def _bit(masks: Column, i: int) -> Column:
    return masks[i // _BITS].bitwiseAND(F.lit(1 << (i % _BITS)).cast("bigint")) != 0


def with_masks(lines: DataFrame, rules: tuple[Rule, ...], only_hits: bool) -> DataFrame:
    """Adds `_masks`; with `only_hits`, lines without a match are dropped."""
    staged = lines.withColumn("_low", F.lower("line"))
    staged = staged.withColumn("_masks", _masks(F.col("line"), F.col("_low"), rules)).drop("_low")
    if not only_hits:
        return staged
    return text.keep_where(staged, F.array_max("_masks") != 0)


def all_indicators(lines: DataFrame, rules: tuple[Rule, ...] = catalog.SCAN_RULES,
                   out: str = "indicators", only_hits: bool = False) -> DataFrame:
    """Adds every matching rule as an indicator, in catalogue order."""
    masks = F.col("_masks")
    pairs = [(_bit(masks, i), _indicator("PatternMatch", r)) for i, r in enumerate(rules)]
    staged = with_masks(lines, rules, only_hits)
    return staged.withColumn(out, text.collect_when(pairs, schemas.INDICATORS)).drop("_masks")


def file_findings(lines: DataFrame, rules: tuple[Rule, ...] = catalog.SCAN_RULES) -> DataFrame:
    """Plain file scan: lines with at least one indicator, severity = the highest."""
    staged = with_masks(lines, rules, only_hits=True)
    masks = F.col("_masks")
    severity, pairs = None, []
    for i, r in sorted(enumerate(rules), key=lambda e: -e[1].severity):
        severity = F.when(_bit(masks, i), r.severity) if severity is None else severity.when(
            _bit(masks, i), r.severity)
    for i, r in enumerate(rules):
        pairs.append((_bit(masks, i), _indicator("PatternMatch", r)))
    return staged.withColumns({
        "severity": severity, "indicators": text.collect_when(pairs, schemas.INDICATORS),
    }).drop("_masks").withColumnRenamed("line", "content")


def rule_hits(lines: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per (line, matching rule): rule_id and the line's own columns."""
    line, low = F.col("line"), F.col("_low")
    pairs = [(rule_condition(line, r, low), F.lit(r.rule_id)) for r in rules]
    staged = lines.withColumn("_low", F.lower(line))
    # Exploding the expression itself: for a column, a size filter would be inferred below it.
    return staged.withColumn("rule_id", F.explode(text.collect_when(pairs, "array<int>"))).drop("_low")


def rules_from_table(rules: DataFrame) -> tuple[Rule, ...]:
    """A user's rule table (rule_id, description, category, severity, pattern) as rules.

    A catalogue is configuration, like a pattern in the code: the client reads it
    whole and unrolls it, whatever its size.
    """
    rows = rules.orderBy("rule_id").collect()
    for row in rows:
        check_pattern(row["pattern"])
    return tuple(Rule(r["rule_id"], "user", r["description"], r["category"], r["severity"], r["pattern"])
                 for r in rows)


def merged_families(*families: dict[str, Rule]) -> list[tuple[str, Rule]]:
    """Union of rule families by key; a later family replaces equal keys."""
    if not families:
        keyed = list(zip(catalog.THREAT_KEYS, catalog.THREAT_RULES, strict=True))
        names = dict.fromkeys(rule.source for _, rule in keyed)
        families = tuple({k: r for k, r in keyed if r.source == name} for name in names)
    merged: dict[str, Rule] = {}
    for family in families:
        merged.update(family)
    return list(merged.items())


def check_pattern(pattern: str) -> None:
    """Raises ValueError for a pattern that the engine cannot run, before any job starts.

    The pattern is compiled by the engine itself: the optimizer folds this constant.
    """
    spark = SparkSession.active()
    try:
        spark.sql("SELECT '' RLIKE :pattern", args={"pattern": text.regex(pattern)}).collect()
    except PySparkException as error:
        raise ValueError(f"Invalid regex pattern: {pattern}") from error


def benign_longest_first() -> list[catalog.BenignRule]:
    """Benign rules in the order they are tried, which the catalogue states (T5)."""
    return sorted(catalog.BENIGN_RULES, key=lambda r: r.priority)


def benign_rule(lines: DataFrame, column: str = "line", out: str = "benign") -> DataFrame:
    """Adds the first matching benign rule (description, max_freq, multiplier) or NULL."""
    rules = tuple(benign_longest_first())
    has_hint = _hint_tests(rules)

    def first_hit(form: Callable[[str], str]) -> Column:
        hit = None
        for rule in rules:
            value = F.struct(F.lit(rule.description).alias("description"),
                             F.lit(rule.max_freq).alias("max_freq"),
                             F.lit(rule.multiplier).alias("multiplier"))
            cond = has_hint(rule) & F.col(column).rlike(form(rule.pattern))
            # Case folding beyond ASCII knows more letters than `lower`: no gate there.
            cond = cond if form is text.regex else F.col(column).rlike(form(rule.pattern))
            hit = F.when(cond, value) if hit is None else hit.when(cond, value)
        return hit

    kept = [name for name in lines.columns if name != out]
    staged = _with_hints(lines, column, rules)
    return text.computed_once(staged, out, text.by_alphabet(F.col(column), first_hit)).select(*kept, out)


def benign_verdict(frequency: Column, benign: Column) -> tuple[Column, Column]:
    """(multiplier, description) of a benign hit; high frequency raises both (Q11)."""
    over = frequency > benign["max_freq"]
    multiplier = F.when(benign.isNull(), 1.0).when(
        over, benign["multiplier"] * catalog.BENIGN_HIGH_FREQUENCY_FACTOR).otherwise(benign["multiplier"])
    description = F.when(over, F.concat(
        benign["description"], F.lit(" (High Frequency: "), frequency.cast("string"), F.lit(" > "),
        benign["max_freq"].cast("string"), F.lit(")"))).otherwise(benign["description"])
    return multiplier, description


def suppressed(benign: Column, multiplier: Column,
               threshold: float = catalog.BENIGN_SUPPRESS_BELOW) -> Column:
    return benign.isNotNull() & (multiplier < threshold)


def min_severity(findings: DataFrame, least: int) -> DataFrame:
    """Emit threshold on the severity; only findings with indicators (Q10)."""
    return findings.filter((F.col("severity") >= least) & (F.size("indicators") > 0))
