"""Searching lines and findings (Q1-Q9)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.functions import times
from threatlake.functions.text import is_plain_ascii
from threatlake.operators.matching import check_pattern
from threatlake.sources.logs import strip


@dataclass(frozen=True)
class Criteria:
    """What to look for; `start` and `end` are inclusive and may be open."""

    pattern: str
    use_regex: bool = False
    case_sensitive: bool = False
    start: datetime | str | None = None
    end: datetime | str | None = None
    default_year: int | None = None

    def __post_init__(self):
        if self.use_regex:
            check_pattern(self.pattern)


def contains_text(text: Column, criteria: Criteria) -> Column:
    if criteria.use_regex:
        case = "" if criteria.case_sensitive else "i"
        return F.when(is_plain_ascii(text), text.rlike(f"(?{case}ud){criteria.pattern}")).otherwise(
            text.rlike(f"(?{case}Ud){criteria.pattern}"))
    if criteria.case_sensitive:
        return text.contains(criteria.pattern)
    return F.lower(text).contains(criteria.pattern.lower())


def in_time_range(found: Column, criteria: Criteria) -> Column:
    """Lines without a readable timestamp pass (Q4)."""
    cond = F.lit(True)
    if criteria.start is not None:
        cond = cond & (found >= times.as_timestamp_literal(criteria.start))
    if criteria.end is not None:
        cond = cond & (found <= times.as_timestamp_literal(criteria.end))
    return F.coalesce(cond, F.lit(True))


def search(lines: DataFrame, criteria: Criteria | str, column: str = "line") -> DataFrame:
    """Lines that match; blank lines never do (Q1-Q5)."""
    if isinstance(criteria, str):
        criteria = Criteria(criteria)
    line = F.col(column)
    out = lines.filter(contains_text(line, criteria) & (strip(line) != ""))
    if criteria.start is not None or criteria.end is not None:
        timed = times.with_found_time(out, column, "_found", criteria.default_year)
        out = timed.filter(in_time_range(F.col("_found"), criteria)).drop("_found")
    return out


def search_findings(findings: DataFrame, criteria: Criteria | str) -> DataFrame:
    """Findings whose JSON text matches, or whose only column if that is text (Q6)."""
    if isinstance(criteria, str):
        criteria = Criteria(criteria)
    fields = findings.schema.fields
    if len(fields) == 1 and fields[0].dataType.typeName() == "string":
        return findings.filter(contains_text(F.col(fields[0].name), criteria))
    return findings.filter(contains_text(F.to_json(F.struct("*")), criteria))


def with_indicator_text(findings: DataFrame, term: str) -> DataFrame:
    """Findings with the term in an indicator description (Q7)."""
    joined = F.lower(F.array_join(F.col("indicators")["description"], "\n"))
    return findings.filter(joined.contains(term.lower()))


def filter_findings(findings: DataFrame, least: int = 1, category: str = "ALL") -> DataFrame:
    """By the finding's severity, at least 1, and by indicator category (Q8)."""
    out = findings.filter(F.col("severity") >= max(1, least))
    return out if category == "ALL" else out.filter(
        F.array_contains(F.col("indicators")["category"], category))


def filter_by_indicator(findings: DataFrame, least: int = 0, category: str = "ALL") -> DataFrame:
    """By the highest indicator severity, 0 without indicators (Q9)."""
    top = F.coalesce(F.array_max(F.col("indicators")["severity"]), F.lit(0))
    out = findings.filter(top >= least)
    return out if category == "ALL" else out.filter(
        F.array_contains(F.col("indicators")["category"], category))
