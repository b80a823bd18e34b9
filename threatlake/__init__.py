"""Security-log analytics on Spark: DataFrame in, DataFrame out, batch and streaming."""

from threatlake.operators.matching import file_findings
from threatlake.operators.report import summarize
from threatlake.operators.search import Criteria, search, search_findings
from threatlake.plans.scan import scan, score_events, stateless_findings
from threatlake.plans.scorer import assess_events
from threatlake.sources.logs import clean_lines, read_logs

__all__ = [
    "Criteria", "assess_events", "clean_lines", "file_findings", "read_logs", "scan", "score_events",
    "search", "search_findings", "stateless_findings", "summarize",
]
