"""Written outputs: findings (S13) and the rule catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake import catalog
from threatlake.operators import report
from threatlake.sources import reference


def write_findings(findings: DataFrame, path: str, kind: str = "parquet") -> None:
    """Findings with indicators, partitioned by severity."""
    kept = findings.filter(F.size("indicators") > 0)
    kept.write.partitionBy("severity").format(kind).save(path)


def write_report(findings: DataFrame, path: str) -> None:
    """The readable form: one text block per finding, as part files."""
    kept = findings.filter(F.size("indicators") > 0)
    kept.select(report.report_text(F.col("content"), F.col("severity"), F.col("indicators")).alias("value")
                ).write.text(path)


def exported_rules(spark: SparkSession, rules: tuple = catalog.SCAN_RULES) -> DataFrame:
    """The exported fields of a rule set, patterns as published, so that a reader of them finds the same lines."""
    rows = [(r.text, r.description, r.severity, r.category) for r in rules]
    return reference.inline_table(spark, rows, "pattern:string,description:string,severity:int,category:string")


def export_rules(spark: SparkSession, path: str, rules: tuple = catalog.SCAN_RULES) -> None:
    exported_rules(spark, rules).coalesce(1).write.json(path)
