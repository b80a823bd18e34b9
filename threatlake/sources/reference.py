"""Catalogue and baseline as small DataFrames.

All of them are built from constants, so their size is fixed and they may be
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake import catalog
from threatlake.catalog import Rule
from threatlake.functions import net


def _literal(value) -> Column:
    if isinstance(value, (tuple, list)):
        return F.array(*[_literal(v) for v in value])
    return F.lit(value)


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Constant rows as a DataFrame the optimizer can see into."""
    structs = F.array(*[F.struct(*[_literal(v) for v in row]) for row in rows])
    typed = structs.cast(f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(typed))


def rules(spark: SparkSession, *sets: tuple[Rule, ...]) -> DataFrame:
    chosen = sets or (catalog.ROOT_RULES, catalog.SCAN_RULES, catalog.THREAT_RULES)
    rows = [(r.rule_id, r.ruleset, r.description, r.category, r.severity, r.pattern, r.confidence,
             r.source, r.as_written_live) for group in chosen for r in group]
    return inline_table(spark, rows, "rule_id:int,ruleset:string,description:string,category:string,"
                        "severity:int,pattern:string,confidence:double,source:string,as_written_live:boolean")


def trusted_processes(spark: SparkSession) -> DataFrame:
    rows = [tuple(p) for p in catalog.TRUSTED_PROCESSES]
    return inline_table(spark, rows, "process_name:string,description:string,paths:array<string>,"
                        "users:array<string>,allowed_ports:array<int>,max_connections:int,base_trust:double")


def services(spark: SparkSession) -> DataFrame:
    """One row per (port, protocol); ports are unique."""
    rows = [(s.service, port, s.protocol, s.internal_only, s.per_minute_limit, s.risk_factor)
            for s in catalog.SERVICES for port in s.ports]
    return inline_table(spark, rows, "service:string,port:int,protocol:string,internal_only:boolean,"
                        "per_minute_limit:int,risk_factor:double")


def cidrs(spark: SparkSession, networks: tuple[str, ...] = catalog.BASELINE_NETWORKS) -> DataFrame:
    rows = [(n, *net.cidr_bounds(n)) for n in networks]
    return inline_table(spark, rows, "network:string,lo:bigint,hi:bigint")


def benign_rules(spark: SparkSession) -> DataFrame:
    rows = [tuple(r)[:5] for r in catalog.BENIGN_RULES]
    return inline_table(spark, rows, "description:string,pattern:string,max_freq:int,multiplier:double,"
                        "as_written_live:boolean")


def values(spark: SparkSession, name: str, items: tuple) -> DataFrame:
    kind = "int" if isinstance(items[0], int) else "string"
    return inline_table(spark, [(i,) for i in items], f"{name}:{kind}")
