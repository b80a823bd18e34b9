"""Reports over findings (A1-A7, T1, T2, T4, U5, W4, W5) and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlake import catalog
from threatlake.functions import text
from threatlake.operators import running


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))


def by_first_category(findings: DataFrame) -> DataFrame:
    """Findings per category of the first indicator (A2)."""
    first = F.try_element_at("indicators", F.lit(1))["category"]
    return findings.filter(F.size("indicators") > 0).groupBy(first.alias("category")).agg(
        F.count(F.lit(1)).alias("findings"))


def by_indicator_category(findings: DataFrame) -> DataFrame:
    """Indicators per category; each indicator counts (A3)."""
    exploded = findings.select(F.explode(F.col("indicators")["category"]).alias("category"))
    return exploded.groupBy("category").agg(F.count(F.lit(1)).alias("indicators"))


def by_risk_factor(findings: DataFrame) -> DataFrame:
    """Risk-factor frequency by category:name (A4)."""
    exploded = findings.select(F.explode("risk_factors").alias("f"))
    key = F.concat(F.col("f")["category"], F.lit(":"), F.col("f")["name"])
    return exploded.groupBy(key.alias("factor")).agg(F.count(F.lit(1)).alias("findings"))


def is_mitigated(risk_factors: Column) -> Column:
    return F.array_contains(risk_factors["name"], "RiskMitigation")


def mitigated_count(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(is_mitigated(F.col("risk_factors"))).alias("mitigated"))


def scan_totals(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Files scanned, findings with indicators, time of the last event."""
    files = lines.select("source_file").distinct().select(
        F.lit(1).alias("file"), F.lit(0).alias("threat"), F.lit(None).cast("timestamp_ntz").alias("time"))
    found = findings.select(
        F.lit(0).alias("file"), (F.size("indicators") > 0).cast("int").alias("threat"), F.col("event_time").alias("time"))
    return files.unionByName(found).agg(
        F.sum("file").alias("files_scanned"), F.sum("threat").alias("threats_found"),
        F.max("time").alias("last_event"))


def _top(counts: DataFrame, name: str, n: int = 5) -> DataFrame:
    return counts.orderBy(F.desc("findings"), name).limit(n)


def top_categories(findings: DataFrame, n: int = 5) -> DataFrame:
    return _top(by_first_category(findings), "category", n)


def top_risk_factors(findings: DataFrame, n: int = 5) -> DataFrame:
    """Top factors; mitigation is left out after taking the top."""
    top = _top(by_risk_factor(findings), "factor", n)
    return top.filter(~F.col("factor").contains("RiskMitigation"))


def examples(findings: DataFrame, levels: tuple[int, ...] = (5, 4), n: int = 3) -> DataFrame:
    """First findings of each high severity.

    The rank filter is also applied before the shuffle, so a severity that holds
    most findings sends only `n` rows per task.
    """
    order = Window.partitionBy("severity").orderBy("source_file", "line_number")
    ranked = findings.filter(F.col("severity").isin(*levels)).select(
        "severity", "source_file", "line_number", "content",
        F.row_number().over(order).alias("position"))
    line = F.concat(F.lit("- Sev "), F.col("severity").cast("string"), F.lit(": "),
                    F.left("content", F.lit(catalog.EXAMPLE_CONTENT_LENGTH)), F.lit("..."))
    return ranked.filter(F.col("position") <= n).select(
        "severity", "position", "source_file", "line_number", line.alias("example"))


# The recommendation texts.
HIGH = ("- **High Priority:** Investigate Severity 4 and 5 findings immediately. Focus on external "
        "sources, low-trust processes, and command-line anomalies mentioned in context.")
HIGH_ALSO = " Also prioritize external failed logins and high-risk commands."
HIGH_FACTORS = ("- **High Priority:** Investigate external failed logins and processes executing "
                "high-risk commands.")
MEDIUM = ("- **Medium Priority:** Review Severity 3 findings. These may indicate reconnaissance, moderate "
          "anomalies, or policy violations requiring monitoring or configuration checks.")
LOW = ("- **Low Priority:** Review Severity 1-2 findings, especially those marked as mitigated, to ensure "
       "baseline/whitelists are accurate and no threats were overly downgraded.")
NONE = ("- No high or medium priority threats detected based on current analysis. Consider reviewing "
        "baseline rules if unexpected low-severity findings occurred.")


def recommendations(counts: DataFrame) -> DataFrame:
    """Adds the recommendation texts to the row of totals."""
    c = F.col
    severe = (c("severity_5") > 0) | (c("severity_4") > 0)
    urgent = severe | c("urgent_factors")
    quiet = ~urgent & (c("severity_3") == 0)
    low = (c("mitigated") > 5) | ((c("mitigated") > 0) & quiet)
    return counts.withColumn("recommendations", F.array_join(text.collect_when([
        (severe & ~c("urgent_factors"), F.lit(HIGH)),
        (severe & c("urgent_factors"), F.lit(HIGH + HIGH_ALSO)),
        (~severe & c("urgent_factors"), F.lit(HIGH_FACTORS)),
        (c("severity_3") > 0, F.lit(MEDIUM)),
        (low, F.lit(LOW)),
        (~low & quiet, F.lit(NONE)),
    ], "array<string>"), "\n"))


def _counted(findings: DataFrame) -> DataFrame:
    """(section, key, findings): all that the summary counts, by one grouping of the findings.

    Section 0 has the totals, the others are numbered as in `summarize`.
    """
    factors = F.col("risk_factors")
    external = F.array_contains(factors["description"], "Failed authentication - external")
    command = F.exists(factors, lambda f: (f["name"] == "CommandLineRisk") & (f["score"] >= 4.0))
    first = F.try_element_at("indicators", F.lit(1))["category"]

    def entry(section: int, key: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), key.alias("key"))

    kind = "array<struct<section:int,key:string>>"
    listed = F.transform(factors, lambda f: entry(6, F.concat(f["category"], F.lit(":"), f["name"])))
    keys = F.concat(text.collect_when([
        (F.lit(True), entry(0, F.lit("total"))), (F.lit(True), entry(3, F.col("severity").cast("string"))),
        (is_mitigated(factors), entry(0, F.lit("mitigated"))), (external | command, entry(0, F.lit("urgent"))),
        (F.size("indicators") > 0, entry(5, first))], kind), F.coalesce(listed, F.array().cast(kind)))
    return findings.select(F.explode(keys).alias("k")).groupBy("k.section", "k.key").agg(F.count(F.lit(1)).alias("findings"))


def _ranked_row(counted: DataFrame, most: int = 5) -> DataFrame:
    """One row: the totals, and `rows`, the severities and the first keys of each section.

    Whether external logins failed is read from the risk factor's description.
    """
    c = F.col
    order = Window.partitionBy("section").orderBy(F.desc("findings"), "key")
    ranked = counted.withColumn("place", F.row_number().over(order)).filter((c("section") < 5) | (c("place") <= most))

    def total(section: int, key: str) -> Column:
        return F.coalesce(F.sum(F.when((c("section") == section) & (c("key") == key), c("findings"))), F.lit(0))

    return ranked.agg(
        total(0, "total").alias("total"), *[total(3, str(s)).alias(f"severity_{s}") for s in (5, 4, 3, 2, 1)],
        total(0, "mitigated").alias("mitigated"), (total(0, "urgent") > 0).alias("urgent_factors"),
        F.array_sort(F.collect_list(F.struct("section", "place", "key", "findings"))).alias("rows"))


def summarize(findings: DataFrame, name: str = "file") -> DataFrame:
    """Executive summary as rows (section, position, text), to be read in that order.

    All counts come from one grouping; only the examples, three lines of each high severity,
    are a second read.  What is gathered has a fixed size: totals, severities, five keys a section.
    """
    c = F.col
    one = recommendations(_ranked_row(_counted(findings)))

    def line(section: int, position: Column, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), position.cast("int").alias("position"), value.alias("text"))

    def said(before: str, x: Column, middle: str) -> Column:
        return F.concat(F.lit(before), x["key"], F.lit(middle), x["findings"].cast("string"), F.lit(" findings"))

    def section(number: int) -> Column:
        return F.filter("rows", lambda x: x["section"] == number)

    total = F.concat(F.lit(f"Executive Summary: Processed {name}. Found "), c("total").cast("string"),
                     F.lit(" notable findings (Severity >= 2)."))
    note = F.concat(F.lit("NOTE: "), c("mitigated").cast("string"), F.lit(
        " finding(s) had their risk score reduced due to baseline/whitelisting factors."))
    any_found, first = c("total") > 0, F.lit(1)
    factors = F.filter(section(6), lambda x: ~F.coalesce(x["key"].contains("RiskMitigation"), F.lit(False)))
    parts = F.concat(
        F.array(line(1, first, F.when(any_found, total).otherwise("No findings to summarize."))),
        text.collect_when([(c("mitigated") > 0, line(2, first, note)), (any_found, line(7, first, c("recommendations")))],
                          "array<struct<section:int,position:int,text:string>>"),
        F.transform(section(3), lambda x: line(3, 10 - x["key"].cast("int"), said("- Severity ", x, ": "))),
        F.transform(section(5), lambda x, i: line(5, i + 1, said("- ", x, ": "))),
        F.transform(factors, lambda x, i: line(6, i + 1, said("- ", x, ": Contributed to "))))
    shown = examples(findings).select(
        F.lit(4).alias("section"), ((10 - c("severity")) * 10 + c("position")).cast("int").alias("position"), c("example").alias("text"))
    return one.select(F.inline(parts)).unionByName(shown)


def page(findings: DataFrame, number: int, size: int = catalog.PAGE_SIZE, most: int | None = None) -> DataFrame:
    """One display page in file and line order (T4); a display may pass the `most` rows it shows."""
    start = (number - 1) * size
    length = size if most is None else max(0, min(size, most - start))
    return findings.orderBy("source_file", "line_number").offset(start).limit(length)


def next_page(findings: DataFrame, source_file: str | None = None, line_number: int = 0,
              size: int = catalog.PAGE_SIZE) -> DataFrame:
    """The page after a given finding; costs the same on every page (T4)."""
    later = findings
    if source_file is not None:
        file, line = F.col("source_file"), F.col("line_number")
        later = findings.filter((file > source_file) | ((file == source_file) & (line > line_number)))
    return later.orderBy("source_file", "line_number").limit(size)


def highest_first(findings: DataFrame) -> DataFrame:
    """Findings with indicators, highest severity first."""
    return findings.filter(F.size("indicators") > 0).orderBy(F.desc("severity"), "source_file", "line_number")


def categories(findings: DataFrame) -> DataFrame:
    """Distinct indicator categories, sorted."""
    return findings.select(F.explode(F.col("indicators")["category"]).alias("category")).distinct().orderBy("category")


def numbered(findings: DataFrame) -> DataFrame:
    """Adds the finding's ordinal within its file."""
    return running.ordinal(findings, "ordinal")


def report_text(content: Column, severity: Column, indicators: Column) -> Column:
    """The written form of one finding."""
    listed = F.concat_ws("\n- ", indicators["description"])
    return F.concat(F.lit("Severity: "), severity.cast("string"), F.lit("\nContent: "), content,
                    F.lit("\nIndicators:\n- "), listed, F.lit("\n"))
