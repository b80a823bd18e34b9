"""Second pass over findings with a table of verdict texts.

Verdicts come from outside (any analyst or model): source_file, line_number,
kind, text with `KEY: value` lines.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatlake import catalog, session
from threatlake.functions import times
from threatlake.operators import running

LINE_KEY = ["source_file", "line_number"]


def _entries(verdict: Column) -> Column:
    """Key-value lines; a line without a colon continues the value before it."""
    lines = F.regexp_replace(F.btrim(verdict, F.lit(" \t\r\n")), r"[ \t\r]*\n\s*", "\n")
    # Lines before the first key belong to nothing.
    keyed = F.regexp_replace(lines, r"^(?:[^:\n]*\n)*(?:[^:\n]*$)?", "")
    # A continuation keeps its line feed: only a feed before a keyed line separates.
    return F.split(keyed, r"\n(?=[^\n]*:)")


def parse_verdict(verdict: Column) -> Column:
    """Verdict text to a map (P13); of equal keys the last counts."""
    pairs = F.transform(_entries(verdict), lambda e: F.struct(
        F.trim(F.substring_index(e, ":", 1)).alias("key"),
        F.btrim(F.substring(e, F.length(F.substring_index(e, ":", 1)) + F.lit(2), F.length(e)),
                F.lit(" \t\n")).alias("value")))
    pairs = F.filter(pairs, lambda p: p["key"] != "")

    def last(found: Column) -> Column:
        return F.filter(found, lambda p, i: ~F.array_contains(
            F.slice(found["key"], i + F.lit(2), F.size(found)), p["key"]))

    # The outer lambda binds the pairs: written out in the inner one, the text would be read anew for each of them.
    return F.transform(F.array(pairs), lambda found: F.map_from_entries(last(found)))[0]


def _whole_number(value: Column, default: Column) -> Column:
    return F.when(value.rlike(r"^\d+$"), value.try_cast("int")).otherwise(default)


def refine(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Drops findings judged false positive with confidence, revises severities.

    A finding without a verdict stays as it is.  Values that do not read make
    the verdict void, but keep the finding.  Verdicts are as many as findings, and far larger as
    maps than in their files, by whose size they would be sent through the driver; so both are sorted.
    """
    c = F.col
    parsed = verdicts.withColumn("_v", F.explode(F.array(parse_verdict(c("text"))))).select(*LINE_KEY, "_v")
    joined = running.keyed_rows(findings).join(parsed.hint("merge"), LINE_KEY, "left")

    def value(key: str) -> Column:
        return F.try_element_at("_v", F.lit(key))

    confidence = F.coalesce(value("CONFIDENCE"), F.lit("0")).try_cast("double")
    claimed = F.lower(F.coalesce(value("IS_FALSE_POSITIVE"), F.lit(""))) == "true"
    joined = joined.withColumns({
        "judged": F.coalesce(F.size("_v") > 0, F.lit(False)),
        "confidence": F.coalesce(confidence, F.lit(0.0)),
        "is_false_positive": claimed & confidence.isNotNull(),
    })
    explained = F.coalesce(value("EXPLANATION"), F.lit("No explanation provided"))
    revised = F.when(confidence.isNotNull(), _whole_number(
        F.coalesce(value("REVISED_SEVERITY"), F.lit("")), c("severity"))).otherwise(c("severity"))
    no = F.lit(None)
    out = joined.withColumns({
        "revised_severity": F.when(c("judged"), revised).otherwise(c("severity")),
        "explanation": F.when(c("judged"), explained),
        "confidence": F.when(c("judged"), c("confidence")).otherwise(no.cast("double")),
        "is_false_positive": F.when(c("judged"), c("is_false_positive")).otherwise(no.cast("boolean")),
    }).drop("_v")
    dropped = F.coalesce(c("is_false_positive") & (c("confidence") >= catalog.FALSE_POSITIVE_CONFIDENCE), F.lit(False))
    return out.filter(~dropped)


def groups(findings: DataFrame, seconds: int = catalog.CORRELATION_SECONDS) -> DataFrame:
    """Related findings: same file, same stretch of `seconds`; groups of two or more.

    Only counts and the range of lines are kept per group, so a group may be of
    any size.
    """
    bucket = F.floor(times.seconds_of(F.col("event_time")) / seconds)
    return findings.filter(F.col("event_time").isNotNull()).groupBy(
        "source_file", bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("findings"), F.min("line_number").alias("first_line"),
        F.max("line_number").alias("last_line")).filter("findings > 1")


def correlated_threats(groups_: DataFrame, group_verdicts: DataFrame) -> DataFrame:
    """Threats accepted from group verdicts (source_file, bucket, text)."""
    parsed = group_verdicts.withColumn("_v", F.explode(F.array(parse_verdict(F.col("text"))))).drop("text")
    joined = groups_.join(parsed, ["source_file", "bucket"])

    def value(key: str) -> Column:
        return F.try_element_at("_v", F.lit(key))

    confidence = F.coalesce(value("CONFIDENCE"), F.lit("0")).try_cast("double")
    severity = _whole_number(F.coalesce(value("SEVERITY"), F.lit("")), F.lit(catalog.DEFAULT_CORRELATED_SEVERITY))
    actions = F.split(F.coalesce(value("RECOMMENDED_ACTIONS"), F.lit("")), ",")
    return joined.filter(confidence > catalog.CORRELATED_THREAT_CONFIDENCE).select(
        "source_file", "bucket", "findings", "first_line", "last_line", F.lit("correlated_threat").alias("type"),
        F.coalesce(value("CORRELATED_THREAT"), F.lit("Unknown threat")).alias("content"),
        F.coalesce(value("EXPLANATION"), F.lit("No explanation provided")).alias("explanation"),
        severity.alias("severity"), actions.alias("recommended_actions"))


def with_threats(refined: DataFrame, threats: DataFrame) -> DataFrame:
    """Refined findings and correlated threats in one table."""
    return refined.unionByName(threats, allowMissingColumns=True)


def triage(findings: DataFrame, verdicts: DataFrame, details: DataFrame) -> DataFrame:
    """Findings of severity 2 and up that are judged real, with their detail verdict.

    A verdict that does not say counts as false positive.
    """
    def parsed(df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, F.explode(F.array(parse_verdict(F.col("text"))))).select(*LINE_KEY, out)

    def value(key: str) -> Column:
        return F.try_element_at("_d", F.lit(key))

    real = parsed(verdicts, "_v").filter(
        F.lower(F.coalesce(F.try_element_at("_v", F.lit("IS_FALSE_POSITIVE")), F.lit("true"))) != "true")
    severe = running.keyed_rows(findings).filter(F.col("severity") >= 2).join(real.select(*LINE_KEY), LINE_KEY, "left_semi")
    joined = severe.join(parsed(details, "_d"), LINE_KEY)
    severity = F.coalesce(value("SEVERITY").try_cast("int"), F.col("severity"))
    return joined.select(
        *LINE_KEY, "content", F.coalesce(value("THREAT"), F.lit("Unknown")).alias("threat"),
        F.coalesce(value("CONFIDENCE"), F.lit("0")).alias("confidence"), severity.alias("severity"),
        F.coalesce(value("EXPLANATION"), F.lit("No explanation provided")).alias("explanation"),
        F.transform(F.split(value("ACTIONS"), ","), lambda a: F.trim(a)).alias("actions"))


# -- evidence texts --------------------------------------------------------------

def evidence_text(content: Column, severity: Column, indicators: Column) -> Column:
    return F.concat(F.lit("Finding (Severity "), severity.cast("string"), F.lit("):\n"), content,
                    F.lit("\nIndicators: "), F.array_join(indicators["description"], ", "))


def evidence_bundles(findings: DataFrame, per_bundle: int = catalog.PAGE_SIZE,
                     block_lines: int = running.LINE_BLOCK) -> DataFrame:
    """One text per `per_bundle` consecutive findings of a file.

    A file's findings are cut into bundles by ordinal, so no group outgrows a
    bundle and every finding is in exactly one.
    """
    kept = findings.filter(F.size("indicators") > 0)
    numbered = running.ordinal(kept, "_ordinal", block_lines)
    bundle = F.floor((F.col("_ordinal") - 1) / per_bundle)
    one = F.struct("_ordinal", evidence_text(F.col("content"), F.col("severity"), F.col("indicators")).alias("text"))
    grouped = numbered.groupBy("source_file", bundle.alias("bundle")).agg(
        F.count(F.lit(1)).alias("findings"), F.array_sort(F.collect_list(one)).alias("_texts"))
    return grouped.withColumn("text", F.array_join(F.col("_texts")["text"], "\n")).drop("_texts")


def short_evidence(findings: DataFrame, first: int, length: int | None = None) -> DataFrame:
    """The `first` severe findings of each file, cut to `length` characters if given."""
    order = Window.partitionBy("source_file").orderBy("line_number")
    ranked = findings.filter("severity >= 2").select(
        "source_file", "line_number", "content", F.row_number().over(order).alias("n")).filter(F.col("n") <= first)
    shown = F.col("content") if length is None else F.concat(F.left("content", F.lit(length)), F.lit("..."))
    text = F.concat(F.lit("Finding "), F.col("n").cast("string"), F.lit(": "), shown)
    return ranked.groupBy("source_file").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("n", text.alias("t"))))["t"], "\n").alias("text"))


def chat_context(text: Column, length: int | None = None) -> Column:
    """Context text, cut to a length limit if given."""
    if length is None:
        return text
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("...(truncated)"))).otherwise(text)


def full_prompt(prompt: Column, mode: str = "detailed") -> Column:
    """Prompt with the mode's prefix; an unknown mode counts as detailed."""
    prefix = catalog.MODE_PREFIXES.get(mode, catalog.MODE_PREFIXES["detailed"])
    return F.concat(F.lit(prefix + "\n\n"), prompt)


def cache_key(prompt: Column, max_tokens: int) -> Column:
    return F.md5(F.concat(prompt, F.lit(f":{max_tokens}")))


#: Parts of a stored cache; a run of new summaries rewrites the parts that their keys fall into.
CACHE_PARTS = 256


def save_summaries(summaries: DataFrame, path: str) -> None:
    """Stores (cache_key, summary) rows: new keys are added, known ones replaced.

    The store is partitioned by a hash of the key.  Only the partitions of new keys are read,
    merged and replaced, each as a whole when the write commits; a reader or a failed run never
    sees a part of one.  Of several new rows for a key the greatest summary stays.
    """
    spark = summaries.sparkSession
    fresh = session.land(summaries.filter("cache_key is not null").groupBy("cache_key").agg(F.max("summary").alias("summary")).select(
        "cache_key", "summary", _part_of(F.col("cache_key"))), "summaries")
    old = stored_summaries(spark, path)
    touched = F.broadcast(fresh.select("part").distinct())  # CACHE_PARTS rows at most
    left = old.join(touched, "part", "left_semi").join(fresh.select("cache_key"), "cache_key", "left_anti")
    merged = session.land(fresh.unionByName(left.select(*fresh.columns)), "merged")
    merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def _part_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CACHE_PARTS)).cast("int").alias("part")


def stored_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(cache_key, summary, part) of a store; one that was never written to is empty."""
    schema = "cache_key string, summary string, part int"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def cache_misses(prompts: DataFrame, cache: DataFrame, max_tokens: int = 200) -> DataFrame:
    """Distinct prompts without a stored summary."""
    keyed = prompts.withColumn("cache_key", cache_key(F.col("prompt"), max_tokens))
    stored = cache.filter(F.col("summary").isNotNull() & (F.col("summary") != ""))
    return keyed.dropDuplicates(["cache_key"]).join(stored.select("cache_key"), "cache_key", "left_anti")


def cache_hits(prompts: DataFrame, cache: DataFrame, max_tokens: int = 200) -> DataFrame:
    """Prompts with their stored summary."""
    keyed = prompts.withColumn("cache_key", cache_key(F.col("prompt"), max_tokens))
    return keyed.join(cache.select("cache_key", "summary"), "cache_key")
