"""Inputs of the registered queries, all derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake import session
from threatlake.operators import extract, matching
from threatlake.plans import scan
from threatlake.sources import carrier, logs

YEAR = carrier.YEAR
_landed: dict[tuple[str, str, str], DataFrame] = {}


class Tables:
    """Log tables of one data folder.

    `parsed` and `findings` are written once per application, as a findings
    store would be, and shared by the queries that report on them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = session.prepare(spark)
        self.sf_dir = sf_dir

    def _once(self, name: str, make) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _landed:
            _landed[key] = session.land(make(), name)
        return _landed[key]

    def spread(self, df: DataFrame) -> DataFrame:
        """The given tables are one file each: deal their rows out."""
        return df.repartition(self.spark.sparkContext.defaultParallelism)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def ordered_events(self) -> DataFrame:
        """The events in ranges, as tasks hold the lines of a log; they are dealt out before lines are made of them."""
        return self.table("events").repartitionByRange(self.spark.sparkContext.defaultParallelism, "event_id").sortWithinPartitions("event_id")

    @property
    def derived(self) -> DataFrame:
        return carrier.derive_lines(self.ordered_events)

    @property
    def places(self) -> DataFrame:
        """The events with the places of their lines, for lines of other forms."""
        return carrier.line_places(self.ordered_events)

    @property
    def lines(self) -> DataFrame:
        return logs.clean_lines(self.derived.select("source_file", "line_number", "line", "log_type"))

    @property
    def document_lines(self) -> DataFrame:
        docs = self.spread(self.table("documents"))
        return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))

    @property
    def events(self) -> DataFrame:
        return extract.parse_events(self.lines, YEAR)

    @property
    def parsed(self) -> DataFrame:
        return self._once("parsed", lambda: matching.best_rule(self.events))

    @property
    def scored(self) -> DataFrame:
        return self._once("scored", lambda: scan.score_events(self.parsed))

    @property
    def findings(self) -> DataFrame:
        return self._once("findings", lambda: scan.choose_verdicts(self.parsed, self.scored))

    @property
    def file_findings(self) -> DataFrame:
        return matching.file_findings(logs.strip_lines(self.lines))

    @property
    def packets(self) -> DataFrame:
        return extract.parse_packets(self.lines)

    @property
    def json_findings(self) -> DataFrame:
        """Findings of a scan over JSON documents with a connection for every event."""
        def make() -> DataFrame:
            c = F.col
            port = F.array(*map(F.lit, (80, 4444, 22)))[(c("event_id") % 3).cast("int")]
            parts = ['{"timestamp":"', F.date_format("log_ts", "yyyy-MM-dd HH:mm:ss"), '","src_ip":"45.67.0.', c("user_id") % 3,
                     '","dst_ip":"10.0.0.', c("event_id") % 3, '","dst_port":', port, ',"src_port":', 40000 + c("user_id"),
                     ',"protocol":"tcp","bytes":0}']
            item = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
            rows = self.places.select(
                "event_id", F.floor(c("event_id") / 200).alias("block"), item.alias("item"))
            arrays = rows.filter("block % 2 = 0").groupBy((c("block") * 200).alias("document")).agg(
                F.array_sort(F.collect_list(F.struct("event_id", "item")))["item"].alias("items"))
            docs = arrays.select("document", F.concat(F.lit("["), F.array_join("items", ", "), F.lit("]")).alias("text")).unionByName(
                rows.filter("block % 2 = 1").select(c("event_id").alias("document"), c("item").alias("text")))
            lines = logs.explode_documents(docs).select(
                F.concat(F.lit("doc"), c("document").cast("string")).alias("source_file"), c("item_number").alias("line_number"),
                c("item").alias("line"), F.lit("volatility_json").alias("log_type"))
            return scan.scan(logs.clean_lines(lines), YEAR)
        return self._once("json_findings", make)

    @property
    def verdicts(self) -> DataFrame:
        return carrier.verdicts_for(self.findings)
