"""Audit of filters in every order: a stream of documents that gives signed changes of per-part counters."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threatlake import session
from threatlake.functions.text import computed_once

#: The filters, in the order of their bits in a mask; the last one depends on all texts.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)

#: Groups of texts in each state partition.  Texts are apart in the state; a group shares only its calls.
GROUPS_PER_PARTITION = 16
#: The state store: no space set aside for each partition's logs, changes instead of snapshots after each
#: micro-batch, no count of all rows kept beside them.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}

MASKED = "grp int, digest string, missing int, id bigint, part string, mask int, n bigint"
CHANGES = "part string, mask int, n bigint"
TEXT_STATE = "missing int, id bigint, counted array<struct<part: string, mask: int, n: bigint>>"

c = F.col


def own_mask(text: Column, words: Column) -> Column:
    """Bits of the filters A to D that a text fails; `words` are the text's."""
    failing = (F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
               100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), text.rlike("[#$%&*|]"))
    mask = F.lit(0)
    for bit, failed in enumerate(failing):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask


def marks_of(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(labelled, marks), written once: a document is good or toxic if any of its label rows says so."""
    def mark(name: str, bit: int) -> Column:
        return F.when(F.max(c(name) == 1), bit).otherwise(0)

    return session.land(labels.filter(c(key).isNotNull()).groupBy(c(key).alias("labelled")).agg(
        (mark("quality", GOOD) + mark("toxic", TOXIC)).alias("marks")), "marks")


def masked(docs: DataFrame, marks: DataFrame, groups: int, key: str, text: str, part: str) -> DataFrame:
    """The documents with the masks of their own failures and labels; see MASKED."""
    whole = docs.select(c(f"`{key}`").cast("bigint").alias("id"), F.coalesce(c(f"`{part}`"), F.lit("")).alias("part"),
                        F.coalesce(c(f"`{text}`"), F.lit("")).alias("text"))
    # White space at either end leaves an empty word there.
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = computed_once(whole, "words", words).select(
        "id", "part", F.sha2("text", 256).alias("digest"), own_mask(c("text"), c("words")).alias("own"))
    met = rows.join(marks, c("id") == c("labelled"), "left")
    return met.select(
        F.pmod(F.xxhash64("digest"), F.lit(groups)).cast("int").alias("grp"), "digest", c("id").isNull().cast("int").alias("missing"),
        F.coalesce("id", F.lit(0)).alias("id"), "part", (c("own") + F.coalesce("marks", F.lit(0))).cast("int").alias("mask"),
        F.lit(1).cast("bigint").alias("n"))


def combined(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sets copies aside before the shuffle: in a chunk, all but those of a text's smallest id fail E for certain.

    They are summed without a digest, so of a text with very many copies only one row for each
    chunk goes to the text's state.
    """
    for chunk in chunks:
        chunk = chunk.sort_values(["digest", "missing", "id"], kind="stable", ignore_index=True)
        least = chunk.groupby("digest")[["missing", "id"]].transform("first")
        first = (chunk["missing"] == least["missing"]) & (chunk["id"] == least["id"])
        late = chunk[~first].groupby(["part", "mask"], as_index=False)["n"].sum()
        if not len(late):
            yield chunk
            continue
        late = late.assign(grp=0, digest="", missing=0, id=0)
        yield pd.concat([chunk[first], late[chunk.columns]], ignore_index=True)


class _Texts(StatefulProcessor):
    """Keeps for each text its smallest id so far and what was counted for it, by part and mask.

    A smaller id takes that back and counts it again as copies.  Rows without a digest are copies.
    Gives one row for every counter that a call has changed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._texts = handle.getMapState("texts", "digest string", TEXT_STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        changes: Counter = Counter()
        for chunk in rows:
            found = chunk[["digest", "missing", "id", "part", "mask", "n"]].sort_values("digest", kind="stable")
            for digest, group in itertools.groupby(found.itertuples(index=False, name=None), key=lambda r: r[0]):
                if digest:
                    self._one_text(digest, group, changes)
                else:
                    for *_, part, mask, n in group:
                        changes[part, mask | COPY] += n
        changed = [(part, mask, n) for (part, mask), n in changes.items() if n]
        yield pd.DataFrame(changed, columns=["part", "mask", "n"]).astype({"mask": "int32", "n": "int64"})

    def _one_text(self, digest: str, rows: Iterator[tuple], changes: Counter) -> None:
        state = self._texts.getValue((digest,))
        least = (state[0], state[1]) if state else None
        before = {(part, mask): n for part, mask, n in state[2]} if state else {}
        counted, late = Counter(before), Counter()
        for _, missing, id, part, mask, n in rows:
            here = (int(missing), int(id))
            if least is None or here < least:
                late.update(counted)
                least, counted = here, Counter()
            (counted if here == least else late)[part, int(mask)] += int(n)
        changes.update(counted)
        changes.subtract(before)
        changes.update({(part, mask | COPY): n for (part, mask), n in late.items()})
        if counted != before or (state[0], state[1]) != least:
            self._texts.updateValue((digest,), (*least, [(part, mask, n) for (part, mask), n in counted.items()]))

    def close(self) -> None:
        pass


def _file_or_folder(path: str) -> str:
    """The path as a pattern that only it matches: a stream reads a single file by pattern only."""
    path = path.rstrip("/")
    return path if any(x in path for x in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def counter_changes(spark: SparkSession, path: str, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang",
                    files_per_batch: int | None = None) -> DataFrame:
    """(part, mask, n): the changes of counters that the documents at `path` gave, to be summed.

    All files are read as a stream of micro-batches, one file for each core at a time unless
    `files_per_batch` says so.  State and changes lie in the shared folder; a micro-batch that is
    run again replaces its own.  The stream runs in a session of its own, as its settings are not
    the caller's.
    """
    own = session.prepare(spark.newSession())
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.shuffle.partitions", partitions)
    for name, value in STATE_SETTINGS.items():
        own.conf.set(name, value)
    stream = own.readStream.schema(spark.read.parquet(path).schema).option(
        "maxFilesPerTrigger", files_per_batch or spark.sparkContext.defaultParallelism).parquet(_file_or_folder(path))
    rows = masked(stream, marks_of(labels, key), GROUPS_PER_PARTITION * partitions, key, text, part)
    changes = rows.mapInPandas(combined, MASKED).groupBy("grp").transformWithStateInPandas(
        statefulProcessor=_Texts(), outputStructType=CHANGES, outputMode="Append", timeMode="None")
    out, state = session.new_folder(spark, "changes"), session.new_folder(spark, "changes-state")
    changes.writeStream.format("parquet").outputMode("append").option("path", out).option(
        "checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(CHANGES).parquet(out)


def _steps(spark: SparkSession) -> DataFrame:
    """(own, filter_order, step, letter, fails, earlier): what each of the 32 masks meets at every step of the 120 orders."""
    rows = []
    for order in itertools.permutations(FILTERS):
        for i, letter in enumerate(order):
            earlier = sum(1 << FILTERS.index(x) for x in order[:i])
            rows.append(("".join(order), i + 1, letter, 1 << FILTERS.index(letter), earlier))
    steps = spark.createDataFrame(rows, "filter_order string, step int, letter string, bit int, before int")
    every = steps.withColumn("own", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))))
    return every.select("own", "filter_order", "step", "letter", (c("own") == c("bit")).alias("alone"),
                        (c("own").bitwiseAND(c("bit")) != 0).alias("fails"), (c("own").bitwiseAND(c("before")) != 0).alias("earlier"))


def audit(spark: SparkSession, path: str, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang",
          files_per_batch: int | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of the parquet files at `path`.

    A row for every part, order of the filters and step.  Null texts are empty, null parts are the
    empty string.  A text is a copy if any row with a smaller key has it; a row without a key
    comes after all with one, and rows of equal keys and texts are no copies of each other.  Rows
    of `labels` without a key are left out; of several for a key, any counts.  Other columns are
    not read, whatever their names.  No documents give no rows.
    """
    changes = counter_changes(spark, path, labels, key, text, part, files_per_batch)
    n, mask = c("n"), c("mask")
    cells = changes.groupBy("part", mask.bitwiseAND(GOOD - 1).alias("own")).agg(
        F.sum("n").alias("n"), F.sum(F.when(mask.bitwiseAND(GOOD) != 0, n).otherwise(0)).alias("good"),
        F.sum(F.when(mask.bitwiseAND(TOXIC) != 0, n).otherwise(0)).alias("toxic"))
    # 32 masks for each part meet a fixed table of 600 steps for each mask.
    met = cells.join(F.broadcast(_steps(spark)), "own")

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, c(value)).otherwise(0))

    removed = c("fails") & ~c("earlier")
    rows = met.groupBy("part", "filter_order", "step", "letter").agg(
        total(~c("fails") & ~c("earlier")).alias("kept"), total(removed).alias("removed"),
        total(c("fails") & c("earlier")).alias("redundant"), total(c("alone")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return rows.withColumn("shapley", shapley).drop("letter")
