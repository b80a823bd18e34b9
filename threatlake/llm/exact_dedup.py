"""Exact duplicates: frequent digests are settled without a shuffle, the rest by ordinary aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake import session

#: Frequent digests that are broadcast at most, and counters of the Misra-Gries summary that finds them.
HEAVY, COUNTERS = 1_000, 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

c = F.col


def normalised(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def frequent(digests: DataFrame, most: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """(digest): at most `most` digests, every one among them that has a large share of the rows.

    The engine's frequent-items sketch is a Misra-Gries summary: a bounded set of counters, of
    which all are lowered together when a new item finds no room; summaries of tasks are merged.
    Any digest of more than 7 / counters of all rows is among its certain ones.
    """
    summary = digests.agg(F.expr(f"approx_top_k(digest, {int(most)}, {int(counters)})").alias("top"))
    return summary.select(F.inline("top")).select(c("item").alias("digest"))


def _totals(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of each digest; equal largest ids leave one row."""
    return rows.groupBy("digest").agg(
        F.max("id").alias("keep_id"), F.coalesce(F.max_by("row", "id"), F.max("row")).alias("keep_row"),
        F.count(F.lit(1)).alias("group_size"))


def _settle(rows: DataFrame, most: int, counters: int) -> DataFrame:
    """rows (row, id, digest) with keep_id, keep_row and group_size.

    The candidates of the summary are counted exactly over all rows, which tasks combine before
    the only shuffle, of `most` rows a task.  These verified winners are broadcast: rows of
    frequent digests get their verdict where they are read.  No other digest has more than a
    small share of the rows; they are aggregated and joined back on the digest, a join of one row
    per digest on one side, which adaptive execution can split.
    """
    candidates = F.broadcast(frequent(rows, most, counters))
    winners = session.land(_totals(rows.join(candidates, "digest", "left_semi")), "winners")
    met = rows.join(F.broadcast(winners), "digest", "left")
    heavy = met.filter("group_size is not null")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    return heavy.unionByName(rest.join(_totals(rest), "digest"))


def _documents(docs: DataFrame, kept: list[str], key: str, text: str) -> DataFrame:
    return session.land(docs.select(
        F.monotonically_increasing_id().alias("row"), c(f"`{key}`").alias("id"),
        F.sha2(normalised(c(f"`{text}`")), 256).alias("digest"),
        *(c(f"`{name}`").alias(f"kept_{i}") for i, name in enumerate(kept))), "digests")


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for each row of `docs`, dropped ones too.

    Of the rows whose texts are equal but for the case of A-Z, the one with the largest key
    stays; `keep_id` is its key.  A null text equals an empty one.  Rows without a key come after
    all others; of rows with equal texts and keys exactly one is `kept`.  An empty table gives
    none; other columns are not read, whatever their names.
    """
    rows = _documents(docs, [], key, text)
    return _settle(rows, most, counters).select(
        c("id").alias(key), "keep_id", "group_size", (c("row") == c("keep_row")).alias("kept"), c("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; which ones, `copies` says.

    Only the numbers of the rows that go meet the documents again.
    """
    documents = _documents(docs, docs.columns, key, text)
    gone = _settle(documents.select("row", "id", "digest"), most, counters).filter("row <> keep_row").select("row")
    left = documents.join(gone, "row", "left_anti")
    return left.select(*(c(f"kept_{i}").alias(name) for i, name in enumerate(docs.columns)))
