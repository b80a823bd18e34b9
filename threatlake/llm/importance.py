"""Resampling toward a target: array-scored importance weights, ranks by a distributed radix sort."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlake import session
from threatlake.llm.textops import find_words, text_chunks

#: Buckets of the features; words that a document needs to be drawn; percent drawn; seed of the draw.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Bits of a digit of the sort key, rows of a block that one counting step ranks.
DIGIT_BITS, BLOCK_BITS = 11, 14
#: Words of more bytes are hashed one by one.
LONG_WORD = 64

c = F.col


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[starts[i]:ends[i]], a byte of every word at a time."""
    table, sizes = _crc_table(), ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, sorted_sizes = starts[order], sizes[order]
    value = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    long = int(np.searchsorted(-sorted_sizes, -LONG_WORD))
    for j in range(int(sorted_sizes[long]) if long < len(order) else 0):
        here = slice(long, int(np.searchsorted(-sorted_sizes, -j)))
        value[here] = table[(value[here] ^ data[at[here] + j]) & 0xFF] ^ (value[here] >> np.uint32(8))
    value ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        value[i] = zlib.crc32(data[at[i]: at[i] + sorted_sizes[i]])
    out = np.empty_like(value)
    out[order] = value
    return out


def _features(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bucket and owner of each word, words of each text) of slices of a text column."""
    codes = np.arange(256)
    lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint8)
    inside = (codes >= 0x80) | (codes >= 0x30) & (codes <= 0x39) | (codes >= 0x61) & (codes <= 0x7A)
    for first, end, data, offsets in text_chunks(column):
        data = lower[data]
        starts, ends, owner, counts = find_words(data, offsets, inside[data])
        yield first, end, (crc32(data, starts, ends) % np.uint32(buckets)).astype(np.int64), owner, counts


def bucket_counts(texts: DataFrame, text: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all words of all texts; each task sends one sum per bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, found, _, _ in _features(batch.column(0), buckets):
                sums += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    parts = texts.select(c(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def _array(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets)
    for bucket, n in counts.collect():  # a row per bucket at most
        out[bucket] = n
    return out


def gains(docs: DataFrame, target: DataFrame, text: str, target_text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How much likelier, in thousandths of the natural logarithm, each bucket is in the target."""
    s, t = _array(bucket_counts(docs, text, buckets), buckets), _array(bucket_counts(target, target_text, buckets), buckets)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _gumbel(key: Column, seed: int) -> Column:
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((drawn.cast("double") + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, kept: list[str], key: str, text: str, seed: int) -> DataFrame:
    """(row, id, n_features, weight, score, kept_0, ...) of every document, written once."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), c(f"`{key}`").alias("id"), c(f"`{text}`").cast("string").alias("text"),
                       *(c(f"`{name}`").alias(f"kept_{i}") for i, name in enumerate(kept)))
    names = [n for n in rows.columns if n != "text"]
    types = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names), "n_features bigint, weight bigint"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros((2, len(batch)), dtype=np.int64)
            for first, end, found, owner, counts in _features(batch.column("text"), len(gain)):
                # Sums of whole numbers are exact in doubles up to 2 ** 53.
                total = np.bincount(owner, weights=gain[found], minlength=end - first).astype(np.int64)
                n[first:end] = counts
                weight[first:end] = total // np.maximum(counts, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(n), pa.array(weight)],
                                             [*names, "n_features", "weight"])

    return session.land(rows.mapInArrow(weigh, types).withColumn("score", c("weight") + _gumbel(c("id"), seed)), "weighted")


def _counting_pass(rows: DataFrame, digit: Column) -> DataFrame:
    """One stable counting sort: every row's new `place`, by `digit`, then by its place before.

    Blocks of consecutive places count their digits; the global prefix over (digit, block) says
    where each block's rows of a digit begin, the rank inside (block, digit) where each row goes.
    """
    dealt = rows.withColumns({"digit": digit, "block": F.shiftright("place", BLOCK_BITS)})
    counts = dealt.groupBy("digit", "block").agg(F.count(F.lit(1)).alias("n"))
    # At most 2 ** DIGIT_BITS digits meet in one task, and the blocks of one digit.
    smaller = counts.groupBy("digit").agg(F.sum("n").alias("total")).select("digit", F.coalesce(
        F.sum("total").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("smaller"))
    ahead = F.coalesce(F.sum("n").over(
        Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("digit", "block", ahead.alias("ahead")).join(smaller, "digit").select(
        "digit", "block", (c("smaller") + c("ahead")).alias("begin"))
    inside = F.row_number().over(Window.partitionBy("digit", "block").orderBy("place")) - 1
    placed = dealt.withColumn("inside", inside).join(begins, ["digit", "block"])
    return placed.select("row", "high", "low", (c("begin") + c("inside")).alias("place"))


def radix_ranks(rows: DataFrame) -> DataFrame:
    """(row, place): 0-based place of rows (row, high, low) by high, then low, then row, all at least 0.

    A least-significant-digit radix sort: a stable counting sort for each digit of `low`, then of
    `high`, each pass written to the shared folder.  Digits that are the same in all rows are left
    out, as their pass would move nothing.
    """
    now = session.land(rows.select("row", "high", "low", c("row").alias("place")), "digits")
    used = now.agg(*(f(n).alias(f"{f.__name__}_{n}") for n in ("high", "low") for f in (F.bit_or, F.bit_and))).first()
    passes = 0
    for name in ("low", "high"):
        varying = (used[f"bit_or_{name}"] or 0) ^ (used[f"bit_and_{name}"] or 0)
        for shift in range(0, varying.bit_length(), DIGIT_BITS):
            if varying >> shift & (1 << DIGIT_BITS) - 1:
                digit = F.shiftright(name, shift).bitwiseAND((1 << DIGIT_BITS) - 1)
                now = session.land(_counting_pass(now, digit), "digits")
                passes += 1
    # Rows that no digit tells apart still have the places they came with.
    return now if passes else _counting_pass(now, F.lit(0).cast("bigint"))


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """(row, rank) of the drawn rows: the highest scores, ties to the smaller id, then in the rows' order.

    The scores, whole numbers within some 100,000 of each other, are counted first: rows below the
    score that the last drawn one must have need no sorting.  Null ids come after all others.
    """
    able = scored.filter(c("n_features") >= least_words)
    by_score = able.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    higher = F.sum("n").over(Window.orderBy(c("score").desc()).rowsBetween(Window.unboundedPreceding, -1))
    all_rows = F.sum("n").over(Window.partitionBy())
    found = by_score.select("score", F.coalesce(higher, F.lit(0)).alias("higher"), F.floor(all_rows * percent / 100).alias("drawn"))
    cut = found.filter(c("higher") < c("drawn")).agg(F.min("score").alias("low"), F.max("score").alias("top"), F.max("drawn").alias("drawn")).first()
    ids = able.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    least, most = ids["a"] or 0, ids["b"] or 0
    if most - least >= 1 << 63:
        raise ValueError("ids lie 2 ** 63 or more apart")
    low = c("id").cast("bigint") - F.lit(least)
    rows = able.filter(c("score") >= F.lit(cut["low"])).select(
        "row", ((F.lit(cut["top"]) - c("score")) * 2 + c("id").isNull().cast("int")).cast("bigint").alias("high"),
        F.coalesce(low, F.lit(0)).cast("bigint").alias("low"))
    return radix_ranks(rows).filter(c("place") < F.lit(cut["drawn"] or 0)).select("row", (c("place") + 1).cast("bigint").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank) for each row of `docs`; rows that are not drawn have no rank.

    Features are words, A-Z in lower case, hashed into buckets and counted over all texts of both
    tables.  A document's weight is the mean gain of its features; a score adds a draw of its own,
    so the highest scores are a sample without replacement in proportion to the exponent of the
    weights.  The `percent` highest of the documents with `least_words` words are drawn.

    A null or empty text has no feature and weight 0; a null key draws as an empty one and ranks
    after equal scores; repeated rows have ranks of their own.  An empty `docs` gives no rows, an
    empty target leaves all weights to what is rare in `docs`.  `key` is a whole number; other
    columns are not read, whatever their names.
    """
    scored = weighted(docs, gains(docs, target, text, target_text, buckets), [], key, text, seed)
    out = scored.join(ranked(scored, percent, least_words), "row", "left")
    return out.select(c("id").alias(key), "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", rank: str = "rank",
         percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The drawn rows of `docs` with all their columns and their `rank`, which replaces a column of that name."""
    scored = weighted(docs, gains(docs, target, text, target_text, buckets), docs.columns, key, text, seed)
    out = scored.join(ranked(scored, percent, least_words), "row")
    return out.select(*(c(f"kept_{i}").alias(n) for i, n in enumerate(docs.columns) if n != rank), c("rank").alias(rank))
