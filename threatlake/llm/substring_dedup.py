"""Repeated passages: runs of consecutive sentences hashed, joined globally, later ones removed."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake import session
from threatlake.llm.textops import Hasher, find_words, mix, text_chunks

#: A run has so many sentences and words, or so many words in however few sentences.
RUN_SENTENCES, RUN_WORDS, LONG_WORDS = 2, 10, 20

_BASE = 0x9E3779B97F4A7C15
_NO_KEY = -(1 << 63)


class Sentences(NamedTuple):
    """Sentences of some texts in order, as number of the text and byte ranges that cover all of it; and their runs.

    Runs are ordered by text, first sentence and size; `spans` are their hashes.
    """

    owner: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    run_owner: np.ndarray
    run_first: np.ndarray
    run_size: np.ndarray
    spans: np.ndarray


def _runs(first: np.ndarray, last: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentences of the runs to hash; `first` and `last` bound each sentence's words.

    These are the shortest run from each sentence and the shortest run to each sentence.  They
    cover what all runs cover: of a repeated run, a sentence either starts a run inside it, or is
    in the shortest run to its last sentence.  A text too short for a run is one as a whole.
    """
    k = len(first)
    at = np.arange(k)
    opens = np.searchsorted(text, text)
    closes = np.searchsorted(text, text, side="right") - 1
    to = np.minimum(np.maximum(at + RUN_SENTENCES - 1, np.searchsorted(last, first + RUN_WORDS)),
                    np.searchsorted(last, first + LONG_WORDS))
    since = np.maximum(np.minimum(at - RUN_SENTENCES + 1, np.searchsorted(first, last - RUN_WORDS, side="right") - 1),
                       np.searchsorted(first, last - LONG_WORDS, side="right") - 1)
    forward, backward = to <= closes, since >= opens
    short = (at == opens) & (closes - opens + 1 >= RUN_SENTENCES) & ~forward
    pairs = np.concatenate([at[forward] * k + to[forward], since[backward] * k + at[backward], at[short] * k + closes[short]])
    return np.divmod(np.unique(pairs), k)


class Splitter:
    def __init__(self) -> None:
        self.hasher = Hasher(lower=True)
        self.size = 0

    def _powers(self, size: int) -> None:
        if size > self.size:
            self.size = max(size, 1 << 18)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                powers = np.full(self.size, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def sentences(self, data: np.ndarray, offsets: np.ndarray) -> Sentences:
        """A sentence ends with a word that ends in . ! or ?, at a line feed, and with the text."""
        starts, ends, owner, _ = find_words(data, offsets)
        n = len(starts)
        if not n:
            empty = np.zeros(0, dtype=np.int64)
            return Sentences(*[empty] * 6, empty.astype(np.uint64))
        feeds = np.concatenate([[0], np.cumsum(data == 0x0A)])
        stop = np.isin(data[ends - 1], np.frombuffer(b".!?", dtype=np.uint8))
        stop[:-1] |= (owner[1:] != owner[:-1]) | (feeds[starts[1:]] > feeds[ends[:-1]])
        stop[-1] = True
        last = np.flatnonzero(stop) + 1  # word after each sentence
        first = np.concatenate([[0], last[:-1]])
        text = owner[first]
        opens = np.ones(len(first), dtype=bool)
        opens[1:] = text[1:] != text[:-1]
        begins = np.where(opens, offsets[text], starts[first])
        finish = np.append(begins[1:], 0)
        closes = np.append(opens[1:], True)
        finish = np.where(closes, offsets[text + 1], finish)

        run_first, run_last = _runs(first, last, text)
        self._powers(n + 1)
        words = self.hasher.ranges(data, starts, ends)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * self.up[:n], dtype=np.uint64, out=sums[1:])
        word, stop_word = first[run_first], last[run_last]
        spans = mix((sums[stop_word] - sums[word]) * self.down[word] + (stop_word - word).astype(np.uint64))
        return Sentences(text, begins, finish, text[run_first], run_first, run_last - run_first + 1, spans)


def _first_in_text(found: Sentences) -> np.ndarray:
    """Whether each run is its text's first with that hash."""
    order = np.lexsort((np.arange(len(found.spans)), found.spans, found.run_owner))
    owner, spans = found.run_owner[order], found.spans[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (spans[1:] != spans[:-1])
    out = np.zeros(len(order), dtype=bool)
    out[order] = new
    return out


def _place(found: Sentences) -> np.ndarray:
    """Position of each run among those of its text."""
    return np.arange(len(found.run_owner)) - np.searchsorted(found.run_owner, found.run_owner)


def _key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("bigint"), F.lit(_NO_KEY))


def text_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(span, doc, place): each document's runs, the first in the document for every hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for first, end, data, offsets in text_chunks(batch.column(1)):
                found = splitter.sentences(data, offsets)
                at = np.flatnonzero(_first_in_text(found))
                yield pa.RecordBatch.from_arrays([
                    pa.array(found.spans[at].view(np.int64)), pa.array(keys[first:end][found.run_owner[at]]),
                    pa.array(_place(found)[at].astype(np.int32))], names=["span", "doc", "place"])

    return docs.select(_key(key), text).mapInArrow(run, "span bigint, doc bigint, place int")


def _remove(found: Sentences, later: list[tuple[int, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Which sentences are covered: by runs repeated in their text, and by the given (text, places, spans)."""
    begins = np.searchsorted(found.run_owner, np.arange(n + 1))
    hit = [np.flatnonzero(~_first_in_text(found))]
    for i, places, spans in later:
        rows = begins[i] + places
        good = rows < begins[i + 1]
        rows, spans = rows[good], spans[good]
        hit.append(rows[found.spans[rows] == spans])
    rows = np.concatenate(hit)
    cover = np.zeros(len(found.owner) + 1, dtype=np.int64)
    np.add.at(cover, found.run_first[rows], 1)
    np.add.at(cover, found.run_first[rows] + found.run_size[rows], -1)
    return np.cumsum(cover)[:-1] > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: tuple[str, str] | None = None,
                   length: str | None = None) -> DataFrame:
    """The rows of `docs` with every sentence removed that a repeated run covers, but for the first.

    A run is any stretch of whole sentences with at least RUN_SENTENCES sentences and RUN_WORDS
    words, or with LONG_WORDS words, or a whole text of RUN_SENTENCES sentences.  Runs are equal
    if their sentences have the same words, A-Z in either case.  Of equal runs the one of the smallest
    key stays, in a document its first.  `counts` names two columns to add or replace, sentences
    and removed ones; `length` names a column of text lengths to renew where a text changed.

    A null text stays null and has no sentences.  A null key comes before all others.  Rows that
    share a key are one document: they don't remove each other's runs.  Texts of
    one sentence with fewer than LONG_WORDS words stay as they are.
    """
    docs = docs.drop(*(counts or ()))
    spans = session.land(text_spans(docs, key, text), "spans")
    repeated = spans.groupBy("span").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = spans.join(repeated.select("span", "first"), "span").filter("doc > first").groupBy("doc").agg(
        F.collect_list("place").alias("places"), F.collect_list("span").alias("spans"))
    width = len(docs.columns)
    internal = docs.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(docs.columns)), _key(key).alias("doc"))
    rows = internal.join(later, "doc", "left").select(*(f"c{i}" for i in range(width)), "places", "spans")
    extra = [F.lit(None).cast("int").alias(n) for n in counts or ()]
    schema, at = docs.select("*", *extra).schema, docs.columns.index(text)
    size_at = docs.columns.index(length) if length else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(at)):
                part = batch.slice(first, end - first)
                found = splitter.sentences(data, offsets)
                lists = zip(part.column(width).to_pylist(), part.column(width + 1).to_pylist())
                removed = _remove(found, [
                    (i, np.array(p, dtype=np.int64), np.array(s, dtype=np.int64).view(np.uint64))
                    for i, (p, s) in enumerate(lists) if p], end - first)
                n = np.bincount(found.owner, minlength=end - first)
                gone = np.bincount(found.owner[removed], minlength=end - first)
                columns = list(part.columns[:width])
                if gone.any():
                    raw, new = data.tobytes(), columns[at].to_pylist()
                    sizes = columns[size_at].to_pylist() if length else None
                    begins = np.searchsorted(found.owner, np.arange(end - first + 1))
                    for i in np.flatnonzero(gone).tolist():
                        rows = np.arange(begins[i], begins[i + 1])[~removed[begins[i]: begins[i + 1]]]
                        new[i] = b"".join(raw[a:b] for a, b in zip(found.starts[rows], found.ends[rows])).decode()
                        if sizes:
                            sizes[i] = len(new[i])
                    columns[at] = pa.array(new, columns[at].type)
                    if sizes:
                        columns[size_at] = pa.array(sizes, columns[size_at].type)
                more = [pa.array(x.astype(np.int32)) for x in ((n, gone) if counts else ())]
                yield pa.RecordBatch.from_arrays([*columns, *more], names=schema.names)

    return rows.mapInArrow(run, schema)
