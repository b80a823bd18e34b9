"""Language-model scores: a weighted backoff automaton over n-grams counted in all texts.

Texts are cut into blocks of tokens.  Every block asks the shards of the hash space, one packed
message each, for the counts of its n-grams, and hands in its own; a shard adds up what came and
answers every block.  A block then writes its texts in segments with the counts they need; a
segment builds the part of the automaton that its texts can visit and runs each text through it.
So no table of n-grams is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake import session
from threatlake.llm.textops import Hasher, mix, text_chunks, words_of

#: Longest n-gram.
ORDER = 3
#: Tokens in a block, tokens scored at once, and n-grams that a shard adds up at once, roughly.
BLOCK_TOKENS = 1_500_000
SEGMENT_TOKENS = 150_000
SHARD_NGRAMS = 1_000_000

_END = 0x5D1F3C2B7A9E8D41  # the end token; words hash elsewhere
_STEP = 0xA0761D6478BD642F

BLOCK_SCHEMA = ("block bigint, keys array<bigint>, sizes array<int>, trained array<boolean>, n_tokens bigint, "
                "vocabulary binary, tokens binary")


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as compressed bytes: differences if they rise, then all first bytes, all second ones, ..."""
    data = np.diff(values, prepend=values.dtype.type(0)) if rising else values
    planes = np.ascontiguousarray(data).view(np.uint8).reshape(len(data), data.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    values = raw.reshape(np.dtype(kind).itemsize, -1).T.reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if rising else values


def training_row(key: Column, folds: int = 7, held: int = 2) -> Column:
    """Whether a document is learned from: crc32 of its id as text, modulo `folds`, is not `held`."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds != held, F.lit(True))


def _pack(keys: list, sizes: list, trained: list, hashes: list, number: int) -> pa.RecordBatch:
    words = np.concatenate(hashes)
    vocabulary, tokens = np.unique(words, return_inverse=True)
    return pa.RecordBatch.from_arrays([
        pa.array([number], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
        pa.array([trained], pa.list_(pa.bool_())), pa.array([len(words)], pa.int64()),
        pa.array([packed(vocabulary, rising=True)], pa.binary()), pa.array([packed(tokens.astype(np.uint32))], pa.binary())],
        names=["block", "keys", "sizes", "trained", "n_tokens", "vocabulary", "tokens"])


def token_blocks(docs: DataFrame, key: str, text: str, trained: Column) -> DataFrame:
    """Blocks of whole documents: local vocabulary of word hashes, and tokens as numbers in it.

    Each document ends with the end token.  A long document is a block of its own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, base, count = Hasher(lower=True), TaskContext.get().partitionId() << 32, 0
        keys, sizes, flags, hashes, held = [], [], [], [], 0
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, end, data, offsets in text_chunks(batch.column(1)):
                words = words_of(data, offsets, hasher)
                stops = np.cumsum(words.counts)
                hashes.append(np.insert(words.hashes, stops, np.uint64(_END)))
                keys += ids[first:end]
                sizes += (words.counts + 1).tolist()
                flags += marks[first:end]
                held += len(hashes[-1])
                if held >= BLOCK_TOKENS:
                    yield _pack(keys, sizes, flags, hashes, base + count)
                    keys, sizes, flags, hashes, held, count = [], [], [], [], 0, count + 1
        if keys:
            yield _pack(keys, sizes, flags, hashes, base + count)

    return docs.select(F.col(key).cast("bigint"), text, trained).mapInArrow(run, BLOCK_SCHEMA)


class Ngrams(NamedTuple):
    """Distinct n-grams of one length in some texts, numbered."""

    n: int
    at: np.ndarray  # for every token, the number of the n-gram that ends there, or -1
    last: np.ndarray  # for every n-gram, a token at which it ends


class Texts:
    """Texts one after the other as token numbers, with their n-grams up to a length."""

    def __init__(self, row: dict, tokens: np.ndarray, words: int, order: int):
        self.keys, self.sizes, self.trained = row["keys"], np.array(row["sizes"], dtype=np.int64), row["trained"]
        self.tokens = tokens.astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.learned = np.repeat(np.array(self.trained, dtype=bool), self.sizes)
        place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.sizes)
        last = np.zeros(words, dtype=np.int64)
        last[self.tokens] = np.arange(len(self.tokens))
        self.levels = [Ngrams(words, self.tokens, last)]
        for k in range(2, order + 1):
            whole = np.flatnonzero(place >= k - 1)
            pairs, first, inverse = np.unique(
                self.levels[-1].at[whole - 1] * words + self.tokens[whole], return_index=True, return_inverse=True)
            at = np.full(len(self.tokens), -1, dtype=np.int64)
            at[whole] = inverse
            self.levels.append(Ngrams(len(pairs), at, whole[first]))

    def own_counts(self, level: Ngrams) -> np.ndarray:
        """How often each n-gram occurs in the training texts among these."""
        return np.bincount(level.at[self.learned & (level.at >= 0)], minlength=level.n)

    def hashes(self, vocabulary: np.ndarray) -> list[np.ndarray]:
        """A hash of each n-gram, by length."""
        out = [vocabulary]
        for k, (short, level) in enumerate(zip(self.levels, self.levels[1:]), 2):
            context = out[-1][short.at[level.last - 1]]
            out.append(mix(context * np.uint64(_STEP) + vocabulary[self.tokens[level.last]] + np.uint64(k)))
        return out


def _block(row: dict, order: int) -> tuple[Texts, np.ndarray]:
    vocabulary = unpacked(row["vocabulary"], np.uint64, rising=True)
    return Texts(row, unpacked(row["tokens"], np.uint32), len(vocabulary), order), vocabulary


def _cuts(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's run of the sorted hashes begins, and their end."""
    bounds = np.array([(i << 64) // shards for i in range(shards)], dtype=np.uint64)
    return np.append(np.searchsorted(hashes, bounds), len(hashes))


def messages(blocks: DataFrame, order: int, shards: int) -> DataFrame:
    """(level, shard, block, hashes, counts): a block's n-grams of one length in one shard, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                texts, vocabulary = _block(row, order)
                for k, (level, hashes) in enumerate(zip(texts.levels, texts.hashes(vocabulary)), 1):
                    by_hash = np.argsort(hashes)
                    hashes, counts = hashes[by_hash], texts.own_counts(level)[by_hash].astype(np.uint32)
                    cuts = _cuts(hashes, shards)
                    rows = [(k, s, row["block"], packed(hashes[a:b], rising=True), packed(counts[a:b]))
                            for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r[j] for r in rows], kind) for j, kind in enumerate(
                            (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                        names=["level", "shard", "block", "hashes", "counts"])

    return blocks.mapInArrow(run, "level int, shard int, block bigint, hashes binary, counts binary")


ANSWER_SCHEMA = "level int, shard int, block bigint, totals binary, n_distinct bigint, n_counted bigint"


def _answers(group: pa.Table) -> pa.Table:
    """Adds up the counts of one shard; one row back for each message, and one with its sums."""
    level, shard = group["level"][0].as_py(), group["shard"][0].as_py()
    parts = [unpacked(x.as_py(), np.uint64, rising=True) for x in group["hashes"]]
    counts = np.concatenate([unpacked(x.as_py(), np.uint32) for x in group["counts"]])
    distinct, place = np.unique(np.concatenate(parts), return_inverse=True)
    totals = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
    answer = np.split(totals[place], np.cumsum([len(p) for p in parts])[:-1])
    n = len(parts)
    return pa.table({
        "level": pa.array([level] * (n + 1), pa.int32()), "shard": pa.array([shard] * (n + 1), pa.int32()),
        "block": pa.array([*group["block"].to_pylist(), None], pa.int64()),
        "totals": pa.array([*map(packed, answer), None], pa.binary()),
        "n_distinct": pa.array([None] * n + [int(np.count_nonzero(totals))], pa.int64()),
        "n_counted": pa.array([None] * n + [int(totals.sum())], pa.int64())})


def _totals(texts: Texts, vocabulary: np.ndarray, answered: pa.Table) -> list[np.ndarray]:
    """Corpus counts of a block's n-grams by length, put together from the shards' answers."""
    rows, out = answered.select(["level", "shard", "totals"]).to_pylist(), []
    for k, hashes in enumerate(texts.hashes(vocabulary), 1):
        own = sorted((r for r in rows if r["level"] == k), key=lambda r: r["shard"])
        parts = np.concatenate([np.zeros(0, dtype=np.int64), *(unpacked(r["totals"], np.int64) for r in own)])
        if len(parts) != len(hashes):
            raise ValueError(f"{len(hashes) - len(parts)} counts of length {k} are missing")
        totals = np.empty(len(hashes), dtype=np.int64)
        totals[np.argsort(hashes)] = parts
        out.append(totals)
    return out


COUNTED_SCHEMA = ("keys array<bigint>, sizes array<int>, trained array<boolean>, tokens binary, words binary, counts array<binary>, "
                  "evidence array<struct<level:int,bucket:int,wins:bigint,every:bigint>>")


def _segments(texts: Texts, totals: list[np.ndarray], evidence: list[dict]) -> pa.Table:
    """The block's texts in runs of about SEGMENT_TOKENS, with the counts of all their n-grams.

    `words` has the count of each word of the segment, `counts` for each further length the
    count of the n-gram that ends at each token.
    """
    rows, first = [], 0
    while first < len(texts.sizes):
        end = int(np.searchsorted(texts.ends, texts.starts[first] + SEGMENT_TOKENS, side="right"))
        end = min(max(end, first + 1), len(texts.sizes))
        span = slice(int(texts.starts[first]), int(texts.ends[end - 1]))
        words, tokens = np.unique(texts.tokens[span], return_inverse=True)
        counts = [packed(np.where(level.at[span] >= 0, total[level.at[span]], 0) if level.n else np.zeros(len(tokens), dtype=np.int64))
                  for level, total in zip(texts.levels[1:], totals[1:])]
        rows.append({
            "keys": texts.keys[first:end], "sizes": texts.sizes[first:end].tolist(), "trained": texts.trained[first:end],
            "tokens": packed(tokens.astype(np.uint32)), "words": packed(totals[0][words]), "counts": counts,
            "evidence": evidence if not first else []})
        first = end
    names = ["level", "bucket", "wins", "every"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.Table.from_pylist(rows, pa.schema([
        ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("trained", pa.list_(pa.bool_())), ("tokens", pa.binary()),
        ("words", pa.binary()), ("counts", pa.list_(pa.binary())), ("evidence", pa.list_(pa.struct(list(zip(names, kinds)))))]))


def _buckets(counts: np.ndarray) -> np.ndarray:
    """Contexts by the binary logarithm of their count."""
    return np.log2(np.maximum(counts, 1)).astype(np.int64)


def _evidence(block: Texts, totals: list[np.ndarray], n: int, v: int) -> list[dict]:
    """(level, bucket, wins, all): deleted interpolation over the training tokens.

    With its own occurrence left out, does the longer or the shorter context foretell a token
    better?
    """
    out = []
    for k in range(1, len(block.levels)):
        long, short = block.levels[k], block.levels[k - 1]
        at = np.flatnonzero(block.learned & (long.at >= 0))
        context = totals[k - 1][short.at[at - 1]]
        high = (totals[k][long.at[at]] - 1) / np.maximum(context - 1, 1)
        if k == 1:
            low = totals[0][short.at[at]] / (n + v)
        else:
            low = (totals[k - 1][short.at[at]] - 1) / np.maximum(totals[k - 2][block.levels[k - 2].at[at - 1]] - 1, 1)
        bucket = _buckets(context)
        size = int(bucket.max(initial=0)) + 1
        every = np.bincount(bucket, minlength=size)
        wins = np.bincount(bucket[high > low], minlength=size)
        out += [{"level": k + 1, "bucket": b, "wins": int(wins[b]), "every": int(every[b])} for b in np.flatnonzero(every).tolist()]
    return out


class Automaton:
    """The states and arcs that a block's texts can visit.

    State 0 knows nothing; every seen n-gram shorter than the order is a state.  An arc leaves a
    state for each seen continuation, weighted with the smoothed probability.  A failure arc
    drops the oldest word and carries the share that the state leaves to shorter contexts.
    State 0 has an arc for every word, also an unknown one.
    """

    def __init__(self, block: Texts, totals: list[np.ndarray], n: int, v: int, shares: dict[tuple[int, int], float]):
        words, order = block.levels[0].n, len(block.levels)
        self.words = words
        weight = [(totals[0] + 1) / (n + v + 1)]
        number = [np.where(totals[0] > 0, np.arange(1, words + 1), 0) if order > 1 else np.zeros(words, dtype=np.int64)]
        first = words + 1
        fail = [np.zeros(words + 1, dtype=np.int64)]
        leave = [np.zeros(words + 1)]
        keys, weights, nexts = [np.arange(words)], [np.log10(weight[0])], [number[0]]
        for k in range(1, order):
            level, short = block.levels[k], block.levels[k - 1]
            context, suffix = short.at[level.last - 1], short.at[level.last]
            count = totals[k - 1]
            share = np.array([shares.get((k + 1, b), 0.5) for b in range(65)])[_buckets(count)]
            seen_context = count[context] > 0
            mixed = share[context] * totals[k] / np.maximum(count[context], 1) + (1 - share[context]) * weight[k - 1][suffix]
            weight.append(np.where(seen_context, mixed, weight[k - 1][suffix]))
            # The states of this context length: what they fail to, and at what price.
            price = np.log10(1 - share)
            if k == 1:
                leave[0][1:] = price
            else:
                fail.append(number[k - 2][block.levels[k - 2].at[short.last]])
                leave.append(price)
            if k < order - 1:
                state = np.where(totals[k] > 0, first + np.arange(level.n), number[k - 1][suffix])
                first += level.n
            else:
                state = number[k - 1][suffix]
            number.append(state)
            arcs = np.flatnonzero(totals[k] > 0)
            keys.append(number[k - 1][context[arcs]] * words + block.tokens[level.last[arcs]])
            weights.append(np.log10(weight[k][arcs]))
            nexts.append(state[arcs])
        self.fail, self.leave = np.concatenate(fail).tolist(), np.concatenate(leave).tolist()
        self.arcs = dict(zip(np.concatenate(keys).tolist(), range(sum(map(len, keys)))))
        self.weights, self.nexts = np.concatenate(weights).tolist(), np.concatenate(nexts).tolist()

    def score(self, tokens: list[int]) -> float:
        """One run from left to right: log10 probability of the tokens."""
        find, weights, nexts, words = self.arcs.get, self.weights, self.nexts, self.words
        state, total = 0, 0.0
        for word in tokens:
            arc = find(state * words + word)
            while arc is None:
                total += self.leave[state]
                state = self.fail[state]
                arc = find(state * words + word)
            total += weights[arc]
            state = nexts[arc]
        return total


def _score_rows(row: dict, order: int, n: int, v: int, shares: dict) -> list[list]:
    words = unpacked(row["words"], np.int64)
    texts = Texts(row, unpacked(row["tokens"], np.uint32), len(words), order)
    totals = [words, *(unpacked(c, np.int64)[level.last] for c, level in zip(row["counts"], texts.levels[1:]))]
    automaton = Automaton(texts, totals, n, v, shares)
    tokens, counts = texts.tokens.tolist(), words[texts.tokens]
    base = np.add.reduceat(np.log10((counts + 1) / (n + v + 1)), texts.starts)
    known = np.add.reduceat((counts > 0).astype(np.int64), texts.starts)
    scores = [automaton.score(tokens[a:b]) for a, b in zip(texts.starts.tolist(), texts.ends.tolist())]
    return [texts.keys, [not t for t in texts.trained], texts.sizes.tolist(), known.tolist(), base.tolist(), scores]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", trained: Column | None = None,
          order: int = ORDER) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`.

    Learns from the rows where `trained` holds (by default all but one of seven folds of the key)
    and scores all.  `score`: an n-gram probability mixes the relative frequency with the next
    shorter n-gram's, in shares found by deleted interpolation for each size of context; the
    base is the add-one unigram.  A null text counts as empty and scores its end token; a null key
    is learned from; repeated rows count and are scored each; without training tokens every token
    has probability 1.
    """
    trained = training_row(F.col(key)) if trained is None else trained
    blocks = session.land(token_blocks(docs, key, text, trained.alias("trained")), "blocks")
    tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shards = max(1, -(-order * tokens // SHARD_NGRAMS))
    answers = session.land(messages(blocks, order, shards).groupBy("level", "shard").applyInArrow(
        _answers, ANSWER_SCHEMA), "answers")
    v, n = answers.filter("block is null and level = 1").agg(
        F.coalesce(F.sum("n_distinct"), F.lit(0)), F.coalesce(F.sum("n_counted"), F.lit(0))).first()

    def count(one: pa.Table, answered: pa.Table) -> pa.Table:
        parts = []
        for row in one.to_pylist():
            texts, vocabulary = _block(row, order)
            totals = _totals(texts, vocabulary, answered)
            parts.append(_segments(texts, totals, _evidence(texts, totals, n, v)))
        return pa.concat_tables(parts)

    paired = blocks.groupBy("block").cogroup(answers.filter("block is not null").groupBy("block"))
    counted = session.land(paired.applyInArrow(count, COUNTED_SCHEMA), "counted")
    evidence = counted.select(F.inline("evidence")).groupBy("level", "bucket").agg(
        F.sum("wins").alias("wins"), F.sum("every").alias("every"))
    # At most 64 buckets for each length of context.
    shares = {(r.level, r.bucket): (r.wins + 1) / (r.every + 2) for r in evidence.collect()}
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    names = ["key", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = _score_rows(batch.slice(i, 1).to_pylist()[0], order, n, v, shares)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=names)

    out = counted.drop("evidence").mapInArrow(
        run, "key bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known",
                      F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
