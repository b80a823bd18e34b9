"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatlake.llm.textops import Hasher, find_words, text_chunks

#: Labelled rows of each label to learn from, at most, and the longest text among them in bytes.
MAX_PER_LABEL, MAX_TRAIN_BYTES = 2_500, 65_536
#: One row in so many is kept from training to calibrate scores.
CALIBRATION_FOLD = 5
#: Thresholds come from histograms of log odds within +-ODDS, so many bins to a unit; a language
#: has its own from so many toxic rows on.
ODDS, BINS_PER_UNIT, MIN_TOXIC = 16, 64, 10
#: Size of an embedding, widths of the filters in words, filters of each width.
SIZE, WIDTHS, FILTERS = 16, (1, 2, 3), 16
#: Words and word beginnings of so many bytes have hashed embeddings, if so many rows hold them.
PREFIX_BYTES, MIN_ROWS = 5, 2
EPOCHS, BATCH, RATE = 6, 32, 0.05
#: A row is predicted toxic from this score on.
PREDICTED_FROM = 0.3

_PAD = max(WIDTHS) - 1


class Tokens(NamedTuple):
    """Tokens of some texts: hashes of words and of their beginnings, 0 where padding follows a text."""

    words: np.ndarray
    prefixes: np.ndarray
    starts: np.ndarray  # of each text; every text ends with padding


def tokens_of(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> Tokens:
    """Words are runs of ASCII letters and digits and of other alphabets; A-Z count as a-z."""
    inside = ((data | 0x20) >= 97) & ((data | 0x20) <= 122) | (data >= 48) & (data <= 57) | (data >= 0x80)
    starts, ends, _, counts = find_words(data, offsets, inside)
    at = np.repeat(np.cumsum(counts), _PAD)
    words = np.insert(hasher.ranges(data, starts, ends), at, np.uint64(0))
    beginnings = hasher.ranges(data, starts, np.minimum(ends, starts + PREFIX_BYTES))
    return Tokens(words, np.insert(beginnings ^ np.uint64(1), at, np.uint64(0)),
                  np.concatenate([[0], np.cumsum(counts + _PAD)[:-1]]).astype(np.int64))


class Model(NamedTuple):
    known: np.ndarray  # sorted hashes with an embedding
    embeddings: np.ndarray  # one row more than `known`: the last is zero, for all others
    filters: list[np.ndarray]  # by width: (width, SIZE, FILTERS)
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    scale: float  # score = logistic(scale * output + shift)
    shift: float


def _rows(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return np.where(known[at] == hashes, at, len(known))


def _inputs(model: Model, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, prefixes = _rows(model.known, tokens.words), _rows(model.known, tokens.prefixes)
    return words, prefixes, model.embeddings[words] + model.embeddings[prefixes]


def _convolved(model: Model, x: np.ndarray, k: int) -> np.ndarray:
    width = WIDTHS[k]
    n = len(x) - width + 1
    out = np.full((len(x), FILTERS), -1.0, dtype=np.float32)
    if n > 0:
        out[:n] = sum(x[j: j + n] @ model.filters[k][j] for j in range(width)) + model.biases[k]
    return out


def outputs(model: Model, tokens: Tokens) -> np.ndarray:
    """The network's output for each text, before the logistic."""
    pad = tokens.words == 0
    _, _, x = _inputs(model, tokens)
    pooled = []
    for k in range(len(WIDTHS)):
        values = _convolved(model, x, k)
        values[pad] = 0.0
        pooled.append(np.maximum.reduceat(np.maximum(values, 0.0), tokens.starts))
    return np.concatenate(pooled, axis=1) @ model.weights + model.bias


def probability(model: Model, output: np.ndarray) -> np.ndarray:
    z = model.scale * output.astype(np.float64) + model.shift
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _tokens_of_texts(texts: list[str]) -> list[Tokens]:
    hasher, out = Hasher(lower=True), []
    for text in texts:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        out.append(tokens_of(data, np.array([0, len(data)]), hasher))
    return out


def _joined(parts: list[Tokens]) -> Tokens:
    sizes = [len(p.words) for p in parts]
    return Tokens(np.concatenate([p.words for p in parts]), np.concatenate([p.prefixes for p in parts]),
                  np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64))


def _step(model: Model, batch: Tokens, y: np.ndarray, sums: dict) -> float:
    """One step of adaptive gradient descent on the mean log loss of a batch; returns the new bias."""
    words, prefixes, x = _inputs(model, batch)
    ends = np.append(batch.starts[1:], len(batch.words))
    pad = batch.words == 0
    pooled, best = [], []
    for k in range(len(WIDTHS)):
        values = _convolved(model, x, k)
        values[pad] = 0.0
        at = np.stack([a + values[a:b].argmax(axis=0) for a, b in zip(batch.starts, ends)])
        pooled.append(np.maximum(np.take_along_axis(values, at, axis=0), 0.0))
        best.append(at)
    features = np.concatenate(pooled, axis=1)
    error = (0.5 * (1 + np.tanh(0.5 * (features @ model.weights + model.bias))) - y) / len(y)

    def update(name: str, value: np.ndarray, gradient: np.ndarray) -> None:
        sums[name] = sums.get(name, 1e-8) + gradient ** 2
        value -= RATE * gradient / np.sqrt(sums[name])

    back = error[:, None] * model.weights[None, :] * (features > 0)
    grad_x = np.zeros_like(x)
    for k, width in enumerate(WIDTHS):
        own = back[:, k * FILTERS: (k + 1) * FILTERS].astype(np.float32)
        grad = np.zeros_like(model.filters[k])
        for j in range(width):
            rows = np.minimum(best[k] + j, len(x) - 1)
            grad[j] = np.einsum("nf,nfd->df", own, x[rows])
            np.add.at(grad_x, rows.reshape(-1), (own[:, :, None] * model.filters[k][j].T[None]).reshape(-1, SIZE))
        update(f"f{k}", model.filters[k], grad)
        update(f"b{k}", model.biases[k], own.sum(axis=0))
    update("w", model.weights, features.T @ error)
    hit = np.flatnonzero(grad_x.any(axis=1))
    rows = np.concatenate([words[hit], prefixes[hit]])
    used, place = np.unique(rows, return_inverse=True)
    grads = np.zeros((len(used), SIZE), dtype=np.float32)
    np.add.at(grads, place, np.concatenate([grad_x[hit], grad_x[hit]]))
    real = used < len(model.known)
    used, grads = used[real], grads[real]
    sums["e"][used] += grads ** 2
    model.embeddings[used] -= RATE * grads / np.sqrt(sums["e"][used])
    sums["bias"] = sums.get("bias", 1e-8) + error.sum() ** 2
    return model.bias - RATE * error.sum() / np.sqrt(sums["bias"])


def _platt(output: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit with smoothed targets."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 0.5 * (1 + np.tanh(0.5 * (a * output + b)))
        slope = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - target) * output).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(slope * output ** 2).sum() + 1e-3, (slope * output).sum()], [(slope * output).sum(), slope.sum() + 1e-9]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -2, 2)
    return float(max(a, 0.05)), float(b)


def train(texts: list[str], labels: list[int], calibrating: list[bool], prior: float, seed: int = 3) -> Model:
    """Fits the network on the rows not kept for calibration, then scale and shift on those.

    `prior` is the share of toxic rows among all labelled ones; scores are moved to it from the
    share in the sample.
    """
    rng = np.random.default_rng(seed)
    parts, y = _tokens_of_texts(texts), np.array(labels, dtype=np.float32)
    fit = np.flatnonzero(~np.array(calibrating, dtype=bool))
    every = [np.unique(np.concatenate([parts[i].words, parts[i].prefixes])) for i in fit]
    hashes, rows = np.unique(np.concatenate([*every, np.zeros(0, dtype=np.uint64)]), return_counts=True)
    known = hashes[(rows >= MIN_ROWS) & (hashes != 0)]
    embeddings = np.concatenate([rng.normal(0, 0.1, (len(known), SIZE)), np.zeros((1, SIZE))]).astype(np.float32)
    model = Model(
        known, embeddings, [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0, 1.0, 0.0)
    sums: dict = {"e": np.full_like(embeddings, 1e-8)}
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for at in range(0, len(order), BATCH):
            rows = order[at: at + BATCH]
            model = model._replace(bias=_step(model, _joined([parts[i] for i in rows]), y[rows], sums))
    held = np.flatnonzero(calibrating)
    if len(np.unique(y[held])) < 2:
        held = np.arange(len(y))
    if len(np.unique(y[held])) < 2:
        # One label only: every score is the share of that label.
        share = float(np.clip(prior, 1e-6, 1 - 1e-6))
        return model._replace(scale=0.0, shift=float(np.log(share / (1 - share))))
    scale, shift = _platt(np.concatenate([outputs(model, _joined([parts[i]])) for i in held]), y[held])
    sample = float(np.clip(y[held].mean(), 1e-6, 1 - 1e-6))
    share = float(np.clip(prior, 1e-6, 1 - 1e-6))
    moved = np.log(share / (1 - share)) - np.log(sample / (1 - sample))
    return model._replace(scale=scale, shift=shift + float(moved))


def odds_bins(scores: np.ndarray) -> np.ndarray:
    odds = np.log(np.maximum(scores, 1e-300)) - np.log(np.maximum(1 - scores, 1e-300))
    return np.floor(np.clip(odds, -ODDS, ODDS) * BINS_PER_UNIT).astype(np.int32)


def best_threshold(bins: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> float:
    """The threshold of the best F1 among bins with these weights of toxic and other rows.

    It is midway between neighbouring bins with rows; PREDICTED_FROM without rows of both labels.
    """
    if not toxic.any() or not other.any():
        return PREDICTED_FROM
    bins, at = np.unique(bins, return_inverse=True)
    toxic, other = np.bincount(at, toxic)[::-1], np.bincount(at, other)[::-1]
    hits = np.cumsum(toxic)
    i = len(bins) - 1 - int(np.argmax(2 * hits / (hits + np.cumsum(other) + hits[-1])))
    low = 1 / (1 + np.exp(-bins[i] / BINS_PER_UNIT))
    return float((low + (1 / (1 + np.exp(-(bins[i - 1] + 1) / BINS_PER_UNIT)) if i else 0.0)) / 2)


def thresholds(histogram: list[tuple]) -> dict:
    """A threshold for each language, and under None for all others.

    The histogram has rows of (language, bin, label, labelled rows, those of them not trained on).
    The latter stand for all rows of their language and label.
    """
    if not histogram:
        return {None: PREDICTED_FROM}
    langs, bins, labels, rows, unseen = (np.array(c, dtype=t) for c, t in zip(zip(*histogram), (object, int, int, float, float)))
    names = np.array([x or "" for x in langs], dtype=str)
    weight, own = np.zeros(len(rows)), {}
    for name in np.unique(names):
        for y in (0, 1):
            at = (names == name) & (labels == y)
            weight[at] = unseen[at] * (rows[at].sum() / max(unseen[at].sum(), 1.0))
        own[str(name)] = names == name
    toxic, other = np.where(labels == 1, weight, 0.0), np.where(labels == 0, weight, 0.0)
    seen = weight > 0
    out = {None: best_threshold(bins[seen], toxic[seen], other[seen])}
    for name, at in own.items():
        if name and unseen[at & (labels == 1)].sum() >= MIN_TOXIC:
            out[name] = best_threshold(bins[at & seen], toxic[at & seen], other[at & seen])
    return out


def fold(key: Column, folds: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
        label: str = "toxic", learn: Column | None = None) -> tuple[Model, dict]:
    """A model from at most MAX_PER_LABEL rows of each label, and thresholds from all labelled rows.

    The rows to train on come first by a hash of their key among the labelled ones where `learn`
    holds; ids are chosen first, so only chosen texts reach the driver, each of at most
    MAX_TRAIN_BYTES bytes.  All rows where `learn` holds are then scored where they are, and
    those not trained on, long ones too, set the thresholds; a histogram for each language
    reaches the driver.  Rows with a null label or key are left out; a key labelled twice takes
    the larger.  Of the short texts of one key the smallest is learnt from.
    """
    learn = F.lit(True) if learn is None else learn
    marked = labels.select(F.col(key).alias("id"), F.col(label).alias("y")).filter(
        "id is not null and y is not null").groupBy("id").agg(F.max(F.col("y").cast("int")).alias("y"))
    sizes = docs.select(F.col(key).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes")).filter(learn)
    usable = marked.filter("y in (0, 1)").join(sizes.groupBy("id").agg(F.min("bytes").alias("bytes")), "id")
    counts = {r.y: r.n for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    short = usable.filter(F.col("bytes") <= MAX_TRAIN_BYTES).select("id", "y")
    chosen = [short.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(MAX_PER_LABEL) for y in (0, 1)]
    ids = chosen[0].union(chosen[1])
    texts = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"), F.col(lang).alias("lang"))
    # At most 2 * MAX_PER_LABEL ids.
    rows = texts.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_TRAIN_BYTES).join(F.broadcast(ids), "id").withColumn(
        "calibrating", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(CALIBRATION_FOLD)) == 0).groupBy("id", "y", "calibrating").agg(
        F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: str(r.id))
    if not rows:
        return _empty(), {None: PREDICTED_FROM}
    model = train([r.text for r in rows], [r.y for r in rows], [r.calibrating for r in rows], prior)
    trained = docs.sparkSession.createDataFrame(
        [(r.id,) for r in rows if not r.calibrating], T.StructType([T.StructField("id", marked.schema["id"].dataType)]))
    scored = _binned(texts.filter(learn), model).join(marked.filter("y in (0, 1)"), "id").join(
        F.broadcast(trained.withColumn("trained", F.lit(1))), "id", "left")
    histogram = scored.groupBy("lang", "bin", "y").agg(F.count(F.lit(1)), F.count_if(F.col("trained").isNull()))
    return model, thresholds([tuple(r) for r in histogram.collect()])


def _binned(texts: DataFrame, model: Model) -> DataFrame:
    """(id, lang, bin) of the scores of (id, text, lang)."""
    texts = texts.select("id", F.col("lang").cast("string").alias("lang"), "text")
    schema = texts.select("id", "lang", F.lit(None).cast("int").alias("bin")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(2), 1 << 19):
                bins = odds_bins(probability(model, outputs(model, tokens_of(data, offsets, hasher))))
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bins)], names=schema.names)

    return texts.mapInArrow(run, schema)


def _empty() -> Model:
    """Without labelled rows every score is 0."""
    return Model(np.zeros(0, dtype=np.uint64), np.zeros((1, SIZE), dtype=np.float32),
                 [np.zeros((w, SIZE, FILTERS), dtype=np.float32) for w in WIDTHS], [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
                 np.zeros(FILTERS * len(WIDTHS), dtype=np.float32), 0.0, 0.0, -100.0)


def score(docs: DataFrame, model: Model, limits: dict, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds score (0 to 1), predicted (1 from PREDICTED_FROM on), threshold and flagged by language.

    A map over whole texts; the language only picks the threshold, and a null one takes the
    general one.  A null text counts as empty.  Input columns with the new names are replaced.
    """
    new = "score double, predicted int"
    docs = docs.drop("score", "predicted", "threshold", "flagged")
    at, schema = docs.columns.index(text), docs.select("*", *(
        F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in new.split(", "))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(at), 1 << 19):
                part = batch.slice(first, end - first)
                scores = probability(model, outputs(model, tokens_of(data, offsets, hasher)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(scores), pa.array((scores >= PREDICTED_FROM).astype(np.int32))],
                    names=schema.names)

    threshold = F.lit(limits[None])
    for name, value in limits.items():
        if name is not None:
            threshold = F.when(F.col(lang) == name, value).otherwise(threshold)
    out = docs.mapInArrow(run, schema).withColumn("threshold", threshold)
    return out.withColumn("flagged", F.col("score") >= F.col("threshold"))
