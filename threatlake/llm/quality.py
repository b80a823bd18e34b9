"""Quality rules: word and repetition counts, and bands of zstandard compression ratios."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.llm.textops import Hasher, Words, find_words, is_word_byte, text_chunks, windows

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


class Band(NamedTuple):
    """Allowed ratios (bytes / compressed bytes) of texts shorter than `below` bytes."""

    below: float
    least: float
    most: float


#: Limits by length.  Short texts carry the frame's fixed cost and have no lower limit; longer
#: texts hold more repeats by chance, so both limits rise.  Base64 lies near 1.3, prose of one
#: language between 1.5 and 2.6, generated repetition above 4.
DOCUMENT_BANDS = (
    Band(200, 0.0, 2.6), Band(500, 1.05, 3.0), Band(1_000, 1.15, 3.2), Band(2_000, 1.3, 3.4),
    Band(4_000, 1.4, 3.6), Band(8_000, 1.45, 3.8), Band(16_000, 1.5, 4.0), Band(float("inf"), 1.5, 4.5))
#: The same for chunks of at most CHUNK_SIZE bytes.
CHUNK_BANDS = (
    Band(200, 0.0, 3.0), Band(500, 1.0, 3.2), Band(1_000, 1.1, 3.4), Band(float("inf"), 1.25, 3.6))
CHUNK_SIZE = 2_048
#: A text is rejected if more than this share of its bytes lies in chunks outside their band.
BAD_SHARE = 0.5

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

COLUMNS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
           "base_failed boolean, n_bytes bigint, ratio double, bad_share double, kept boolean")


def band_of(bands: tuple[Band, ...], size: int) -> Band:
    return next(b for b in bands if size < b.below)


def compression(data: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratio of the whole text, and the share of its bytes in chunks outside their band."""
    if not data:
        return 1.0, 0.0
    bad = 0
    for at in range(0, len(data), CHUNK_SIZE):
        chunk = data[at: at + CHUNK_SIZE]
        band = band_of(CHUNK_BANDS, len(chunk))
        if not band.least <= len(chunk) / len(compressor.compress(chunk)) <= band.most:
            bad += len(chunk)
    return len(data) / len(compressor.compress(data)), bad / len(data)


def passes(size: int, ratio: float, bad_share: float) -> bool:
    band = band_of(DOCUMENT_BANDS, size)
    return band.least <= ratio <= band.most and bad_share <= BAD_SHARE


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where (owner, hash) occurs twice or more."""
    order = np.lexsort((hashes, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    out = np.zeros(len(owner), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, hasher: Hasher) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of the text."""
    if not len(data):
        return np.zeros(len(offsets) - 1, dtype=np.int64)
    feeds = np.flatnonzero(data == 0x0A)
    begins = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    begins = begins[begins < len(data)]
    ends = np.minimum(np.append(begins[1:], len(data)), len(data))
    # A line ends before its line feed, unless the text ends without one.
    ends = ends - (data[ends - 1] == 0x0A)
    has_word = np.searchsorted(starts, ends) > np.searchsorted(starts, begins)
    begins, ends = begins[has_word], ends[has_word]
    owner = np.searchsorted(offsets, begins, side="right") - 1
    hashes = hasher.ranges(data, begins, ends)
    pairs = np.unique(np.stack([owner.astype(np.uint64), hashes]), axis=1)[0] if len(owner) else owner
    n = len(offsets) - 1
    return np.bincount(owner, minlength=n) - np.bincount(pairs.astype(np.int64), minlength=n)


def _repeated_words(words: Words) -> np.ndarray:
    """Words of each text inside a window of WINDOW words that the text holds twice or more."""
    hashes, first = windows(words, WINDOW)
    first = first[_repeats(words.owner[first], hashes)]
    cover = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return np.bincount(words.owner[covered], minlength=len(words.counts))


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The columns of COLUMNS for a column of texts."""
    hasher, compressor = Hasher(lower=False), zstandard.ZstdCompressor(level=3)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    parts: list[dict] = []
    for first, end, data, offsets in text_chunks(column):
        starts, ends, owner, counts = find_words(data, offsets)
        words = Words(hasher.ranges(data, starts, ends), owner, starts, ends, counts)
        repeated = _repeated_words(words)
        squeezed = [compression(data[a:b].tobytes(), compressor) for a, b in zip(offsets[:-1], offsets[1:])]
        sizes = np.diff(offsets)
        failed = (counts < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * counts)
        good = np.array([passes(int(n), *x) for n, x in zip(sizes, squeezed)], dtype=bool)
        parts.append({
            "n_words": counts, "word_chars": _per_text(is_word_byte(data) & ((data & 0xC0) != 0x80), offsets),
            "n_symbols": _per_text(symbol[data], offsets),
            "n_dup_lines": _duplicate_lines(data, offsets, starts, hasher), "n_repeat_words": repeated,
            "base_failed": failed, "n_bytes": sizes, "ratio": np.array([x[0] for x in squeezed]),
            "bad_share": np.array([x[1] for x in squeezed]), "kept": ~failed & good})
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def assess(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds counts, compression ratios and the verdict `kept` to every row; a map without a shuffle.

    `base_failed`: fewer than 20 words, or over 30 % of the words in 8-word windows that repeat.
    `kept`: not failed, whole-text ratio inside the band of its length, and at most half of the
    bytes in chunks outside theirs.  A null text counts as empty and fails; repeated rows are
    judged each; an input column with the name of a new one is replaced, unless a `prefix`
    sets the new ones apart.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    docs = docs.drop(*(prefix + n for n in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = measure(batch.column(at))
            arrays = list(batch.columns) + [pa.array(found[n]) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *(prefix + n for n in names)])

    at = docs.columns.index(text)
    out = docs.select("*", *(F.lit(None).cast(c.split()[1]).alias(prefix + c.split()[0]) for c in COLUMNS.split(", ")))
    return docs.mapInArrow(run, out.schema)


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that `assess` keeps, with the columns of `docs`."""
    prefix = "_q_"
    while any(name.startswith(prefix) for name in docs.columns):
        prefix = "_" + prefix
    return assess(docs, text, prefix).filter(f"{prefix}kept").select(*(F.col(f"`{n}`") for n in docs.columns))
