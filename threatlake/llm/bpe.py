"""Byte-pair encoding of whole texts by forced boundaries, and decoding.

The vocabulary is a file of the tokenizers library with an end-of-word suffix, lower-casing
and byte-level symbols; its path is a parameter and nothing is trained here.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

#: Bytes of text whose ids are held at once.
CHUNK_BYTES = 1 << 20
#: Words whose ids a task remembers; then it starts anew.
MAX_WORDS = 200_000

# Characters for which composition changes nothing and lower case does not depend on neighbours.
_PLAIN_END, _DASHES = 0x180, (0x2010, 0x2027)
_UNUSUAL = re.compile(f"[^\\x00-{chr(_PLAIN_END - 1)}{chr(_DASHES[0])}-{chr(_DASHES[1])}]")


def _byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for i, b in enumerate(b for b in range(256) if not out[b]):
        out[b] = chr(256 + i)
    return out


def _plain_word_pattern() -> re.Pattern:
    """Words of texts of plain characters only: contractions, letters, single numbers, the rest."""
    codes = [*range(_PLAIN_END), *range(_DASHES[0], _DASHES[1] + 1)]
    letters = "".join(re.escape(chr(c)) for c in codes if unicodedata.category(chr(c))[0] == "L")
    numbers = "".join(re.escape(chr(c)) for c in codes if unicodedata.category(chr(c))[0] == "N")
    space = "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


class Words(dict):
    """Ids of words in byte symbols, found on first sight by forced boundaries.

    Two neighbouring symbols that no vocabulary token holds side by side can never be merged,
    so a word is cut between them and each piece is merged alone.  The end of a word is such a
    cut as well: no token goes on after the suffix.
    """

    def __init__(self, spec: dict):
        super().__init__()
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        self.last = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix)
        self.pairs: set[str] = set()
        for token in model["vocab"]:
            body = token.removesuffix(self.suffix)
            self.pairs.update(body[i: i + 2] for i in range(len(body) - 1))

    def pieces(self, word: str) -> list[str]:
        cuts = [i + 1 for i in range(len(word) - 1) if word[i: i + 2] not in self.pairs]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= MAX_WORDS:
            self.clear()
        *inner, last = self.pieces(word)
        ids = [t.id for piece in inner for t in self.inner.tokenize(piece)]
        ids += [t.id for t in self.last.tokenize(last)]
        self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(spec)
        self.symbols = _byte_symbols()
        self.plain = _plain_word_pattern()
        self.by_text: dict[str, list[int]] = {}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        names = {**{i: t for t, i in spec["model"]["vocab"].items()}, **{i: t for t, i in self.added.items()}}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)])

    def _plain_ids(self, text: str) -> list[int]:
        known, out = self.by_text, []
        for word in self.plain.findall(text.lower()):
            ids = known.get(word)
            if ids is None:
                if len(known) >= MAX_WORDS:
                    known.clear()
                ids = known[word] = self.words["".join(map(self.symbols.__getitem__, word.encode()))]
            out += ids
        return out

    def _segment(self, text: str) -> list[int]:
        if not _UNUSUAL.search(text):
            return self._plain_ids(text)
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [i for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) for i in self.words[word]]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text.  Special tokens named in the text become their ids."""
        if self.split is None or not any(t in text for t in self.added):
            return self._segment(text)
        out: list[int] = []
        for part in self.split.split(text):
            out += [self.added[part]] if part in self.added else self._segment(part)
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids, special tokens included; the file names no decoder, so tokens
        are joined by one space."""
        tokens = pa.ListArray.from_arrays(ids.offsets, self.names.take(ids.values))
        return pc.binary_join(tokens, " ")


def _lists(rows: list[list[int]]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    values = np.fromiter((i for row in rows for i in row), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        before = int(sizes[first - 1]) if first else 0
        end = min(max(int(np.searchsorted(sizes, before + CHUNK_BYTES, side="right")), first + 1), len(column))
        yield first, end
        first = end


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds `ids` array<int>, the ids of every whole text, and if named `decoded`, their text.

    A map without a shuffle.  A null text counts as empty: no ids and an empty decoded text.
    Repeated rows are encoded each.  `path` must be readable on every executor; input columns
    with the names of the new ones are replaced.
    """
    new = [ids, *([decoded] if decoded else [])]
    docs = docs.drop(*new)
    kinds = ["array<int>", "string"]
    at, schema = docs.columns.index(text), docs.select("*", *(
        F.lit(None).cast(k).alias(n) for n, k in zip(new, kinds))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            for first, end in _slices(batch.column(at)):
                part = batch.slice(first, end - first)
                lists = _lists([codec.encode(t or "") for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, lists, *([codec.decode(lists)] if decoded else [])], names=[*part.schema.names, *new])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text of every list of ids; null lists give null texts; a column `decoded` is replaced."""
    rows = rows.drop(decoded)
    at, schema = rows.columns.index(ids), rows.select("*", F.lit(None).cast("string").alias(decoded)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            column = batch.column(at)
            lists = _lists([x or [] for x in column.to_pylist()])
            texts = pc.if_else(column.is_valid(), codec.decode(lists), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, decoded])

    return rows.mapInArrow(run, schema)
