"""Secret scan: trigram queries from regexes, postings, verification of candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as sre_parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.llm.textops import text_chunks


class Rule(NamedTuple):
    """A kind of secret; matches whose `group` has fewer than `least` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds.  A run shorter than the minimum can hold no match, so the two plain runs
#: carry it in the pattern.
BASE_RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: A key to the END line before any other BEGIN; without one, to the end of its headers and base64 lines,
#: the last of which may be short.  Line feeds may be spelt out, as in JSON.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:"
    r"(?:[^-]|-(?!----(?:BEGIN |END [A-Z ]{0,20}PRIVATE KEY-----)))*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:(?:\s|\\[nrt])++(?:Proc-Type|DEK-Info):[^\n\\]*+)*+"
    r"(?:(?:(?:\s|\\[nrt])++[A-Za-z0-9+/]{16,}+={0,2})++(?:(?:\s|\\[nrt])++[A-Za-z0-9+/]{1,15}+={0,2}(?=\s*\n|\s*\Z|\\[nr]|[\"']))?)?)")
#: Formats of well-known credentials.
MORE_RULES = (
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("url_login", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._~!$&*+=-]+@"),
)
RULES = BASE_RULES + MORE_RULES

#: Strings that stand for one sub-pattern, at most.
MAX_STRINGS = 64
#: A character class of more letters than this says nothing about trigrams.
MAX_CLASS = 10

# A query is ("and", parts) or ("or", parts) of queries and trigrams; ("and", ()) always holds.
ANY = ("and", ())


def _both(a, b):
    parts = [p for q in (a, b) for p in (q[1] if isinstance(q, tuple) and q[0] == "and" else (q,))]
    unique = tuple(dict.fromkeys(parts))
    return unique[0] if len(unique) == 1 else ("and", unique)


def _either(queries: list):
    unique = tuple(dict.fromkeys(queries))
    if ANY in unique or not unique:
        return ANY
    return unique[0] if len(unique) == 1 else ("or", unique)


def _of_strings(strings: frozenset[str]):
    """What a text must hold if it holds one of the strings."""
    choices = []
    for s in sorted(strings):
        data = s.encode()
        grams = tuple(dict.fromkeys(data[i: i + 3] for i in range(len(data) - 2)))
        choices.append(ANY if not grams else grams[0] if len(grams) == 1 else ("and", grams))
    return _either(choices)


def _class_members(items: list) -> frozenset[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            out.add(chr(value))
        elif kind is sre.RANGE and value[1] - value[0] < MAX_CLASS:
            out.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    return frozenset(out) if len(out) <= MAX_CLASS else None


class _Found(NamedTuple):
    """All strings a sub-pattern can match, or None; and what holds of a text with a match."""

    strings: frozenset[str] | None
    query: object


def _fold(strings: frozenset[str]) -> frozenset[str]:
    return frozenset("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s) for s in strings)


def _item(kind, value) -> _Found:
    if kind is sre.LITERAL:
        return _Found(frozenset([chr(value)]), ANY)
    if kind is sre.IN:
        return _Found(_class_members(value), ANY)
    if kind is sre.SUBPATTERN:
        return _sequence(value[3])
    if kind is sre.BRANCH:
        found = [_sequence(x) for x in value[1]]
        if all(f.strings is not None for f in found):
            strings = frozenset().union(*(f.strings for f in found))
            if len(strings) <= MAX_STRINGS:
                return _Found(strings, ANY)
        return _Found(None, _either([_needed(f) for f in found]))
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, body = value
        inner = _sequence(body)
        if (least, most) == (0, 1) and inner.strings is not None:
            return _Found(inner.strings | {""}, ANY)
        return _Found(None, _needed(inner) if least else ANY)
    if kind is sre.AT:
        return _Found(frozenset([""]), ANY)
    return _Found(None, ANY)


def _needed(found: _Found):
    return found.query if found.strings is None else _both(found.query, _of_strings(_fold(found.strings)))


def _sequence(items) -> _Found:
    now: frozenset[str] = frozenset([""])
    query, whole = ANY, True
    for kind, value in items:
        found = _item(kind, value)
        if found.strings is None:
            query, now, whole = _both(_both(query, _of_strings(_fold(now))), found.query), frozenset([""]), False
        elif len(now) * len(found.strings) > MAX_STRINGS:
            query, now, whole = _both(query, _of_strings(_fold(now))), found.strings, False
        else:
            now = frozenset(a + b for a in now for b in found.strings)
    return _Found(now, query) if whole else _Found(None, _both(query, _of_strings(_fold(now))))


def trigram_query(pattern: str):
    """A Boolean query over lower-cased byte trigrams that every text with a match satisfies."""
    return _needed(_sequence(sre_parser.parse(pattern)))


def trigrams_in(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_in, query[1]))


def _code(gram: bytes) -> int:
    return int.from_bytes(gram, "big")


def postings(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """Numbers of the texts that hold each wanted trigram, ascending; `wanted` is a table by code."""
    lower = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    wide = lower.astype(np.uint32)
    codes = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:] if len(data) > 2 else np.zeros(0, dtype=np.uint32)
    at = np.flatnonzero(wanted[codes])
    owner = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 3 <= offsets[owner + 1]
    pairs = np.unique((codes[at[inside]].astype(np.int64) << 32) | owner[inside])
    grams, texts = pairs >> 32, pairs & 0xFFFFFFFF
    starts = np.flatnonzero(np.diff(grams, prepend=-1))
    return dict(zip(grams[starts].tolist(), np.split(texts, starts[1:])))


def candidates(query, index: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Texts that satisfy the query, by intersecting and uniting postings."""
    if isinstance(query, bytes):
        return index.get(_code(query), np.zeros(0, dtype=np.int64))
    parts = [candidates(q, index, n) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(parts))
    out = np.arange(n) if not parts else min(parts, key=len)
    for part in parts:
        out = out[np.isin(out, part, assume_unique=True)]
    return out


def matches(regex: re.Pattern, rule: Rule, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in regex.finditer(text) if len(m.group(rule.group)) >= rule.least]


class Scanner:
    """All rules over chunks of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.wanted = np.zeros(1 << 24, dtype=bool)
        for _, _, query in self.rules:
            for gram in trigrams_in(query):
                self.wanted[_code(gram)] = True

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[tuple[int, int, str]]], list[str]]:
        """(start, end, kind) of each text in order, and the texts.

        The texts of a chunk are one block of the index.  A rule whose query always holds has
        every text as a candidate.
        """
        n = len(offsets) - 1
        index = postings(data, offsets, self.wanted)
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        out: list[list[tuple[int, int, str]]] = [[] for _ in range(n)]
        for rule, regex, query in self.rules:
            for i in candidates(query, index, n).tolist():
                out[i] += [(a, b, rule.kind) for a, b in matches(regex, rule, texts[i])]
        for found in out:
            found.sort(key=lambda x: x[0])  # stable: kinds stay as listed
        return out, texts


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _arrow_spans(found: list[list[tuple[int, int, str]]]) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    return pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in one] for one in found], pa.list_(kind))


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """Adds all spans of every whole text, in code points, by start and then kind as listed.

    One map: each block of about a MB of texts is indexed by the trigrams the rules ask for,
    postings are intersected, and candidates verified.  Matches are leftmost and do not overlap
    within a kind.  A null text counts as empty; a text without secrets has an empty array;
    repeated rows are scanned each.  A column `into` of the input is replaced.
    """
    docs = docs.drop(into)
    at, schema = docs.columns.index(text), docs.select("*", F.lit(None).cast(SPANS).alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(at)):
                part = batch.slice(first, end - first)
                found, _ = scanner.spans(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, _arrow_spans(found)], names=[*part.schema.names, into])

    return docs.mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind."""
    out, done, reach = [], 0, -1
    for start, end, kind in spans:
        if start >= reach:
            out += [text[done:start], f"[{kind}]"]
        reach = max(reach, end)
        done = reach
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = None,
           rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with secrets replaced by `[kind]`; `length` names a column of text lengths to renew.

    Texts without secrets, null ones too, stay as they are.
    """
    at, schema = docs.columns.index(text), docs.schema
    size_at = docs.columns.index(length) if length else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(at)):
                part = batch.slice(first, end - first)
                found, texts = scanner.spans(data, offsets)
                columns = list(part.columns)
                hit = [i for i, spans in enumerate(found) if spans]
                if hit:
                    new = columns[at].to_pylist()
                    for i in hit:
                        new[i] = redacted(texts[i], found[i])
                    columns[at] = pa.array(new, columns[at].type)
                    if size_at is not None:
                        sizes = columns[size_at].to_pylist()
                        for i in hit:
                            sizes[i] = len(new[i])
                        columns[size_at] = pa.array(sizes, columns[size_at].type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
